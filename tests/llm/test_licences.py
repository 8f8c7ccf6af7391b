from __future__ import annotations

import re
import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from cases import SF  # noqa: E402

from strandflow.llm import license_digest  # noqa: E402
from strandflow.llm.license_published import PUBLISHED  # noqa: E402


def test_every_licence_line_of_the_documents_is_found(spark):
    """Lines that speak of a licence, searched for without the table of notices."""
    lines = re.compile(r"(?i)licen[cs]e|spdx|\bcc[ -]?(by|0)\b|creative commons")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet", f"{SF}/documents.parquet")
    want = Counter((r["doc_id"], sum(bool(lines.search(x)) for x in r["text"].split("\n"))) for r in docs.filter("text IS NOT NULL").collect())
    got = Counter((r["doc_id"], r["n_notices"]) for r in license_digest.scanned(docs.filter("text IS NOT NULL")).collect())
    assert got == want and sum(n for _, n in want) > 0


def test_creative_commons_notices(spark):
    said = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
        "Released under the Creative Commons Attribution-NoDerivs 3.0 Unported License (CC BY-ND 3.0).": "CC-BY-ND-3.0",
        "SPDX-License-Identifier: CC-BY-SA-2.0": "CC-BY-SA-2.0",
        "released under CC0": "CC0-1.0",
        "Distributed under Apache-2.0": "Apache-2.0",
        "Licensed under CC BY-NC 5.0.": "",
    }
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    assert {r["doc_id"]: r["notices"] for r in license_digest.scanned(docs).collect()} == dict(enumerate(said.values()))


def test_published_licence_texts(spark):
    flow = lambda t: "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", t))
    docs, want = [], []
    for name, text in PUBLISHED:
        short = text[: text.find("END OF TERMS AND CONDITIONS") + 27] if "END OF TERMS AND CONDITIONS" in text else text
        docs += ["\n\n" + text.upper() + "\n", flow(text), short, flow(short), text + "\nand one line"]
        want += [name] * 4 + [None]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in license_digest.scanned(table).collect()}
    assert [got[i] for i in range(len(docs))] == want
    assert {n for n, _ in PUBLISHED} >= {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"}


def test_a_digest_stands_for_one_licence(spark):
    known = license_digest.known(spark)
    assert known.groupBy("digest", "notice").agg(F.count_distinct("license").alias("n")).filter("n > 1").count() == 0
