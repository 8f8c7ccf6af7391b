from __future__ import annotations

import hashlib
import io
import sys
import zipfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from cases import SF, no_docs, odd_docs, rows  # noqa: E402

from strandflow.llm import rule_ledger as R  # noqa: E402
from strandflow.llm import warc_zip as Z  # noqa: E402
from strandflow.llm.common import new_folder  # noqa: E402


def plain_repeats(words):
    w = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({j for i, x in enumerate(w) if w.count(x) > 1 for j in (i, i + 1, i + 2)})


def test_repeated_words():
    for text in ("", "a b", "a b c a b c", "a a a a", "a b c d a b c e f", "a b a b a b x y z"):
        assert R.repeated_words(text.encode().split()) == plain_repeats(text.split())


def test_ledger_of_odd_rows(spark):
    got = R.judged(odd_docs(spark)).collect()
    assert len(got) == len(rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[3]["n_words"] == by[4]["n_words"] == by[5]["n_words"] == 0 and not by[3]["kept"] and by[3]["base_failed"]
    assert by[6]["n_words"] == 4000 * 11 and by[6]["n_dup_lines"] == 0
    assert by[13]["n_repeat_words"] == 3000 and by[11]["n_dup_lines"] == 8
    # \x1c, \x85 and \xa0 are not white space here.
    assert by[14]["n_words"] == 5 and by[14]["word_chars"] == 7
    assert R.judged(no_docs(spark)).count() == 0


def test_policies_and_ablation(spark):
    entries = spark.createDataFrame([(i, b) for i, b in enumerate([0, 1, 2, 3, 4, 4, 5, 64, 68])], "doc_id long, failures int")
    got = {r["rule"]: (r["n_failed"], r["n_failed_alone"]) for r in R.ablation(entries, 2).collect()}
    assert got["few_words"] == (3, 1) and got["repeated_words"] == (2, 1) and got["symbols"] == (4, 2) and got["shouting"] == (2, 1)
    assert got["long_words"] == (0, 0)
    assert {r["rule"]: r["n_failed"] for r in R.ablation(entries, 1).collect()} == {"few_words": 3, "repeated_words": 2}
    assert entries.filter(R.passes(1)).count() == 5 and entries.filter(R.passes(2)).count() == 1


PAGE = "page_id long, url string, html string"


def page_rows():
    long, longer = "<p>" + "é" * 60, "x" * 100
    return [
        (5, "http://a/1", long),
        (3, "http://a/2", long),
        (9, None, long),
        (4, "u", longer),
        (7, "u\r\nInjected: 1", longer),
        (6, "u", "short"),
        (8, "u", "short"),
        (10, "u", None),
        (11, "u", ""),
        (12, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 9),
        (13, "u", "y" * 3_000_000),
        (3, "http://a/2", long),
    ]


def test_packages_of_odd_rows(spark):
    pages = spark.createDataFrame(page_rows(), PAGE).selectExpr("*", "'x' AS digest", "'y' AS payload", "'z' AS first").repartition(3)
    folder = new_folder(spark, "pages")
    Z.write_packages(pages, folder)
    records = Z.read_packages(spark, folder).cache()
    assert records.count() == len(page_rows())
    by = {r["page_id"]: r for r in records.collect()}
    assert {k for k, r in by.items() if r["record_type"] == "revisit"} == {5, 7, 9}
    assert by[5]["refers_to"] == by[9]["refers_to"] == 3 and by[7]["refers_to"] == 4
    for key, _, html in page_rows():
        raw = (html or "").encode()
        assert (by[key]["payload_bytes"], by[key]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    whole = {r["page_id"]: bytes(r["payload"]) for r in Z.with_payloads(records).collect()}
    assert whole == {k: (h or "").encode() for k, _, h in page_rows()}
    # The packages are ordinary ZIP files.
    for r in Z.manifest(spark, folder).collect():
        with zipfile.ZipFile(r["package"]) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            assert z.namelist() == [Z.ARCHIVE, Z.INDEX, "datapackage.json"]
    none = spark.createDataFrame([], PAGE)
    assert Z.archived(none).count() == 0
    nameless = spark.createDataFrame([(None, "u", "z" * 200), (None, "u", "z" * 200), (2, "u", "w" * 200), (None, "u", "w" * 200)], PAGE)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in Z.archived(nameless).select("page_id", "record_type", "refers_to").collect() if r)
    assert got == [(0, "response", None), (0, "response", None), (0, "revisit", 2), (2, "response", None)]


def reader(raw: bytes) -> Z.PackageReader:
    return Z.PackageReader(lambda n, at: raw[at : at + n], len(raw))


def test_directories_with_comments_and_zip64():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("first", b"x" * 1000)
        z.writestr(zipfile.ZipInfo("indexes/index.cdxj"), b'{"a": 1}\n')
        z.comment = b"PK\x05\x06 in a comment"
    assert reader(out.getvalue()).read("indexes/index.cdxj") == b'{"a": 1}\n'
    # More members than the plain record can count: the end record and locator are ZIP64.
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(65_600):
            z.writestr(f"m{i}", b"")
        z.writestr("last", b"found")
    big = reader(out.getvalue())
    assert len(big.members) == 65_601 and big.read("last") == b"found"


def test_directory_entries_that_need_64_bits():
    """A central directory whose entry keeps its sizes and place in the ZIP64 field."""
    import struct

    data, name = b"payload", b"m"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, 7, 7)
    extra = struct.pack("<HH2s", 0x9999, 2, b"zz") + struct.pack("<HHQQQ", 1, 24, 7, 7, 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local + data)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert reader(local + data + central + end64 + locator + end).read("m") == data


def test_what_cannot_be_read_is_said():
    with pytest.raises(ValueError, match="not a ZIP"):
        reader(b"x" * 100)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m", b"x" * 1000)
    with pytest.raises(ValueError, match="compressed"):
        reader(out.getvalue()).read("m")
    bad = Z.record(1, "u", b"abc", hashlib.sha256(b"abd").hexdigest(), None)
    with pytest.raises(ValueError, match="digest"):
        Z.parse_record(bad)


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["payload_digest"] for r in Z.archived(pages).collect()}
    assert got == {r["page_id"]: hashlib.sha256((r["html"] or "").encode()).hexdigest() for r in pages.collect()}
