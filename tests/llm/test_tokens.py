from __future__ import annotations

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from cases import LONG, documents, no_docs, odd_docs, rows  # noqa: E402

from strandflow.llm import residual_packing, token_store  # noqa: E402
from strandflow.llm.common import new_folder  # noqa: E402
from strandflow.llm.tokens import Encoder, tokenizer_path  # noqa: E402

NAME = "byte_bpe_50k.json"
ODD = ["", " ", "\n", "a", " a", "a\n", "\na", "a  b", "a\tb c", "don't 's ve <|endoftext|> x", "a \n b", "x\x1cy z", "é q r", "a\r\nb c", "ab\ncd, ef!\n\ngh", "_a_ b_1 2c", "日本 語 текст"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(NAME))
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def ids_of(plain, text):
    return np.array([*plain(text), 2], dtype="<u4")


@pytest.mark.parametrize("kept", [5, 1000])
def test_encoder_equals_the_tokenizer(plain, kept):
    enc = Encoder(tokenizer_path(NAME), kept)
    texts = [*ODD, LONG, "ab cd " * 50_000, *[r[1] or "" for r in rows()]]
    for group in (texts, texts[::-1], *[[t] for t in texts]):
        ids, counts = enc.encode(group)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [plain(t) for t in group]


def test_special_spellings_are_those_of_the_tokenizer(plain):
    parts = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "\t", "a", "Word", "don't", "9", "é", "<|", ".", "\x1c"]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(6000)]
    texts += ["ab cd " * 30_000 + mark + " ab cd" * 30_000 for mark in ("<|endoftext|>", " <|endoftext|> ", "\n<|endoftext|>")]
    enc = Encoder(tokenizer_path(NAME), 500)
    for a in range(0, len(texts), 700):
        ids, counts = enc.encode(texts[a : a + 700])
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in got] == [plain(t) for t in texts[a : a + 700]]
    assert any(50256 in plain(t) for t in texts)


def test_other_vocabularies_are_not_cut_at_words():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    want = Tokenizer.from_file(path)
    ids, counts = Encoder(path).encode(ODD[:8])
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [want.encode(t, add_special_tokens=False).ids for t in ODD[:8]]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 5000])
def test_perfect_hash_fills_every_slot_once(n):
    keys = np.random.default_rng(n).choice(np.int64(1) << 40, n, replace=False) - (1 << 39)
    made = token_store.PerfectHash.build(keys)
    assert sorted(made(keys).tolist()) == list(range(n))


def test_store_round_trip(spark, plain):
    docs = documents(spark)
    got = token_store.store_documents(docs).toPandas().sort_values("doc_id")
    want = docs.toPandas().sort_values("doc_id")
    ids = [ids_of(plain, t) for t in want["text"]]
    assert got["doc_id"].tolist() == want["doc_id"].tolist()
    assert got["n_tokens"].tolist() == [len(i) for i in ids]
    assert got["start"].tolist() == (np.cumsum([len(i) for i in ids]) - [len(i) for i in ids]).tolist()
    assert got["ids_crc32"].tolist() == [zlib.crc32(i.tobytes()) for i in ids]


def test_store_of_odd_rows(spark, plain):
    folder = new_folder(spark, "odd")
    docs = odd_docs(spark)
    manifest = token_store.write_store(docs, folder, shards=3)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(rows())
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in token_store.lookup(docs, folder).collect())
    want = sorted((r[0] is not None, r[0] or 0, len(ids_of(plain, r[1])), zlib.crc32(ids_of(plain, r[1]).tobytes())) for r in rows())
    assert got == want
    starts = sorted((r.start, r.n_tokens) for r in token_store.lookup(docs, folder).collect())
    assert [s for s, _ in starts] == (np.cumsum([n for _, n in starts]) - [n for _, n in starts]).tolist()
    absent = spark.createDataFrame([(k,) for k in range(1000, 1400)], "doc_id long")
    assert token_store.lookup(absent, folder).count() == 0
    assert token_store.get(spark, folder, 2) == [ids_of(plain, rows()[1][1]).tolist()]
    assert len(token_store.get(spark, folder, 8)) == 2 and token_store.get(spark, folder, -5) == [] and token_store.get(spark, folder, 5000) == []


def test_store_of_nothing(spark):
    assert token_store.store_documents(no_docs(spark)).count() == 0


def check_packed(packed):
    """Pieces tile their documents, and lie in their sequences without gaps."""
    seen = {}
    for (key, _), g in packed.groupby([packed["doc_id"].fillna(-1), packed["doc_id"].isna()]):
        seen[key] = g.sort_values("piece")
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (np.cumsum(g["length"]) - g["length"]).tolist() and g["length"].sum() <= 1024
    return seen


def test_packing_round_trip(spark, plain):
    docs = documents(spark)
    packed = residual_packing.pack_documents(docs).toPandas()
    texts = dict(docs.toPandas()[["doc_id", "text"]].itertuples(index=False))
    seen = check_packed(packed)
    assert set(seen) == set(texts)
    for key, g in seen.items():
        ids = ids_of(plain, texts[key])
        assert g["piece"].tolist() == list(range(len(g))) and g["length"].sum() == len(ids)
        assert g["start"].tolist() == (np.cumsum(g["length"]) - g["length"]).tolist() and (g["length"].iloc[1:] == 1024).all()
        assert g["ids_crc32"].tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g["start"], g["length"])]
    least = -(-packed["length"].sum() // 1024)
    assert packed["sequence_id"].nunique() <= 1.02 * least + 1


def test_packed_sequences_hold_the_ids(spark, plain):
    docs = documents(spark).filter("doc_id < 40")
    texts = dict(docs.toPandas()[["doc_id", "text"]].itertuples(index=False))
    placed = residual_packing.pack_documents(docs).cache()
    rows_ = {r["sequence_id"]: r["ids"] for r in residual_packing.sequences(placed, docs).collect()}
    for r in placed.collect():
        assert rows_[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids_of(plain, texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]].tolist()


def test_packing_of_odd_rows(spark, plain):
    packed = residual_packing.pack_documents(odd_docs(spark)).toPandas()
    check_packed(packed)
    assert packed["length"].sum() == sum(len(ids_of(plain, r[1])) for r in rows())
    assert packed["doc_id"].isna().sum() == 2
    assert residual_packing.pack_documents(no_docs(spark)).count() == 0


def test_best_fit_takes_the_fullest_bin():
    sizes = np.array([6, 5, 4, 3, 2])
    where = residual_packing.best_fit(sizes, 10)
    assert where[0] == where[2] and where[1] == where[3] == where[4]


@pytest.mark.parametrize("size, per_bin", [(600, 1), (512, 2), (1, 1024)])
def test_rounds_end_where_nothing_joins(spark, size, per_bin):
    n = 5000 if size > 1 else 3000
    pieces = spark.range(n, numPartitions=5).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", f"{size}L AS length", "0L AS ids_crc32")
    packed = residual_packing.pack(pieces)
    assert packed.count() == n and packed.select("sequence_id").distinct().count() == -(-n // per_bin)


def test_blocks_of_a_task_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(residual_packing, "TASK_ITEMS", 64)
    sizes = np.random.default_rng(3).integers(1, 1023, 2000)
    pieces = spark.createDataFrame([(i, 0, 0, int(s), 0) for i, s in enumerate(sizes)], residual_packing.PIECE)
    packed = residual_packing.pack(pieces).toPandas()
    check_packed(packed)
    assert sorted(packed["doc_id"]) == list(range(2000)) and packed["sequence_id"].nunique() <= 1.1 * sizes.sum() / 1024
