import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bandwarden.llm import mixing as M
from bandwarden.llm import packing as P

from . import brute

ODD = ["a<|endoftext|>b İx Σας ŉ it's 12ab3 日本語 é \x1c x y <|ENDOFTEXT|> ́z ½ ×÷ don'T", "", None, " \n", "x" * 5000]


def check_pieces(rows, texts):
    """Pieces cover each row's ids once, sequences have no gaps, and limits hold."""
    tk = Tokenizer.from_file(P.tokenizer_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids = np.array([*tk.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= P.TOKENS and len(pieces) <= P.SEGMENTS and sum(r.loss_tokens for r in pieces) <= P.LOSS_TOKENS
    return len(by_seq)


def test_packs_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()} | {10_000 + i: t for i, t in enumerate(ODD)}
    table = spark.createDataFrame([(d, t, 1, 2) for d, t in texts.items()], "doc_id long, text string, tokens int, offset int")
    rows = P.pack_documents(table).collect()
    used = check_pieces(rows, texts)
    total = sum(r.length for r in rows)
    assert used <= -(-total // P.TOKENS) + 1


def test_pack_empty_and_repeated_rows(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = P.pack_documents(spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")).collect()
    assert len(rows) == 2 and sorted(r.offset for r in rows) == [0, 3]


def test_null_ids_and_repeated_rows_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP", 50)
    rows = [(None, f"word {i}") for i in range(300)] + [(7, "a b")] * 300
    got = P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = defaultdict(int)
    for r in got:
        groups[r.sequence_id >> 32] += 1
    assert len(got) == 600 and max(groups.values()) <= 2 * P.GROUP


def test_place_keeps_every_limit():
    rng = np.random.default_rng(1)
    demand = np.stack([rng.integers(1, 900, 800), rng.integers(1, 12, 800), rng.integers(0, 500, 800)], 1)
    demand[5] = (5000, 1, 1)
    limits = np.array([1000, 16, 600])
    seq, off = P.place(demand, limits)
    for s in np.unique(seq):
        mine = demand[seq == s]
        assert len(mine) == 1 or (mine.sum(0) <= limits).all()
        assert sorted(off[seq == s]) == list(np.cumsum([0, *mine[np.argsort(off[seq == s])][:-1, 0]]))


def test_mixing_matches_sql(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", 50)
    monkeypatch.setattr(M, "SHARD_WORDS", 3000)
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = sorted(con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({M.ORACLE})").fetchall())
    assert sorted(tuple(r) for r in M.taken_words(docs).collect()) == want
    placed, pieces = M.mix_sources(docs)
    rows = pieces.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix_sources(docs)[1].collect()))
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in shards.values())
    assert len({(r.source_key, r.block) for r in rows}) == len({(r.source_key, r.block, r.shard) for r in rows})
    taken = defaultdict(int)
    for r in rows:
        taken[r.source_key] += r.n_words
    for r in placed.select("source_key", "target").distinct().collect():
        assert abs(taken[r.source_key] - r.target) <= 0.5


def test_mixing_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int"
    rows = [(1, "a b c", "x", "s", 5, 0), (1, "a b c", "x", "s", 5, 0), (2, None, None, None, None, 0), (3, "", "x", None, 0, 0),
            (4, "q " * 50, "x", None, 100, 0), (5, "one", "x", "t", 3, 0)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in M.taken_words(docs).collect())
    assert [g[:3] for g in got] == [(1, 3, 6), (1, 3, 6), (2, 0, 50), (3, 0, 50), (4, 50, 50), (5, 1, 1)]
    assert all(t <= 3 * s for _, s, _, _, t in got)
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(brute.words(r.text)) for r in mixed.collect()) == sum(g[4] for g in got)
    assert M.taken_words(docs.where("false")).count() == 0 and M.mixed_documents(docs.where("false")).count() == 0


@pytest.mark.parametrize("shards", [1, 2, 7])
def test_tree_leaves_nothing_over(shards):
    quotas = np.array([5, 0, 13, 100])
    parts = [M.split_quotas(quotas, shards, s, 3) for s in range(shards)]
    assert (sum(h for _, h in parts) == quotas).all()
    at = np.zeros_like(quotas)
    for first, held in parts:
        assert (first == at).all()
        at = at + held
    assert sorted(M.block_of_slot(i, 100, 7) for i in range(100)) == list(range(100))


def test_mixing_rows_that_share_or_lack_an_id(spark):
    rows = [(None, f"n{i} a b c", "s") for i in range(40)] + [(3, "x y z w", "s"), (3, "p q r t", "s"), (4, None, "t"), (5, "m n o p", None), (3, "x y z w", "s")]
    docs = spark.createDataFrame([(*r, 4, "c", "k") for r in rows], "doc_id long, text string, source string, n_chars int, copy string, key string")
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns and {(r["copy"], r["key"]) for r in mixed.collect()} == {("c", "k")}
    taken = M.taken_words(docs)
    assert taken.count() == len(rows)
    words = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert words == taken.agg(F.sum("taken")).first()[0]
    texts = sorted((r["doc_id"], r["text"]) for r in mixed.where("doc_id = 3").collect())
    passes = len(texts) // 3
    assert {t for _, t in texts} <= {"x y z w", "p q r t", *[" ".join(t.split()[:k]) for t in ("x y z w", "p q r t") for k in range(1, 4)]} and passes >= 1
    buckets = M.stream_positions(docs).where("doc_id IS NULL").select("begin").distinct().count()
    assert buckets == 40


def test_blocks_grow_before_the_draws_overflow(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", 2)
    monkeypatch.setattr(M, "MOST_BLOCKS", 3)
    docs = spark.createDataFrame([(i, "a b c d e", "s") for i in range(20)], "doc_id long, text string, source string")
    _, pieces = M.mix_sources(docs)
    assert pieces.select("block").distinct().count() <= 3 and pieces.agg(F.sum("n_words")).first()[0] == 100


def test_words_are_spelled_together_as_the_tokenizer_spells_them():
    encoder = P.WordEncoder(P.tokenizer_path())
    calls, runs = [], encoder.runs
    encoder.runs = lambda text: calls.append(text) or runs(text)
    texts = [*(t or "" for t in ODD), "don't\n's 'S x'll\nA1b22\n--a!? Été naïve’s \x7f \x01a <|", "a" * 300 + " 'd\x0b'm", "日本 ---\n..."]
    tk = Tokenizer.from_file(P.tokenizer_path())
    for _ in range(2):
        got = encoder.texts([t.encode() for t in texts])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tk.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) == 1


def test_worker_forgets_words_when_it_is_given_other_work():
    import pyarrow as pa
    from bandwarden.llm.tables import batches, worker_memory
    path = P.tokenizer_path()
    encoder = P.worker_encoder(path)
    encoder.texts([b"some words to keep"])
    assert P.worker_encoder(path) is encoder and encoder.known
    batch = pa.record_batch([pa.array([1])], names=["x"])
    assert list(batches(lambda b: iter([b]))(iter([batch, batch]))) == [batch, batch]
    assert not worker_memory and P.worker_encoder(path) is not encoder
