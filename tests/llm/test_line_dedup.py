import random

import duckdb
import numpy as np
import pytest

from bandwarden.llm import line_dedup as L
from bandwarden.llm import ngram_join as N

from . import brute


def lines_of(df):
    return {(r.doc_id, r.line) for r in df.collect()}


def texts(seed=2):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(3000)]
    pool = [rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 5, 6, 9, 20, 45, 70, 120])) for _ in range(40)]
    out = []
    for _ in range(150):
        lines = []
        for _ in range(rng.randint(1, 8)):
            own = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            lines.append((" " if rng.random() < .1 else "") + " ".join(own).swapcase() if rng.random() < .1 else " ".join(own))
        if rng.random() < .2:
            lines.insert(rng.randint(0, len(lines)), "  ")
        out.append("\n".join(lines))
    return [*out, None, "", "\n\n", out[0], "a\nA\na b\r\nA b"]


@pytest.mark.parametrize("block", [128, 8])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(L, "SPLIT", block)
    rows = [(d * 11 % 997, t) for d, t in enumerate(texts())]
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, line string, node int")
    assert lines_of(L.repeated_lines(docs)) == brute.repeated_lines(rows)


def test_driver_tables_and_report(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute.repeated_lines(rows)
    report = {r.doc_id: r for r in L.line_report(docs).collect()}
    assert {(d, i) for d, r in report.items() for i in r.removed} == want
    assert {d: r.n_lines for d, r in report.items()} == {d: len(t.split("\n")) if t else 0 for d, t in rows}
    kept = L.without_repeated_lines(docs)
    assert kept.columns == docs.columns
    expect = {}
    for d, t in rows:
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in want)
        if brute.words(left) or left == t:
            expect[d] = (left, len(left))
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == expect


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert L.line_report(empty).count() == 0 and L.without_repeated_lines(empty).count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x y"), (3, "x y"), (4, "X Y\nz")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.removed) for r in L.line_report(docs).collect())
    assert got == [(1, 0, []), (2, 0, []), (3, 1, []), (3, 1, []), (4, 2, [0])]
    assert sorted((r.doc_id, r.text) for r in L.without_repeated_lines(docs).select("doc_id", "text").fillna("-").collect()) == [
        (1, "-"), (2, ""), (3, "x y"), (3, "x y"), (4, "z")]


def test_null_ids_come_last_and_are_answered(spark):
    import hashlib
    rows = [(d if d % 3 else None, t) for d, t in enumerate(texts(4))]
    late = sorted({t or "" for d, t in rows if d is None}, key=lambda t: hashlib.md5(f"? {t}".encode()).digest())
    of = {t: 10000 + i for i, t in enumerate(late)}
    whole = lambda d, t: of[t or ""] if d is None else d
    want = brute.repeated_lines(list({whole(d, t): (whole(d, t), t) for d, t in rows}.values()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expect = [(d, [i for i in range(len((t or "").split("\n"))) if (whole(d, t), i) in want]) for d, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.removed) for r in L.line_report(docs).collect()], key=key) == sorted(expect, key=key)
    left = []
    for (d, t), (_, gone) in zip(rows, expect):
        kept = t if not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        if not gone or brute.words(kept):
            left.append((d, kept or ""))
    assert sorted([(r.doc_id, r.text or "") for r in L.without_repeated_lines(docs).collect()], key=key) == sorted(left, key=key)


def test_filters_never_lose_a_match():
    """Rare prefixes as the operator makes them: repeated tokens of the hash-order prefix, some shared beyond it."""
    rng = np.random.default_rng(8)
    hits = 0
    for _ in range(600):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(.7, 1)], rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 5)), dtype=np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        linked = 100 * both >= 80 * (len(a) + len(b) - both)
        prefixes = [x[:int(L.prefix_length(len(x)))] for x in (a, b)]
        sets = {int(t): int(rng.integers(2, 9)) for t in np.concatenate(prefixes)}
        shared = set(np.intersect1d(*prefixes).tolist()) | {t for t in sets if rng.random() < .1}
        rare = []
        for x, prefix in zip((a, b), prefixes):
            mine = sorted((sets[int(t)], int(t)) for t in prefix if int(t) in shared)
            need = int(L.needed(L.shared_least(len(x))))
            rows = [(s, t, len(prefix) - len(mine) + i) for i, (s, t) in enumerate(mine)][:max(0, len(mine) - need + 1)]
            rare.append(np.array(rows, np.int64).reshape(-1, 3))
        found = all(map(len, rare)) and bool(L.block_matches([a, b], rare, np.array([0, 0]), False).any())
        assert found == linked
        hits += linked
    assert hits > 150


def test_matches_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    want = sorted(con.sql(f"SELECT doc_id, n_lines, n_removed, removed FROM ({L.ORACLE})").fetchall())
    got = sorted((r.doc_id, r.n_lines, r.n_removed, ",".join(map(str, r.removed))) for r in L.line_report(spark.read.parquet(path)).collect())
    assert got == want


def test_texts_that_share_an_id_lose_only_their_own_lines(spark):
    line = "one two three four five six"
    rows = [(1, line), (5, line + "\nq w e r t y u"), (5, "UNIQUE line that nobody else has here\nr t y u i o p"), (5, line + "\nq w e r t y u")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line string")
    got = sorted((r["doc_id"], r["n_lines"], r["n_removed"], tuple(r["removed"])) for r in L.line_report(docs).collect())
    assert got == [(1, 1, 0, ()), (5, 2, 0, ()), (5, 2, 1, (0,)), (5, 2, 1, (0,))]
    kept = sorted(r["text"] for r in L.without_repeated_lines(docs).collect())
    assert kept == sorted([line, "q w e r t y u", "q w e r t y u", "UNIQUE line that nobody else has here\nr t y u i o p"])


def test_first_filter_ships_one_row_a_range_and_two_records_a_token():
    """800 different lines share their first words; a line of each text is repeated."""
    import pyarrow as pa
    rows = [(d, f"a b c d e f g h x{d}\nsame words in every text here\nk l m n o p{d % 7}") for d in range(800)]
    batch = pa.record_batch([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows]), pa.array([d.to_bytes(16, "big") for d, _ in rows])],
                            names=["doc_id", "text", "row"])
    blocks = list(L._line_blocks(4)(batch))
    assert [len(b) for b in blocks] == [4]
    table = pa.Table.from_batches(blocks)
    tokens, hits, lines, repeats = (L._records(table, c, kind) for c, kind in (("tokens", L.TOKEN), ("hits", L.TOKEN), ("lines", L.LINE), ("repeats", L.LINE)))
    assert np.unique(tokens["token"], return_counts=True)[1].max() == 2
    assert len(hits) >= 798 and set(hits["token"]) <= set(tokens["token"])
    assert (len(lines), len(repeats)) == (800 + 1 + 7, 799 + 793)
    found = L._settled(2)(table)
    assert {(r["doc_id"], r["line"]) for r in found.to_pylist() if r["gone"]} == {(d, 1) for d in range(1, 800)} | {(d, 2) for d in range(7, 800)}
    shared = L._records(found.filter(pa.compute.is_valid(found["part"])), "hits", L.TOKEN)
    assert len(set(shared["key"][np.isin(shared["token"], hits["token"])])) >= 800


@pytest.mark.parametrize("listed", [1, 3, 24])
def test_first_shared_is_that_of_pairs_one_by_one(monkeypatch, listed):
    monkeypatch.setattr(L, "_RUN", listed)
    rng = np.random.default_rng(5)
    for _ in range(40):
        sizes = rng.integers(1, 40, 30)
        sets_of = rng.integers(2, 6, 60)
        rare = [np.array(sorted((int(sets_of[t]), int(t), int(rng.integers(0, 12))) for t in rng.choice(60, rng.integers(1, 9), False)), np.int64) for _ in sizes]
        need, want = L.needed(sizes), np.zeros((30, 30), bool)
        for i in range(30):
            for j in range(i + 1, 30):
                a, b = ({(s, t): p for s, t, p in rare[x].tolist()} for x in (i, j))
                both = sorted(set(a) & set(b))
                if both:
                    room = min(L.prefix_length(sizes[i]) - a[both[0]], L.prefix_length(sizes[j]) - b[both[0]])
                    want[i, j] = room >= min(need[i], need[j])
        assert (L.first_shared(rare, sizes) == want).all()
