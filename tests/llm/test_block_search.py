import duckdb
import numpy as np

from bandwarden.llm import block_search as B
from pyspark.sql import functions as F


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def brute(rows, every):
    v = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        x = [int(np.floor(64 * np.float64(np.float32(y)))) for y in e]
        v[i] = min(v.get(i, x), x)
    out = []
    for q in v:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[d])), d) for d in v if d != q)[:B.TOP]
            out += [(q, r + 1, d, -x) for r, (x, d) in enumerate(s)]
    return sorted(out)


def test_matches_sql(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}')")
    want = sorted(con.sql(f"SELECT query_id, rank, vec_id, score FROM ({B.ORACLE})").fetchall())
    got = rows_of(B.top_by_inner_product(spark.read.parquet(path), F.col("vec_id") % B.EVERY == 0))
    assert got == want


def test_ties_odd_rows_and_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(B, "RANGE", 40)
    monkeypatch.setattr(B, "BLOCK", 4)
    monkeypatch.setattr(B, "QUERIES", 7)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in rng.integers(-3, 4, 6) / 16]) for i in rng.choice(900, 300, False)]
    rows += [(1000, None), (1005, [None, 1.0]), (1010, [float("nan")] * 6), (1015, [float("inf")] * 6), (1020, []), (1025, [.5, .5]),
             (None, [1.0] * 6), rows[0], (rows[1][0], [0.0] * 6)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, score int")
    assert rows_of(B.top_by_inner_product(df, F.col("vec_id") % 5 == 0)) == brute(rows, 5)
    few = [(0, [1.0]), (5, [2.0]), (6, [1.0])]
    assert rows_of(B.top_by_inner_product(spark.createDataFrame(few, "vec_id long, embedding array<float>"), F.col("vec_id") % 5 == 0)) == brute(few, 5)
    assert B.top_by_inner_product(df.where("false"), F.col("vec_id") % 5 == 0).count() == 0


def test_an_outlying_id_does_not_fill_a_range(spark, monkeypatch):
    monkeypatch.setattr(B, "RANGE", 40)
    meet, most = B._meet, []

    def spy(queries, docs):
        most.append(docs.groupBy("query_group", "range").count().agg(F.max("count")).first()[0])
        return meet(queries, docs)

    monkeypatch.setattr(B, "_meet", spy)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 16]) for i in [*range(200), 10 ** 15]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert rows_of(B.top_by_inner_product(df, F.col("vec_id") % 5 == 0)) == brute(rows, 5)
    assert max(most) <= 2 * B.RANGE


def test_bounds_prune_blocks():
    rng = np.random.default_rng(0)
    centres = rng.integers(-40, 40, (32, 16))
    v = np.repeat(centres, 64, 0) + rng.integers(-2, 3, (2048, 16))
    ids = rng.permutation(2048)
    q = v[:50]
    *found, scored = B.search_range(ids, v, ids[:50], q, np.full(50, B.LOWEST))
    assert scored < 50 * 32 / 2
    s = q @ v.T
    for k in range(50):
        want = sorted((-s[k, j], ids[j]) for j in range(2048) if j != k)[:20]
        assert sorted(zip(-found[2][found[0] == ids[k]], found[1][found[0] == ids[k]])) == want
