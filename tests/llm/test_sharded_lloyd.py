import hashlib

import duckdb
import numpy as np
import pytest

from bandwarden.llm import sharded_lloyd as L

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, dims, k, rounds):
    kept = [(i, [int(np.floor(1024 * np.float64(x))) for x in e]) for i, e in rows
            if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    if not kept:
        return []
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cen = [list(v) for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cen))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, g in groups.items():
            cen[n] = [sum(col) // len(g) for col in zip(*g)]
    last = [(i, *near(v)) for i, v in kept]
    total, part = sum(d for _, d, _ in last), {}
    for _, d, n in last:
        part[n] = part.get(n, 0) + d
    return sorted(((i, n, d, part[n], total, hashlib.sha256(",".join(map(str, cen[n])).encode()).hexdigest()) for i, d, n in last), key=str)


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def test_matches_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({L.ORACLE})").fetchall()
    assert rows_of(L.op12_sharded_lloyd(spark, "/root/testdata/sf0.001")) == sorted(want, key=str)


def test_odd_rows_ties_and_uneven_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 7)
    monkeypatch.setattr(L, "CHUNKS", 2)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 5) / 512]) for i in rng.choice(5000, 90, False)]
    rows += [rows[0], rows[0], (rows[1][0], [0.1] * 5), (None, [0.2] * 5), (None, [0.2] * 5), (1, None), (2, []), (3, [1.0] * 4),
             (4, [None] + [1.0] * 4), (5, [float("nan")] * 5), (6, [float("-inf")] * 5), (10 ** 15, [9.0, -9.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(4)
    for k in (1, 4):
        assert rows_of(L.clustered(df, k=k, rounds=3, dimensions=5, width=2)) == brute(rows, 5, k, 3)


def test_empty_centroids_stay_and_few_rows(spark):
    rows = [(i, [0.5, 0.5]) for i in range(6)] + [(9, [0.25, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert rows_of(L.clustered(df, k=5, rounds=2, dimensions=2)) == brute(rows, 2, 5, 2)
    assert rows_of(L.clustered(df.limit(2), k=5, rounds=2, dimensions=2)) == brute(rows[:2], 2, 5, 2)
    assert L.clustered(df.where("false")).count() == 0


def test_large_components(spark):
    rows = [(0, [130000.0, -131071.0]), (1, [-131071.9, 131071.5]), (2, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(L.clustered(df, k=2, rounds=2, dimensions=2)) == brute(rows, 2, 2, 2)
    with pytest.raises(Exception, match="134217728 or more"):
        L.clustered(spark.createDataFrame([(0, [1e300, 0.0])], "vec_id long, embedding array<double>"), dimensions=2).count()


def test_shards_do_not_move_after_the_first_deal(spark):
    df = spark.createDataFrame([(i, [i / 100, -i / 50]) for i in range(50)], "vec_id long, embedding array<double>")
    shards = L.Shards(L.written(L.shards_of(L.integer_vectors(df, 2, 1024), 2, 1)), 2, 1)
    names = shards._dealt(shards.nearest([np.zeros((1, 1), np.int64)] * 2).map(lambda x: ((0, x[0]), x[1][0])))
    both = names.union(shards.rdd)
    assert both.getNumPartitions() == shards.rdd.getNumPartitions()
    blocks = shards.rdd.mapPartitions(lambda p: [{key[0] for key, _ in p}]).collect()
    assert all(len(b) <= 1 for b in blocks)
