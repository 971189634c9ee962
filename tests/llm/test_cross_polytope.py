import duckdb
import numpy as np
import pytest

from bandwarden.llm import cross_polytope as C


def brute(rows, threshold=0.95):
    good = [i for i, (_, e) in enumerate(rows) if e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    link = {i: set() for i in range(len(rows))}
    unit = {i: C.unit_rows(np.array([rows[i][1]], float))[0] for i in good}
    for i in good:
        for j in good:
            if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                link[i].add(j)
                link[j].add(i)
    out = []
    for i, (vec, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec, len(link[i]), least, vec == least))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, b"k") for r in rows], "vec_id long, embedding array<double>, label int, key binary").repartition(3)


def near(rng, centre, cosine, n):
    """Vectors at the given cosine from a unit vector."""
    u = rng.normal(size=(n, len(centre)))
    u -= (u @ centre)[:, None] * centre
    return cosine * centre + np.sqrt(1 - cosine ** 2) * C.unit_rows(u)


def test_matches_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.01/embeddings.parquet')")
    want = con.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({C.ORACLE})").fetchall()
    assert rows_of(C.op13_cross_polytope(spark, "/root/testdata/sf0.01")) == sorted(want, key=str)


def fixture():
    rng = np.random.default_rng(6)
    rows = [(int(i), x.tolist()) for i, x in zip(rng.permutation(300), rng.normal(size=(300, 24)))]
    for g in range(6):
        centre = C.unit_rows(rng.normal(size=(1, 24)))[0]
        rows += [(1000 + 100 * g + i, (x * 10.0 ** (g - 3)).tolist()) for i, x in enumerate(near(rng, centre, 0.999, 12))]
    rows += [(2000 + i, rows[3][1]) for i in range(40)] + [(rows[5][0], rows[9][1]), (None, rows[3][1]), (None, [1.0] * 24), (None, [1.0] * 24)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [None] * 24), (3004, [float("nan")] * 24), (3005, [1e300] * 24),
             (3006, [1e-320, 0.0]), (3007, [5.0, 0.0]), (3008, [-5.0, 0.0]), (3009, [2.0]), (3010, [3.0]), (-7, [4.0]), (10 ** 15, [1.0, 1e-9])]
    return rows


def test_matches_brute_force_on_odd_rows(spark):
    rows = fixture()
    assert rows_of(C.near_duplicate_vectors(frame(spark, rows))) == brute(rows)


def test_split_buckets_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 3)
    monkeypatch.setattr(C, "BUFFER", 10)
    monkeypatch.setattr(C, "HITS", 5)
    rows = fixture()
    assert rows_of(C.near_duplicate_vectors(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert C.near_duplicate_vectors(frame(spark, fixture()).where("false")).count() == 0


@pytest.mark.parametrize("count", [10 ** 3, 10 ** 6, 10 ** 9])
def test_recall_right_at_the_threshold(count):
    rng = np.random.default_rng(8)
    a = C.unit_rows(rng.normal(size=(1500, 64)))
    b = np.stack([near(rng, x, 0.95, 1)[0] for x in a])
    plan = C.planned(count, 64)
    met = C.meeting(plan.buckets(a), plan.buckets(b)) != np.iinfo(np.int64).max
    assert met.mean() >= 0.95
    strangers = C.meeting(plan.buckets(a), plan.buckets(np.roll(a, 1, 0))) != np.iinfo(np.int64).max
    assert strangers.mean() < 0.05


def test_transform_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose((C.hadamard(x) ** 2).sum(1), 32 * (x ** 2).sum(1))
    assert np.allclose(C.hadamard(C.hadamard(x)), 32 * x)
