import math
import re
from collections import Counter

import duckdb
import numpy as np

from bandwarden.llm import impact_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def found(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, top=10):
    counted = [(d, Counter(found(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    total, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(found(t))
    out = []
    for i, mine in terms.items():
        scores = []
        for d, c in counted:
            m = 10 + (90 * sum(c.values()) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in mine if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({S.ORACLE})").fetchall()
    assert rows(S.op11_impact_search(spark, "/root/testdata/sf0.01")) == sorted(want, key=str)


def fixture():
    rng = np.random.default_rng(4)
    words = ["The", "the", "ñandú", "Ñandú", "x1", "99", "zeta", "rare", "a_b", "naïve", "ÉTÉ", "q"]
    text = lambda n: " ".join(rng.choice(words, n, p=[.3, .2] + [.05] * 10)) + "\x00!\t-end"
    docs = [(int(i), text(int(rng.integers(1, 40)))) for i in rng.permutation(300)]
    docs += [(7, docs[0][1]), (None, docs[1][1]), (None, docs[1][1]), (900, None), (901, ""), (902, " .,-"), (10 ** 15, "rare"), (903, "zeta " * 30000)]
    docs += [(1000 + i, "tie tie here") for i in range(40)]
    items = [(1, "the rare zeta"), (2, None), (3, ""), (4, "tie"), (5, "ÉTÉ naïve"), (5, "x1"), (None, "ñandú b"), (8, "absent")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(*r, "s", 1) for r in docs], "doc_id long, text string, score string, rank int").repartition(5),
            spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, doc_id int"))


def test_ties_nulls_repeated_ids_and_extra_columns(spark):
    docs, items = fixture()
    assert rows(S.ranked_documents(*frames(spark, docs, items))) == brute(docs, items)


def test_small_tiles_panels_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "PANEL", 3)
    monkeypatch.setattr(S, "ITEMS", 2)
    monkeypatch.setattr(S, "DOCUMENTS", 7)
    monkeypatch.setattr(S, "COLUMNS", 1)
    docs, items = fixture()
    d, i = frames(spark, docs, items)
    assert rows(S.ranked_documents(d.coalesce(1), i, top=3)) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = frames(spark, *fixture())
    assert S.ranked_documents(docs.where("false"), items).count() == 0
    assert S.ranked_documents(docs, items.where("false")).count() == 0


def test_no_block_can_leave_the_exact_range():
    rng = np.random.default_rng(0)
    row, column = np.divmod(np.flatnonzero(rng.random((20, 400)) < .5), 400)
    weight = rng.integers(0, 30000, len(row))
    limit = 10 ** 12
    cuts = S.column_blocks(row, column, weight, 400, limit)
    assert cuts[0] == 0 and cuts[-1] == 400 and (np.diff(cuts) > 0).all() and len(cuts) > 3
    for a, e in zip(cuts[:-1], cuts[1:]):
        part = (column >= a) & (column < e)
        assert np.bincount(row[part], weight[part] * S.IMPACT).max() < limit
