import os
import random

import numpy as np
import pyarrow as pa
import pytest

from bandwarden.llm import ngram_join as N
from bandwarden.llm.words import slices

from . import brute


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def varied(seed=5, families=12):
    """Families of copies and edited copies, chains included, that also share a passage."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    passage = rng.choices(vocab, k=18)
    texts = []
    for _ in range(families):
        base = rng.choices(vocab, k=rng.randint(3, 160))
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 30)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            if rng.random() < .3:
                own = own[:len(own) // 2] + passage + own[len(own) // 2:]
            if rng.random() < .1:
                own = [w.upper() for w in own]
            texts.append("\n".join([" ".join(own[:7]), "  ".join(own[7:])]))
    return texts


def test_words_as_bytes_match_the_pattern():
    texts = ["", "a", " a\tb\x0bc ", "été x y", "\n\n", "A" * 10, "x  "] * 3
    for limit in (1, 5, 1000):
        got = []
        for s in slices(pa.array([None, *texts]), limit):
            raw = bytes(s.data)
            for r in range(s.rows):
                got.append([raw[a:b].decode() for a, b in zip(s.starts[s.bounds[r]:s.bounds[r + 1]], s.ends[s.bounds[r]:s.bounds[r + 1]])])
        assert got == [brute.words(t) for t in [None, *texts]]


def test_matches_brute_force(spark):
    texts = varied()
    rows = list(enumerate([*texts, None, "", " \n", "one", "One", "one two", *texts[:3]]))
    rows = [(d * 7 % 1009, t) for d, t in rows]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, token string, node int")
    assert rows_of(N.near_duplicates(docs)) == brute.jaccard_components(rows)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = list(enumerate(varied(9, 6)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(N.near_duplicates(docs)) == brute.jaccard_components(rows)


def test_driver_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(N.near_duplicates(docs)) == brute.jaccard_components(rows)


def test_empty_table_repeated_rows_and_one_id_with_two_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(empty).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "q"), (3, "r"), (4, "r")]
    got = rows_of(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute.jaccard_components(rows)


def test_null_ids_link_like_any_others(spark):
    rows = list(enumerate(varied(11, 8)))
    schema = "doc_id long, text string"
    some = [(d, t, d if d % 3 else None) for d, t in rows]
    group = {d: c for d, _, c in brute.jaccard_components(rows)}
    named = {c: min((d for d, _, own in some if own is not None and group[d] == c), default=None) for c in group.values()}
    size = {d: n for d, n, _ in brute.jaccard_components(rows)}
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [tuple(r) for r in N.near_duplicates(spark.createDataFrame([(own, t) for _, t, own in some], schema)).collect()]
    assert sorted(got, key=key) == sorted([(own, size[d], named[group[d]]) for d, _, own in some], key=key)


def test_filters_never_lose_a_linked_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(.75, 1)],
                                      rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 6)), dtype=np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        linked = 100 * both >= 80 * (len(a) + len(b) - both)
        prefix = [x[:int(N.prefix_length(len(x)))] for x in (a, b)]
        found = N.block_links([a, b], prefix, np.array([0, 0]), False)
        assert bool(found) == linked


def test_a_large_group_ships_texts_in_proportion(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = random.Random(21)
    base = rng.choices([f"w{i}" for i in range(4000)], k=120)
    rows = []
    for d in range(240):
        own = list(base)
        own[rng.randrange(len(own))] = f"x{d}"
        rows.append((d, " ".join(own)))
    compare, folder = N._links_of_group, str(tmp_path)

    def counted(frame):
        import uuid
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(frame)))
        return compare(frame)

    monkeypatch.setattr(N, "_links_of_group", counted)
    assert rows_of(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.jaccard_components(rows)
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) <= 4 * len(rows)


def test_chains_over_many_blocks_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    rng = random.Random(22)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(900)]
    rows = [(d * 7 % 61, " ".join(words[12 * d:12 * d + 180])) for d in range(60)]
    assert len({c for _, _, c in brute.jaccard_components(rows)}) == 1
    assert rows_of(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.jaccard_components(rows)


def test_tables_do_not_hold_tokens_that_nobody_shares(spark, monkeypatch):
    rng = random.Random(23)
    texts = [" ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(300)) for _ in range(200)]
    sizes, write = [], N.written

    def sized(df):
        out = write(df)
        sizes.append(sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(N, "written", sized)
    docs = spark.createDataFrame(list(enumerate([*texts, *texts])), "doc_id long, text string").coalesce(1)
    assert N.near_duplicates(docs).select("component_id").distinct().count() == len(texts)
    assert sum(sizes) < 0.1 * sum(map(len, texts))


def test_a_linked_pair_shares_a_rarest_token(spark):
    rows = [(d, t) for d, t in enumerate(varied(31, 10)) if brute.words(t)]
    texts = {}
    for d, t in rows:
        s = next(slices(pa.array([t])))
        tokens = N.shingle_sets(s)[0]
        texts.setdefault(N.node_of(tokens), (int(N.key_of(np.frombuffer(N.node_of(tokens), np.uint8).reshape(1, 16)).view(np.int64)[0]), tokens, t))
    frame = spark.createDataFrame([(k, len(s), t) for k, s, t in texts.values()], "key long, n long, text string")
    rare = {r.key: set(r.rare) for r in N._rare_tokens(frame, 3).collect()}
    sets = [(k, set(s.tolist())) for k, s, _ in texts.values()]
    linked = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if 100 * len(x & y) >= 80 * len(x | y)]
    assert linked and all(rare[a] & rare[b] for a, b in linked)


@pytest.mark.parametrize("n", [1, 2, 31, 40, 41, 500, 640, 641, 20000])
def test_need_is_monotone(n):
    assert N.needed(n) <= N.needed(n + 1) and N.needed(n) <= N.shared_least(n) and N.prefix_length(n) <= n
