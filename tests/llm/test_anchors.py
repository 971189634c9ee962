import random

from bandwarden.llm import anchors as A

from . import brute


def test_cover_meets_every_difference():
    d = {(a - b) % A.PERIOD for a in A.COVER for b in A.COVER}
    assert d == set(range(A.PERIOD))


def planted():
    rng = random.Random(4)
    vocab = [f"u{i}" for i in range(5000)]
    passages = [rng.choices(vocab, k=n) for n in (19, 20, 21, 33, 60, 200)]
    texts = []
    for _ in range(120):
        own = rng.choices(vocab, k=rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 19)
            at = rng.randint(0, len(own))
            own[at:at] = p[a:a + rng.randint(19, len(p))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(own))
    return [*texts, None, "", *texts[3:9], "q " * 90, "q " * 30, " ".join(["Q"] * 19), "x y " * 40]


def test_matches_brute_force(spark):
    rows = [(d * 13 % 1009, t) for d, t in enumerate(planted())]
    docs = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, part int, identity string")
    assert sorted(map(tuple, A.remove_repeats(docs).collect())) == brute.repeats_removed(rows)


def test_driver_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, A.remove_repeats(docs).collect())) == brute.repeats_removed(rows)


def test_empty_repeated_rows_and_one_id_with_two_texts(spark):
    schema = "doc_id long, text string"
    assert A.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{i}" for i in range(25))
    rows = [(5, long), (5, long), (6, long), (7, long + " tail"), (7, "head " + long), (8, "short text")]
    got = sorted(tuple(r)[:3] for r in A.remove_repeats(spark.createDataFrame(rows, schema)).collect())
    assert got == [(5, 25, 0), (5, 25, 0), (6, 25, 25), (7, 26, 25), (7, 26, 25), (8, 2, 0)]


def test_ids_that_are_shared_or_missing(spark):
    long = [f"w{i}" for i in range(360)]
    shared = long[100:160]
    short = " ".join(f"s{i}" for i in range(22))
    rows = [(1, " ".join(long)), (5, " ".join(["a"] + long[:300])), (5, short), (None, "n1 " + " ".join(shared)), (None, "n2 " + " ".join(shared)),
            (None, short), (9, "tail " + " ".join(shared[:30]))]
    docs = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, start int, row binary")
    got = sorted((tuple(r)[:3] for r in A.remove_repeats(docs).collect()), key=str)
    assert got == sorted([(1, 360, 0), (5, 301, 300), (5, 22, 0), (None, 61, 60), (None, 61, 60), (None, 22, 22), (9, 31, 30)], key=str)
    only = spark.createDataFrame([(None, "n1 " + " ".join(shared)), (None, "n2 " + " ".join(shared))], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in A.remove_repeats(only).collect()) == [0, 60]
