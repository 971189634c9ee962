from collections import Counter

import numpy as np

import corpus_pipeline
from bandwarden.llm import mixing as M
from bandwarden.llm import quality_fm as Q
from bandwarden.llm.tables import written

from . import brute

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_does_its_work_on_all_its_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("token", Q.F.lit(1))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    tables, found = [docs], {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, tables[-1], FOLDER))
        if name != names[-1]:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        tables.append(out)
        found[name] = [r.asDict() for r in out.collect()]
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    scores = Q.score(docs, Q.train(docs, labels)).collect()
    assert {r["doc_id"] for r in found[names[0]]} == {r.doc_id for r in scores if r.predicted}
    good = labels.where("quality = 1").join(docs, "doc_id").count()
    assert len({r["doc_id"] for r in found[names[0]]} & {r.doc_id for r in labels.where("quality = 1").collect()}) > .95 * good

    before, gone, want = rows(tables[1]), brute.repeated_lines(rows(tables[1])), {}
    for d, t in before:
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        if brute.words(left) or left == t:
            want[d] = left
    assert {r["doc_id"]: r["text"] for r in found[names[1]]} == want and all(r["n_chars"] == len(r["text"]) for r in found[names[1]])

    groups = brute.jaccard_components(rows(tables[2]))
    assert sorted(r["doc_id"] for r in found[names[2]]) == sorted(d for d, _, c in groups if d == c)

    taken = {r.doc_id: r.taken for r in M.taken_words(tables[3]).collect()}
    words = Counter()
    for r in found[names[3]]:
        words[r["doc_id"]] += len(brute.words(r["text"]))
    assert all(words[d] == n for d, n in taken.items())

    pieces = [type("P", (), r) for r in found[names[4]]]
    total = sum(p.length for p in pieces)
    assert sum(len(brute.words(r["text"])) > 0 for r in found[names[3]]) == sum(p.start == 0 for p in pieces)
    assert len({p.sequence_id for p in pieces}) <= -(-total // 4096) + 1
    assert np.all([p.length <= 4096 for p in pieces])


def test_run_and_empty_table(spark, tmp_path):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.count() > 100 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER))
    assert docs.count() == 0


def test_near_duplicates_keep_texts_that_share_an_id(spark):
    a, b, d = "a b c d e f", "u v w x y z", "k l m n o p"
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (2, b, "s"), (None, a, "s"), (None, d, "s"), (None, d, "s"), (None, "g h", "s"), (None, None, "s"), (3, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (2, b), (None, d), (None, "g h"), (None, None), (3, "")], key=repr)
