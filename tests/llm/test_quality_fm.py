import numpy as np
import pyarrow as pa

from bandwarden.llm import quality_fm as Q
from bandwarden.llm.words import slices


def test_linear_time_score_equals_all_pairs():
    words = next(slices(pa.array(["a b c a ### |", "", "The end.\nThe end."])))
    x = Q.features(words, np.array([12, -1, 17]))
    m = Q.Machine(3)
    m.weights[:, 0] = np.random.default_rng(0).normal(size=len(m.weights))
    got = m.score(x)
    for r in range(3):
        f, v = (a[x.bounds[r]:x.bounds[r + 1]] for a in (x.feature, x.value))
        z = m.bias + (m.weights[f, 0] * v).sum()
        z += sum(m.weights[f[i], 1:] @ m.weights[f[j], 1:] * v[i] * v[j] for i in range(len(f)) for j in range(i))
        assert abs(got[r] - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out_accuracy_and_edges(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    machine = Q.train(docs, labels)
    again = Q.train(docs.repartition(5), labels.repartition(3))
    assert np.allclose(machine.weights, again.weights)
    rows = Q.score(docs, machine).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert {r.quality for r in rows} == {0, 1}
    odd = spark.createDataFrame([(1, None, None, "z"), (1, None, None, "z"), (None, "", 0, "z"), (2, "ok " * 200000, 5, "z")],
                                "doc_id long, text string, n_chars long, score string")
    got = Q.score(odd, machine)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in got.collect()) and got.count() == 4
    assert Q.score(odd.where("false"), machine).count() == 0
    kept = Q.accepted(docs.withColumn("score", docs.doc_id), machine)
    assert kept.columns == [*docs.columns, "score"] and 700 < kept.count() < 1000


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [tuple(r)[2:] for r in Q.score(docs, Q.train(docs, none)).collect()] == [(0.5, 1)]


def test_labels_of_held_out_rows_are_never_read(spark):
    docs = spark.createDataFrame([(i, f"w{i} ### x" if i % 2 else f"plain text {i}") for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 = 0 AS INT) AS quality")
    wrong = labels.withColumn("quality", Q.F.when(Q.held_out(), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    assert np.array_equal(Q.train(docs, labels).weights, Q.train(docs, wrong).weights)
