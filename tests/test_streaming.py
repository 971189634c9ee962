"""Stream results equal batch results whatever the file order; restarts add nothing."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandwarden.operators.gate import require_empty
from bandwarden.sources import views as V
from bandwarden.streaming import incremental, windows

SF = "/root/testdata/sf0.001"
c = F.col


def split(spark, folder, parts, order):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("_p", F.pmod(F.hash("l_orderkey"), F.lit(parts)))
    for i in order:
        li.where(c("_p") == i).drop("_p").coalesce(1).write.parquet(f"{folder}/tmp{i}")
        src = next((folder / f"tmp{i}").glob("*.parquet"))
        src.rename(folder / f"lineitem-{i}.parquet")


def finish(df, root, mode="complete"):
    q = (df.writeStream.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{root}/out"))
         .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    q.awaitTermination()


def stream(spark, folder):
    layout = spark.read.parquet(f"{SF}/lineitem.parquet").schema
    li = (spark.readStream.schema(layout).option("pathGlobFilter", "lineitem-*.parquet").option("maxFilesPerTrigger", 1).parquet(str(folder)))
    return V.with_detector(V._powers(V._base(li))).withColumn("data_time", c("event_id") * 0.01)


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    results = []
    for name, order in (("a", [0, 1, 2]), ("b", [2, 0, 1])):
        folder = tmp_path / name
        folder.mkdir()
        split(spark, folder, 3, order)
        sums = windows.chunk_sums(windows.with_event_time(stream(spark, folder)), 10.0, "10 days")
        finish(sums, str(folder / "run"))
        results.append(spark.read.parquet(str(folder / "run/out")).toPandas().sort_values(["chunk", "physical_channel"]).reset_index(drop=True))
    pd.testing.assert_frame_equal(results[0], results[1], rtol=1e-12)
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    batch = windows.chunk_sums(windows.with_event_time(V.with_detector(V._powers(V._base(li))).withColumn("data_time", c("event_id") * 0.01)))
    want = batch.toPandas().sort_values(["chunk", "physical_channel"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(results[0], want, rtol=1e-12)


def test_restart_adds_only_new_files(spark, tmp_path):
    folder = tmp_path / "s"
    folder.mkdir()
    root = str(tmp_path / "scan")
    process = lambda d: d.groupBy("unit_key").agg(F.count("*").alias("n"), F.sum("baseband_power").alias("p"))

    def scan():
        df = stream(spark, folder).withColumn("unit_key", F.concat_ws("/", c("physical_channel").cast("string"), c("event_id").cast("string")))
        q = (df.writeStream.foreachBatch(incremental.upsert_units(process, f"{root}/out", f"{root}/bad", c("baseband_power") > 127))
             .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
        q.awaitTermination()

    split(spark, folder, 3, [0])
    scan()
    first = spark.read.parquet(f"{root}/out").count()
    scan()
    assert spark.read.parquet(f"{root}/out").count() == first
    split(spark, folder, 3, [2, 1])
    scan()
    out, bad = incremental.saved(spark, f"{root}/out", f"{root}/bad"), incremental.refused_units(spark, f"{root}/bad")
    require_empty(out.groupBy("unit_key").count().where("count > 1"), "unit twice")
    require_empty(out.join(bad, "unit_key", "left_semi"), "unit saved and quarantined")
    li = V.with_detector(V._powers(V._base(spark.read.parquet(f"{SF}/lineitem.parquet"))))
    assert out.count() + bad.count() == li.select("physical_channel", "event_id").distinct().count()


def test_units_over_several_batches_lose_no_frame(spark, tmp_path):
    root = str(tmp_path)
    process = lambda d: d.groupBy("unit_key").agg(F.count("*").alias("n"))
    run = incremental.upsert_units(process, f"{root}/out", f"{root}/bad", c("power") > 9, cap=25)
    rows = lambda unit, a, e, power=1: [(unit, i, power) for i in range(a, e)]
    schema = "unit_key string, frame_in_unit int, power int"
    run(spark.createDataFrame(rows("x", 0, 10) + rows("y", 0, 5) + rows("z", 0, 3), schema), 0)
    for _ in range(2):
        run(spark.createDataFrame(rows("x", 10, 30) + rows("y", 5, 6, 10), schema), 1)
    got = {r["unit_key"]: (r["n"], r["capped"]) for r in incremental.saved(spark, f"{root}/out", f"{root}/bad").groupBy("unit_key").agg(
        F.sum("n").alias("n"), F.max("capped").alias("capped")).collect()}
    assert got == {"x": (25, True), "z": (3, False)}
    assert [tuple(r) for r in incremental.refused_units(spark, f"{root}/bad").collect()] == [("y", ["refused"], False)]


def test_a_batch_that_raises_loses_only_the_units_that_raise(spark, tmp_path):
    root = str(tmp_path)
    broken = F.udf(lambda p: 1 // p, "int")
    run = incremental.upsert_units(lambda d: d.groupBy("unit_key").agg(F.max(broken("p")).alias("p")), f"{root}/out", f"{root}/bad")
    schema = "unit_key string, p int"
    run(spark.createDataFrame([("a", 1)], schema), 0)
    run(spark.createDataFrame([("b", 0)] + [(f"c{i}", 1) for i in range(9)] + [("d", 0)], schema), 1)
    run(spark.createDataFrame([("a", 1), ("b", 1)], schema), 2)
    assert sorted({r["unit_key"] for r in incremental.saved(spark, f"{root}/out", f"{root}/bad").collect()}) == ["a", *[f"c{i}" for i in range(9)]]
    bad = {r["unit_key"]: (r["errors"], r["failed"]) for r in incremental.refused_units(spark, f"{root}/bad").collect()}
    assert bad == {"b": (["PythonException"], True), "d": (["PythonException"], True)}


def test_a_stop_between_write_and_commit_doubles_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    run = incremental.upsert_units(lambda d: d.groupBy("unit_key").count(), f"{root}/out", f"{root}/bad")
    rows = spark.createDataFrame([("x",), ("x",), ("y",)], "unit_key string")
    with monkeypatch.context() as stopped:
        stopped.setattr(incremental, "put_batch", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            run(rows, 0)
    assert spark.read.parquet(f"{root}/out").count() == 2
    run(rows, 0)
    assert sorted((r["unit_key"], r["count"]) for r in incremental.saved(spark, f"{root}/out", f"{root}/bad").collect()) == [("x", 2), ("y", 1)]


def test_ledger_tells_altered_parts_and_pending_units(spark, tmp_path):
    root = str(tmp_path)
    inventory = spark.createDataFrame([("x",), ("y",), ("z",)], "unit_key string")
    run = incremental.upsert_units(lambda d: d.groupBy("unit_key").count(), f"{root}/out", f"{root}/bad", inventory=inventory)
    assert incremental.pending_units(inventory, f"{root}/bad").count() == 3
    run(spark.createDataFrame([("x",), ("y",), ("stray",)], "unit_key string"), 0)
    assert [r["unit_key"] for r in incremental.pending_units(inventory, f"{root}/bad").collect()] == ["z"]
    assert [tuple(r) for r in incremental.refused_units(spark, f"{root}/bad").collect()] == [("stray", ["unknown"], False)]
    assert incremental.altered_parts(spark, f"{root}/out", f"{root}/bad").count() == 0
    attempt = incremental.ledger(spark, f"{root}/bad").where("unit_key = 'x'").first()["attempt"]
    spark.createDataFrame([("x", 7, None)], "unit_key string, count long, error string").write.mode("append").parquet(f"{root}/out/batch_id=0/attempt={attempt}")
    assert [tuple(r) for r in incremental.altered_parts(spark, f"{root}/out", f"{root}/bad").collect()] == [("x", 0, 1, 2)]


def test_faults_are_judged_by_class():
    from pyspark.errors import PythonException
    python = lambda text: PythonException(f"Traceback (most recent call last):\n  File \"x\", line 1\n{text}\n")
    assert incremental.raised_by_data(python("ValueError: No space left in this field, OSError it says"))
    assert not incremental.raised_by_data(python("OSError: [Errno 28] No space left on device"))
    assert not incremental.raised_by_data(python("MemoryError: "))
    assert not incremental.raised_by_data(RuntimeError("FetchFailed"))


def test_a_unit_that_raises_is_quarantined_alone(spark, tmp_path):
    root = str(tmp_path)
    process = incremental.each_unit(lambda pdf: pd.DataFrame({"unit_key": [pdf.unit_key[0]], "p": [1 // int(pdf.p[0])]}), "unit_key string, p long")
    run = incremental.upsert_units(process, f"{root}/out", f"{root}/bad", c("p") > 9)
    run(spark.createDataFrame([("b", 0), ("c", 1), ("d", 10)], "unit_key string, p int"), 0)
    assert [tuple(r)[:2] for r in incremental.saved(spark, f"{root}/out", f"{root}/bad").select("unit_key", "p").collect()] == [("c", 1)]
    bad = {r["unit_key"]: (r["errors"], r["failed"]) for r in incremental.refused_units(spark, f"{root}/bad").collect()}
    assert bad == {"b": (["ZeroDivisionError"], True), "d": (["refused"], False)}


def test_a_fault_of_the_cluster_gives_the_batch_again(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "out").write_text("a file where the folder should be")
    units = spark.createDataFrame([("b",), ("c",)], "unit_key string")
    run = incremental.upsert_units(lambda d: d.groupBy("unit_key").count(), f"{root}/out", f"{root}/bad")
    with pytest.raises(Exception):
        run(units, 0)
    assert not (tmp_path / "bad").exists()

    def full(p):
        raise OSError("No space left on device")

    run = incremental.upsert_units(lambda d: d.select("unit_key", F.udf(full, "int")("unit_key").alias("p")), f"{root}/out2", f"{root}/bad")
    with pytest.raises(Exception):
        run(units, 0)
    assert not (tmp_path / "bad").exists()


def test_stream_reads_a_table_folder(spark, tmp_path):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    li.repartition(4).write.parquet(str(tmp_path / "lineitem.parquet"))
    finish(windows.power_accumulator(V.stream_frames(spark, str(tmp_path))), str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/out")).agg(F.sum("n")).first()[0] == li.count()


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    root = str(tmp_path)
    run = incremental.upsert_units(lambda d: d.groupBy("unit_key").count(), f"{root}/out", f"{root}/bad")
    a = spark.createDataFrame([("x",), ("y",)], "unit_key string")
    run(a, 0)
    run(a, 0)
    run(spark.createDataFrame([("z",)], "unit_key string"), 1)
    assert sorted(r["unit_key"] for r in incremental.saved(spark, f"{root}/out", f"{root}/bad").collect()) == ["x", "y", "z"]


def frames_at(spark, *seconds):
    return windows.with_event_time(spark.createDataFrame(
        [(14, float(t), 2.0, True, False) for t in seconds], "physical_channel int, data_time double, baseband_power double, valid boolean, reject boolean"))


def test_late_frames_go_to_a_table_and_are_merged_on_reading(spark, tmp_path):
    root = str(tmp_path)
    run = windows.chunk_batch(root, seconds=10, delay=20)
    run(frames_at(spark, 1, 2, 55), 0)
    assert windows.watermark(spark, root) == 35_000_000 and windows.late_frames(spark, root) is None
    for _ in range(2):
        run(frames_at(spark, 3, 33, 31, 90), 1)       # 3 is late; the chunk of 33 and 31 ends after the watermark
    run(frames_at(spark, 34, 61, 71), 2)              # the chunks of 34 and 61 have ended at 70
    assert sorted((r["data_time"], r["batch_id"]) for r in windows.late_frames(spark, root).collect()) == [(3.0, 1), (34.0, 2), (61.0, 2)]
    got = {r["chunk"]: (r["total_count"], r["late_count"], r["closed"]) for r in windows.read_chunks(spark, root).collect()}
    assert got == {0: (3, 1, True), 5: (1, 0, True), 3: (3, 1, True), 9: (1, 0, False), 6: (1, 1, True), 7: (1, 0, False)}
    assert {r["chunk"]: r["total_count"] for r in windows.read_chunks(spark, root, late=False).collect()} == {0: 2, 5: 1, 3: 2, 9: 1, 7: 1}


def test_an_empty_batch_moves_nothing(spark, tmp_path):
    root = str(tmp_path)
    run = windows.chunk_batch(root)
    run(frames_at(spark, 100), 0)
    run(frames_at(spark, 1).where("false"), 1)
    assert windows.watermark(spark, root) == 40_000_000 and windows.read_chunks(spark, root).count() == 1


def test_accumulator_writes_changed_keys_and_goes_on_after_a_restart(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "acc")
    layout = "physical_channel int, bin int, before double, after double"

    def step(rows):
        spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(source)
        q = windows.run_accumulator(windows.spectrum_accumulator(spark.readStream.schema(layout).parquet(source)), root)
        q.awaitTermination()
        return q

    step([(14, b, 1.0, 0.5) for b in range(4)])
    q = step([(14, 1, 2.0, 0.0), (15, 0, 1.0, 1.0)])
    assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) == 5
    assert {r["batch_id"]: r["count"] for r in spark.read.parquet(f"{root}/totals").groupBy("batch_id").count().collect()} == {0: 4, 1: 2}
    got = sorted(map(tuple, windows.read_accumulator(spark, root, ("physical_channel", "bin")).collect()))
    assert got == [(14, 0, 1.0, 0.5, 1), (14, 1, 3.0, 0.5, 2), (14, 2, 1.0, 0.5, 1), (14, 3, 1.0, 0.5, 1), (15, 0, 1.0, 1.0, 1)]
