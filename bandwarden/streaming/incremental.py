"""Incremental scan: new units once, failing units to quarantine alone, a ledger that says what counts."""
from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.errors import (ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException, PythonException,
                            SparkRuntimeException)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .tables import batch_table, put_batch

DATA_FAULTS = (ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException, PythonException, SparkRuntimeException)
MACHINE_FAULTS = (OSError, MemoryError, EOFError)
RETRIES = 2


def raised_by_data(fault: Exception) -> bool:
    """Whether the processing of the rows raised ``fault``, by the class of the error and not by its words.

    An error from Python code is named in the last lines of its traceback that are not indented."""
    if not isinstance(fault, DATA_FAULTS):
        return False
    if isinstance(fault, PythonException):
        raised = [line.split(":")[0].split(".")[-1] for line in str(fault).splitlines() if line[:1].isalpha() and ":" in line]
        return not any(name in {kind.__name__ for kind in MACHINE_FAULTS} | {"FileNotFoundError", "ConnectionError", "TimeoutError"} for name in raised)
    return True


def each_unit(run: Callable[[pd.DataFrame], pd.DataFrame], result: str, key: str = "unit_key") -> Callable[[DataFrame], DataFrame]:
    """Processing for ``upsert_units`` by one call of ``run`` for every unit; a call that raises fails its unit alone.

    ``result`` is the layout that ``run`` returns, ``key`` included."""
    def call(found: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(pdf).assign(error=None)
        except MACHINE_FAULTS:
            raise
        except Exception as fault:  # the unit's own
            return pd.DataFrame({key: [found[0]], "error": [type(fault).__name__]})

    def process(good: DataFrame) -> DataFrame:
        names = [f.name for f in StructType.fromDDL(result)]

        def whole(found: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return call(found, pdf).reindex(columns=[*names, "error"])
        return good.groupBy(key).applyInPandas(whole, f"{result}, error string")
    return process


def digest(*columns: str) -> F.Column:
    """Sum of the rows' hashes: the same whatever their order, another one when a row is lost, doubled or altered."""
    return F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("decimal(38,0)")


def upsert_units(process: Callable[[DataFrame], DataFrame], out: str, quarantine: str, problem: F.Column | None = None,
                 key: str = "unit_key", cap: int | None = None, inventory: DataFrame | None = None,
                 retries: int = RETRIES) -> Callable[[DataFrame, int], None]:
    """Batch function of a scan that is safe to repeat.

    The stream's checkpoint hands every row to one batch, so a unit may be spread over any number of batches: each
    writes its own part.  A unit with a ``problem`` in any batch, or one that ``inventory`` does not know, is refused whole,
    which ``saved`` applies when it reads.  ``process`` may return a column ``error`` (``each_unit`` makes such a function);
    a unit with one has failed.  Where the processing raises as a whole, the units are halved until those that raise stand
    alone, so no other unit is lost with them.  A fault that is not the data's is tried ``retries`` times
    and then raised on, and the stream gives the batch again.  Frames from ``cap`` on are not processed; their units are flagged.

    Results are written first, each attempt to a folder of its own; then one write of the ledger, of all units of the batch
    with attempt, rows and digest, makes them count.  A stop in between leaves an attempt that no reader sees."""
    def attempt(units: DataFrame, good: DataFrame, batch_id: int) -> list[DataFrame]:
        """Ledger rows of the units; writes their results."""
        fault = None
        for _ in range(retries + 1):
            name = uuid.uuid4().hex
            try:
                done = process(good)
                if "error" not in done.columns:
                    done = done.withColumn("error", F.lit(None).cast("string"))
                done.withColumn("batch_id", F.lit(batch_id).cast("long")).withColumn("attempt", F.lit(name)).write.mode("append").partitionBy(
                    "batch_id", "attempt").parquet(out)
                return [_made(done, out, batch_id, name, key)]
            except Exception as found:
                fault = found
                if raised_by_data(found):
                    break
        if not raised_by_data(fault):
            raise fault
        names = F.xxhash64(F.col(key).cast("string"))
        many = units.agg(F.count(F.lit(1)).alias("n"), F.bit_and(names).alias("all"), F.bit_or(names).alias("any")).first()
        if many["n"] <= 1:
            return [units.select(key, F.lit(type(fault).__name__).alias("error"), F.lit(True).alias("failed"), F.lit(None).cast("string").alias("attempt"),
                                 F.lit(0).cast("long").alias("rows"), F.lit(None).cast("decimal(38,0)").alias("digest"))]
        apart = many["all"] ^ many["any"]   # bits in which the hashes of the units differ; any of them leaves no side empty
        first = names.bitwiseAND(F.lit(apart & -apart)) == 0
        return [row for side in (first, ~first) for row in attempt(units.where(side), good.where(side), batch_id)]

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            flags = [F.bool_or(problem).alias("refused") if problem is not None else F.lit(False).alias("refused"),
                     F.bool_or(F.col("frame_in_unit") >= cap).alias("capped") if cap is not None else F.lit(False).alias("capped")]
            units = batch.groupBy(key).agg(*flags).withColumn("error", F.when(F.coalesce("refused", F.lit(False)), F.lit("refused")))
            if inventory is not None:
                known = inventory.select(key).distinct().withColumn("known", F.lit(True))
                units = units.join(known, key, "left").withColumn("error", F.coalesce("error", F.when(F.col("known").isNull(), F.lit("unknown"))))
            units = units.select(key, "error", F.coalesce("capped", F.lit(False)).alias("capped")).persist()
            try:
                if batch.isEmpty():
                    return
                bad = units.where("error IS NOT NULL")
                good = batch.join(bad.select(key), key, "left_anti")
                if cap is not None:
                    good = good.where(F.col("frame_in_unit") < cap)
                rows = attempt(units.where("error IS NULL").select(key), good, batch_id)
                ledger = rows[0]
                for other in rows[1:]:
                    ledger = ledger.unionByName(other)
                fine = units.where("error IS NULL").select(key, "capped").join(ledger, key, "left")
                bad = bad.select(key, "capped", "error", F.lit(False).alias("failed"))
                put_batch(fine.unionByName(bad, allowMissingColumns=True).withColumn("failed", F.coalesce("failed", F.lit(False))), quarantine, batch_id)
            finally:
                units.unpersist()
        finally:
            batch.unpersist()
    return run


def _made(done: DataFrame, out: str, batch_id: int, name: str, key: str) -> DataFrame:
    """What an attempt has written, by unit."""
    spark = done.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch_id={batch_id}/attempt={name}")
    written = done.limit(0)   # no unit has a row to save
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        written = spark.read.option("basePath", out).parquet(where.toString())
    data = sorted(c for c in written.columns if c not in ("batch_id", "attempt", "error"))
    return written.groupBy(key).agg(
        F.max("error").alias("error"), F.count_if(F.col("error").isNull()).alias("rows"), digest(*data).alias("digest")).select(
        key, "error", F.col("error").isNotNull().alias("failed"), F.lit(name).alias("attempt"), "rows", "digest")


def ledger(spark: SparkSession, quarantine: str) -> DataFrame | None:
    """One row for each unit of each batch: its error if it has one, its attempt, rows and digest."""
    return batch_table(spark, quarantine)


def refused_units(spark: SparkSession, quarantine: str, key: str = "unit_key") -> DataFrame:
    """Units that were refused or whose processing failed, with the reasons."""
    rows = ledger(spark, quarantine).where("error IS NOT NULL")
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("error")).alias("errors"), F.bool_or("failed").alias("failed"))


def _committed(spark: SparkSession, out: str, quarantine: str, key: str) -> DataFrame:
    parts = spark.read.parquet(out).where("error IS NULL").drop("error")
    counted = ledger(spark, quarantine).where("attempt IS NOT NULL").select(key, "batch_id", "attempt")
    return parts.join(counted, [key, "batch_id", "attempt"], "left_semi")


def saved(spark: SparkSession, out: str, quarantine: str, key: str = "unit_key") -> DataFrame:
    """Committed parts of the units that are not quarantined, flagged where frames beyond the cap were left out."""
    capped = ledger(spark, quarantine).where("capped").select(key).distinct().withColumn("capped", F.lit(True))
    parts = _committed(spark, out, quarantine, key).drop("attempt").join(refused_units(spark, quarantine, key), key, "left_anti")
    return parts.join(capped, key, "left").withColumn("capped", F.coalesce("capped", F.lit(False)))


def altered_parts(spark: SparkSession, out: str, quarantine: str, key: str = "unit_key") -> DataFrame:
    """Units and batches whose committed rows are no longer those that the ledger names."""
    parts = _committed(spark, out, quarantine, key)
    data = sorted(c for c in parts.columns if c not in ("batch_id", "attempt"))
    found = parts.groupBy(key, "batch_id", "attempt").agg(F.count(F.lit(1)).alias("rows_found"), digest(*data).alias("digest_found"))
    told = ledger(spark, quarantine).where("attempt IS NOT NULL AND error IS NULL").select(key, "batch_id", "attempt", "rows", "digest")
    return told.join(found, [key, "batch_id", "attempt"], "left").where(
        ~(F.col("rows").eqNullSafe(F.col("rows_found")) & F.col("digest").eqNullSafe(F.col("digest_found")))).select(key, "batch_id", "rows", "rows_found")


def pending_units(inventory: DataFrame, quarantine: str, key: str = "unit_key") -> DataFrame:
    """Units of the inventory that no batch has brought."""
    seen = ledger(inventory.sparkSession, quarantine)
    return inventory if seen is None else inventory.join(seen.select(key).distinct(), key, "left_anti")


def scan(spark: SparkSession, source: str, layout: StructType, checkpoint: str, out: str, quarantine: str,
         process: Callable[[DataFrame], DataFrame], problem=None, files_per_trigger: int = 100, key: str = "unit_key",
         cap: int | None = None, inventory: DataFrame | None = None) -> StreamingQuery:
    """Processes all files not seen before and stops; call again to go on."""
    stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return (stream.writeStream.foreachBatch(upsert_units(process, out, quarantine, problem, key, cap, inventory))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
