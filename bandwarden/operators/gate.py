"""Frame gate, channel filters and the exclusion ledger."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import clock


class SurveyRefused(ValueError):
    """Raised where the survey rules refuse an input."""


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def with_reasons(df: DataFrame, fine: str | None = None) -> DataFrame:
    """Adds ``reasons`` in fixed order and ``include`` (no reason).

    With a ``fine`` array column its non-finite and negative values count too.
    """
    c = F.col
    power, f = c("baseband_power"), c("f")
    tests = [
        ~c("valid"),
        (c("p_target") == 0) & (c("p_ref_sum") == 0),
        ~_finite(power),
        _finite(power) & ((power < 0) | (power > C.POWER_CEILING)),
        F.coalesce(power == C.POWER_CEILING, F.lit(False)),
        c("valid") & ~_finite(f),
    ]
    if fine:
        tests += [c("valid") & F.exists(fine, lambda x: ~_finite(x)),
                  c("valid") & F.exists(fine, lambda x: x < 0)]
    named = [F.when(t, F.lit(r)) for t, r in zip(tests, C.REASONS)]
    return df.withColumn("reasons", F.array_compact(F.array(*named))).withColumn(
        "include", F.size("reasons") == 0)


def identity_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of malformed identities; any non-zero count refuses the input."""
    bad = [F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in keys]
    rows = df.agg(*bad, F.count_if(F.col("frame_in_unit") < 0).alias("negative_frame_in_unit"))
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return rows.withColumn("k", F.lit(1)).join(
        twice.agg(F.count(F.lit(1)).alias("duplicate_identity")).withColumn("k", F.lit(1)), "k").drop("k")


def require_empty(df: DataFrame, what: str) -> None:
    """Raise with one example when a violation frame has a row."""
    found = df.take(1)
    if found:
        raise SurveyRefused(f"{what}: for example {found[0].asDict()}")


def drop_channels(df: DataFrame, drop: Sequence[int], column: str = "physical_channel") -> DataFrame:
    """Leave the given channels out; refuse when none remains."""
    out = df.where(~F.col(column).isin(*drop)) if drop else df
    if out.isEmpty():
        raise SurveyRefused("every channel was dropped")
    return out


def since(df: DataFrame, seconds: float, column: str = "unit_time0") -> DataFrame:
    return df.where(F.col(column) >= seconds)


def reason_summary(df: DataFrame) -> DataFrame:
    """Frames per (channel, reason) with channel and survey totals.

    NULL reason = any reason; NULL channel = all channels."""
    bad = df.where(~F.col("include"))
    one = bad.select("physical_channel", F.explode("reasons").alias("reason"))
    n = F.count(F.lit(1)).alias("n")
    by_reason = one.groupBy("physical_channel", "reason").agg(n)
    union = bad.rollup("physical_channel").agg(n).select(
        "physical_channel", F.lit(None).cast("string").alias("reason"), "n")
    total = by_reason.groupBy("reason").agg(F.sum("n").alias("n")).select(
        F.lit(None).cast("int").alias("physical_channel"), "reason", "n")
    return by_reason.unionByName(union).unionByName(total)


def health_summary(df: DataFrame) -> DataFrame:
    """Frames, power ratio and mask share of each channel as stored and without the excluded frames; NULL channel = all.

    Powers are summed before one ratio is formed; the mask share is that of valid frames."""
    def part(name: str, rows: Column) -> list[Column]:
        ok = rows & F.col("valid")
        p, r = (F.sum(F.when(ok, F.col(c).cast("decimal(20,0)"))).cast("double") for c in ("p_target", "p_ref_sum"))
        n = F.count_if(ok)
        return [F.count_if(rows).alias(f"{name}_frames"), F.when(r > 0, F.lit(2.0) * p / r).alias(f"{name}_ratio"),
                F.when(n > 0, F.count_if(ok & F.col("reject")) / n).alias(f"{name}_masked")]
    return df.rollup("physical_channel").agg(*part("stored", F.lit(True)), *part("corrected", F.col("include")), F.count_if(~F.col("include")).alias("excluded"))


def version_counts(channels: DataFrame, version: str = "detector_version") -> DataFrame:
    """Channels under each whole version and under each ``name=value`` token of it."""
    words = F.filter(F.split(version, " "), lambda w: F.instr(w, "=") > 0)
    named = F.expr("transform(words, w -> struct(substring_index(w, '=', 1) AS token, substring(w, instr(w, '=') + 1) AS value))")
    whole = F.array(F.struct(F.lit("version").alias("token"), F.col(version).alias("value")))
    rows = channels.select("physical_channel", version, words.alias("words")).select("physical_channel", F.explode(F.concat(whole, named)).alias("t"))
    return rows.groupBy("t.token", "t.value").agg(F.count_distinct("physical_channel").alias("channels"))


def reason_map(df: DataFrame) -> DataFrame:
    """Reason counts of each channel as one map."""
    counts = df.select("physical_channel", F.explode("reasons").alias("reason")).groupBy(
        "physical_channel", "reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("physical_channel").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))


def exclusion_ledger(df: DataFrame, event_key: Column, freq_id: Column,
                     period: float = C.SAMPLE_PERIOD_S, nfft: int = C.FRAME_SAMPLES) -> DataFrame:
    """One row per excluded frame with a stable key and ordered reason codes."""
    token = F.concat_ws("+", "reasons")
    key = F.concat(F.lit(f"{C.GATE_VERSION}/fid-"), freq_id.cast("string"), F.lit("/source-"), event_key,
                   F.lit("/frame-"), F.col("frame_in_unit").cast("string"), F.lit("/reasons-"), token)
    return df.where(~F.col("include")).select(
        key.alias("ledger_key"), token.alias("reason_codes"), freq_id.alias("freq_id"), "physical_channel",
        event_key.alias("source_event_key"), "event_id", "frame_in_unit",
        clock.frame_time(F.col("unit_time0"), F.col("frame_in_unit"), nfft, period).alias("frame_time"),
        "valid", F.col("reject").alias("reject_mask"), "baseband_power", "p_target", "p_ref_sum")
