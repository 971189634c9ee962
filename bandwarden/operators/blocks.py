"""Block job: packed samples to frame products, and its relational twin.

A block is one binary payload of packed samples, time-major over streams.  The
payload is cut into frames by Spark; the frames of an Arrow batch are reduced a few
at a time, so what NumPy holds follows one frame and not the batch.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import samples as S


def frame_source(blocks: DataFrame, nfft: int, streams: str = "n_streams") -> DataFrame:
    """Complete frames of each block; a final partial frame is dropped."""
    per = F.lit(nfft) * F.col(streams)
    whole = F.floor(F.length("payload") / per).cast("int")
    keep = [c for c in blocks.columns if c != "payload"]
    cut = blocks.where(whole > 0).select("*", F.explode(F.sequence(F.lit(0), whole - 1)).alias("frame_in_unit"))
    size = (F.lit(nfft) * F.col(streams)).cast("int")
    return cut.select(*keep, "frame_in_unit",
                      F.substring("payload", F.col("frame_in_unit") * size + 1, size).alias("payload"))


def rank_violations(blocks: DataFrame, nfft: int) -> DataFrame:
    """Blocks whose payload is not a whole number of time samples."""
    return blocks.where((F.length("payload") % F.col("n_streams") != 0) | (F.col("n_streams") <= 0))


def pack_frames(samples: DataFrame, keys: list[str], order: str, byte: Column) -> DataFrame:
    """Binary payload from sample rows; a key holds one bounded block."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), byte.alias("b"))))
    text = F.array_join(F.transform(cells, lambda s: F.char(s["b"].cast("long"))), "")  # one Latin-1 letter per byte
    return samples.groupBy(*keys).agg(F.encode(text, "ISO-8859-1").alias("payload"))


def with_row_index(samples: DataFrame, window: int, windows: int, stream: Column, sense: Column | None = None) -> DataFrame:
    """Sample position to detector row and place in the window; an inverted
    sense reverses the places."""
    k = F.col("n") % window
    if sense is not None:
        k = F.when(sense < 0, window - 1 - k).otherwise(k)
    win = F.floor(F.col("n") / window)
    return samples.select("*", (stream * windows + win).cast("long").alias("row"), k.cast("int").alias("place"))


def framing_violations(nfft: Column, window: Column) -> Column:
    """True where a frame does not divide into whole windows."""
    return (window <= 0) | (nfft % window != 0)


# --- quantizer ---------------------------------------------------------------

def quantize(df: DataFrame, re: str, im: str, keys: list[str], clip_sigma: float = 3.0, bits: int = 4) -> DataFrame:
    """Samples scaled by the spread of their key, rounded half to even, clipped.

    The spread is that of the real part, else of the imaginary part, else of
    the magnitude; a key without spread gets an undefined scale."""
    top = float((1 << (bits - 1)) - 1)
    mag = F.sqrt(F.col(re) * F.col(re) + F.col(im) * F.col(im))
    spread = [F.stddev_pop(F.col(re)).alias("_a"), F.stddev_pop(F.col(im)).alias("_b"), F.stddev_pop(mag).alias("_c")]
    sd = F.when(F.col("_a") > 0, F.col("_a")).when(F.col("_b") > 0, F.col("_b")).when(F.col("_c") > 0, F.col("_c"))
    scales = (df.groupBy(*keys).agg(*spread) if keys else df.agg(*spread)).select(*keys, (F.lit(top) / (F.lit(clip_sigma) * sd)).alias("scale"))
    if keys:
        from .small import join_small
        j = join_small(df, scales, keys)
    else:
        j = df.join(F.broadcast(scales), F.lit(True))
    a, b = F.col(re) * F.col("scale"), F.col(im) * F.col("scale")
    fit = lambda x: F.least(F.greatest(F.bround(x), F.lit(-top)), F.lit(top)).cast("int")
    clipped = (F.abs(a) > top) | (F.abs(b) > top)
    return j.select("*", fit(a).alias("q_re"), fit(b).alias("q_im"), clipped.alias("clipped"))


# --- batch kernels -----------------------------------------------------------

CHUNK_SAMPLES = 1 << 22  # samples worked on at once, whatever the Arrow batch holds


def unpack(payloads, streams: int) -> np.ndarray:
    """Small-integer parts ``[frame, time, stream]`` of equally long payloads."""
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(len(payloads), -1, streams)
    return (raw >> 4).astype(np.int8) - np.int8(8), (raw & 15).astype(np.int8) - np.int8(8)


def few_frames(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of equal payload length, no more at a time than ``CHUNK_SAMPLES`` hold (one frame at least)."""
    for size, same in frame.groupby(frame["payload"].map(len), sort=False):
        step = max(1, CHUNK_SAMPLES // max(1, size))
        for at in range(0, len(same), step):
            yield same.iloc[at:at + step]


def project(re: np.ndarray, im: np.ndarray, wr: np.ndarray, wi: np.ndarray, inverted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Exact integer sums ``x * conj(w)`` per (frame, term, stream, window).

    Windows are multiplied a block at a time in floating point, which is exact here: a sum stays below
    2 * 8 * k * max|w|, and single precision is used only where that is below 2**24."""
    frames, time, streams = re.shape
    terms, k = wr.shape
    kind = np.float32 if 16 * k * max(1, np.abs(wr).max(), np.abs(wi).max()) < 1 << 24 else np.float64
    ar, ai = (w[:, ::-1].astype(kind) if inverted else w.astype(kind) for w in (wr, wi))
    windows = time // k
    zr = np.empty((frames, terms, streams, windows), np.int64)
    zi = np.empty_like(zr)
    step = max(1, CHUNK_SAMPLES // max(1, frames * k * streams))
    for at in range(0, windows, step):
        part = slice(at * k, min(at + step, windows) * k)
        xr, xi = (x[:, part].reshape(frames, -1, k, streams).astype(kind) for x in (re, im))
        for out, one in ((zr, ar @ xr + ai @ xi), (zi, ar @ xi - ai @ xr)):
            out[..., at:at + step] = one.transpose(0, 2, 3, 1)
    return zr, zi


def mean_power(re: np.ndarray, im: np.ndarray) -> np.ndarray:
    """Mean of |x|^2 per frame from the counts of the 256 sample values."""
    r, i = np.divmod(np.arange(256), 16)
    level = (r - 8) ** 2 + (i - 8) ** 2
    codes = ((re.astype(np.uint8) + np.uint8(8)) << 4) | (im.astype(np.uint8) + np.uint8(8))
    return np.array([np.bincount(c.ravel(), minlength=256) @ level / c.size for c in codes])


Detector = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], tuple[np.ndarray, np.ndarray]]


def _weight_arrays(weights: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weight bank as arrays: terms x window, at most a few hundred values."""
    rows = weights.orderBy("term", "k").collect()
    terms = 1 + max(r["term"] for r in rows)
    return (np.array([r["wr"] for r in rows], np.int64).reshape(terms, -1),
            np.array([r["wi"] for r in rows], np.int64).reshape(terms, -1))


def detect_frames(frames: DataFrame, weights: DataFrame, keys: list[str], streams: int, inverted: bool = False,
                  pad: int = 2, detector: Detector = project) -> DataFrame:
    """One row per frame: term powers, baseband power and the fine ratio.

    ``detector`` may be replaced by any function of the same shape."""
    wr, wi = _weight_arrays(weights)
    types = dict(frames.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + (
        ", p_target long, p_lower long, p_upper long, p_ref_sum long, baseband_power double, fine_ratio array<float>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for same in few_frames(pdf):
                re, im = unpack(same["payload"].tolist(), streams)
                zr, zi = detector(re, im, wr, wi, inverted)
                power = (zr * zr + zi * zi).sum(axis=(2, 3))
                bins = pad * zr.shape[3]
                spec = np.fft.fft(zr + 1j * zi, n=bins, axis=3)
                fine = (spec.real**2 + spec.imag**2).sum(axis=2)
                den = fine[:, 1] + fine[:, 2]
                ratio = np.where(den > 0, 2.0 * fine[:, 0] / np.where(den > 0, den, 1.0), 0.0)
                out = same[keys].copy()
                out["p_target"], out["p_lower"], out["p_upper"] = power[:, 0], power[:, 1], power[:, 2]
                out["p_ref_sum"] = power[:, 1] + power[:, 2]
                out["baseband_power"] = mean_power(re, im)
                out["fine_ratio"] = list(ratio.astype(np.float32))
                yield out

    return frames.select(*keys, "payload").mapInPandas(run, schema)


def row_projections(frames: DataFrame, weights: DataFrame, keys: list[str], streams: int, inverted: bool = False) -> DataFrame:
    """Integer row sums per (frame, term, row)."""
    wr, wi = _weight_arrays(weights)
    types = dict(frames.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", term int, row int, zr long, zi long"

    def run(batches):
        for pdf in (few for batch in batches for few in few_frames(batch)):
            re, im = unpack(pdf["payload"].tolist(), streams)
            zr, zi = project(re, im, wr, wi, inverted)
            f, t, s, w = zr.shape
            out = pdf[keys].loc[pdf.index.repeat(t * s * w)].reset_index(drop=True)
            out["term"] = np.tile(np.repeat(np.arange(t), s * w), f).astype(np.int32)
            out["row"] = np.tile(np.arange(s * w), f * t).astype(np.int32)
            out["zr"], out["zi"] = zr.reshape(-1), zi.reshape(-1)
            yield out

    return frames.select(*keys, "payload").mapInPandas(run, schema)


def row_projections_relational(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """The same sums as a join on the window place and one aggregation."""
    c = F.col
    j = samples.join(F.broadcast(weights), "k")
    return j.groupBy("frame", "term", c("win").alias("row")).agg(
        F.sum(c("re") * c("wr") + c("im") * c("wi")).alias("zr"), F.sum(c("im") * c("wr") - c("re") * c("wi")).alias("zi"))


def coarse_powers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Term powers summed over rows before any ratio is formed."""
    e = F.col("zr") * F.col("zr") + F.col("zi") * F.col("zi")
    per = lambda t: F.sum(F.when(F.col("term") == t, e))
    return rows.groupBy(*keys).agg(per(0).alias("p_target"), per(1).alias("p_lower"), per(2).alias("p_upper")).withColumn(
        "p_ref_sum", F.col("p_lower") + F.col("p_upper"))


def power_mismatches(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Frames on which two routes to the powers disagree, or one is missing."""
    cols = ["p_target", "p_ref_sum"]
    j = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols]).join(
        b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols]), keys, "full")
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return j.where(~same)


def integrated_spectra(frames: DataFrame, keys: list[str], streams: int, valid: str = "valid", reject: str = "reject") -> DataFrame:
    """Power spectra summed over valid and over kept frames per key and bin.

    Each task adds its frames up before the shuffle, so what moves is one
    spectrum per key and task, never one per frame."""
    types = dict(frames.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", bin int, before double, after double, n_before long, n_after long"

    def run(batches):
        total: dict[tuple, list] = {}
        for pdf in (few for batch in batches for few in few_frames(batch[batch[valid]])):
            for key, same in pdf.groupby(keys, sort=False):
                re, im = unpack(same["payload"].tolist(), streams)
                power = np.zeros(re.shape[:2])
                width = max(1, CHUNK_SAMPLES // max(1, re.shape[0] * re.shape[1]))
                for at in range(0, streams, width):  # some streams at a time
                    spec = np.fft.fft(re[:, :, at:at + width] + 1j * im[:, :, at:at + width], axis=1)
                    power += (spec.real**2 + spec.imag**2).sum(axis=2)
                kept = ~same[reject].to_numpy(bool)
                one = [power.sum(axis=0), power[kept].sum(axis=0), len(same), int(kept.sum())]
                old = total.get(key)
                total[key] = one if old is None else [x + y for x, y in zip(old, one)]
        for key, (before, after, n, k) in total.items():
            out = pd.DataFrame({"bin": np.arange(len(before), dtype=np.int32), "before": before, "after": after,
                                "n_before": n, "n_after": k})
            for name, value in zip(keys, key):
                out[name] = value
            yield out[[*keys, "bin", "before", "after", "n_before", "n_after"]]

    part = frames.select(*keys, valid, reject, "payload").mapInPandas(run, schema)
    return part.groupBy(*keys, "bin").agg(*[F.sum(c).alias(c) for c in ("before", "after", "n_before", "n_after")])


def coarse_marginal(frames: DataFrame, keys: list[str], streams: int, window: int) -> DataFrame:
    """Window spectrum of each frame averaged over windows and streams."""
    types = dict(frames.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", band_power double, marginal array<double>"

    def run(batches):
        for pdf in (few for batch in batches for few in few_frames(batch)):
            re, im = unpack(pdf["payload"].tolist(), streams)
            total, width = np.zeros((len(pdf), window)), max(1, CHUNK_SAMPLES // max(1, re.shape[0] * re.shape[1]))
            for at in range(0, streams, width):  # some streams at a time
                x = (re[:, :, at:at + width] + 1j * im[:, :, at:at + width]).reshape(len(pdf), re.shape[1] // window, window, -1)
                spec = np.fft.fft(x, axis=2)
                total += (spec.real**2 + spec.imag**2).sum(axis=(1, 3))
            out = pdf[keys].copy()
            out["band_power"] = mean_power(re, im)
            out["marginal"] = list(total / (re.shape[1] // window * streams))
            yield out

    return frames.select(*keys, "payload").mapInPandas(run, schema)


def marginal_ratio(target: Column, window: int, offset: int = 2) -> Column:
    """``2*m[t]/(m[t-o]+m[t+o])`` on the circular window axis."""
    at = lambda b: F.element_at("marginal", F.pmod(b, F.lit(window)).cast("int") + 1)
    den = at(target - offset) + at(target + offset)
    return F.when(den > 0, 2.0 * at(target) / den)


def inject_tone(frames: DataFrame, keys: list[str], streams: int, cycles: float, amplitude: float, seed: int,
                first_sample: str = "first_sample") -> DataFrame:
    """Frames with a tone added: the sum is rounded, clipped and counted.

    ``cycles`` is the tone frequency in cycles per sample and the phase of a
    stream follows from the seed, so any frame can be redone alone.  A zero
    amplitude returns the payload unchanged."""
    types = dict(frames.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", payload binary, clip_count long, n_samples long"
    phase = 2 * np.pi * np.random.default_rng(seed).random(streams)

    def run(batches):
        for pdf in batches:
            re, im = unpack(pdf["payload"].tolist(), streams)
            n = pdf[first_sample].to_numpy(float)[:, None, None] + np.arange(re.shape[1])[None, :, None]
            angle = 2 * np.pi * cycles * n + phase[None, None, :]
            nr, ni = np.rint(re + amplitude * np.cos(angle)), np.rint(im + amplitude * np.sin(angle))
            out = pdf[keys].copy()
            over = (nr < -8) | (nr > 7) | (ni < -8) | (ni > 7)
            packed = ((np.clip(nr, -8, 7).astype(np.int64) + 8) << 4) | (np.clip(ni, -8, 7).astype(np.int64) + 8)
            out["payload"] = [bytes(p.astype(np.uint8).tobytes()) for p in packed]
            out["clip_count"], out["n_samples"] = over.sum(axis=(1, 2)), re.shape[1] * streams
            yield out

    return frames.select(*dict.fromkeys([*keys, first_sample]), "payload").mapInPandas(run, schema)


def injection_manifest(injected: DataFrame, unit: list[str], amplitude: float) -> DataFrame:
    return injected.groupBy(*unit).agg(
        F.lit(amplitude).alias("amplitude_lsb"), F.sum("n_samples").alias("n_samples"), F.sum("clip_count").alias("clip_count"),
        (F.sum("clip_count") / F.sum("n_samples")).alias("clip_fraction"))


# --- analyzers ---------------------------------------------------------------

ANALYZERS: dict[str, Callable[..., DataFrame]] = {}


def analyzer(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function from frames to a product under a name."""
    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        ANALYZERS[name] = fn
        return fn
    return add


analyzer("detector")(detect_frames)
analyzer("control")(coarse_marginal)


def analyze(name: str, frames: DataFrame, *args, **kwargs) -> DataFrame:
    if name not in ANALYZERS:
        raise KeyError(f"no analyzer named {name}; known: {sorted(ANALYZERS)}")
    return ANALYZERS[name](frames, *args, **kwargs)
