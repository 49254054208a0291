"""Frame statistics: tone analysis, histograms, palettes. One shuffle by frame, partial aggregates before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import clamp, luminance

LEAST = 1e-6


#: Luminance as an integer: the weights times 10000.
WEIGHTS = (2126, 7152, 722)


def weighed() -> Column:
    return sum((w * F.col(c) for w, c in zip(WEIGHTS, "rgb")), F.lit(0))


def at_quantile(q: float, upto: Column, n: Column, total: Column, level: Column, after: Column) -> Column:
    """Linear between the values at the places around q (n - 1), from sorted values with their counts (``upto`` runs over them)."""
    place = F.lit(q) * (total - 1)
    low = F.floor(place)
    part = place - low
    # the row that holds the lower place; the next place is in it too, or in the next row
    here = (upto - n <= low) & (low < upto)
    value = F.when(low + 1 < upto, level).otherwise(F.coalesce(after, level))
    return F.max(F.when(here, level + part * (value - level)))


def analyze_tone(px: DataFrame) -> DataFrame:
    """Mean and exact quantiles of luminance. Values are integers, counted before the shuffle, so a frame's buffer is its distinct values, not its pixels."""
    return quantiled(px.groupBy("image_id", weighed().alias("v")).agg(F.count(F.lit(1)).alias("n")))


def quantiled(counts: DataFrame, more: tuple[Column, ...] = ()) -> DataFrame:
    """(image_id, v, n and more) by frame: mean, median, p01, p99 and samples."""
    w = Window.partitionBy("image_id").orderBy("v")
    run = counts.withColumns({"upto": F.sum("n").over(w), "after": F.lead("v").over(w), "total": F.sum("n").over(Window.partitionBy("image_id"))})
    scale = 10000 * 255.0
    q = lambda p: (at_quantile(p, F.col("upto"), F.col("n"), F.col("total"), F.col("v").cast("double"), F.col("after").cast("double")) / scale)
    return run.groupBy("image_id").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n") / scale).alias("mean"), q(0.5).alias("median"), q(0.01).alias("p01"), q(0.99).alias("p99"), F.sum("n").alias("samples"), *more)


def report(px: DataFrame) -> DataFrame:
    """Tone with the channels' means and deviations, from one pass: sums of each channel are kept beside the counts by luminance."""
    sums = [f(F.col(c) * F.col(c) if k else F.col(c)).alias(f"{c}{k}") for c in "rgb" for k, f in enumerate((F.sum, F.sum))]
    counts = px.groupBy("image_id", weighed().alias("v")).agg(F.count(F.lit(1)).alias("n"), *sums)
    mean = lambda c, k: F.sum(f"{c}{k}") / F.sum("n")
    more = [m for c in "rgb" for m in (mean(c, 0).alias(f"{c}_mean"), F.sqrt(F.greatest(mean(c, 1) - mean(c, 0) * mean(c, 0), F.lit(0.0))).alias(f"{c}_stddev"))]
    return quantiled(counts, tuple(more)).drop("samples")


def exposure_to(target: float, level: Column) -> Column:
    """Stops that bring ``level`` to ``target``, within +-10."""
    if target <= LEAST:
        return F.lit(-10.0)
    return F.when(level <= LEAST, 10.0).otherwise(clamp(F.log2(F.lit(target) / level), -10.0, 10.0))


def auto_tone(tone: DataFrame, target: float = 0.5, low: float = -5.0, high: float = 5.0, contrast: tuple[float, float] = (-1.0, 1.0), eps: float = LEAST) -> DataFrame:
    median, span = F.col("median"), F.col("p99") - F.col("p01")
    ev = F.when(median <= eps, high).when(median >= 1 - eps, low).otherwise(clamp(F.log2(F.lit(target) / median), low, high))
    return tone.select("image_id", ev.alias("exposure"), F.when(span <= eps, 0.0).otherwise(clamp(F.lit(0.8) / span - 1.0, *contrast)).alias("contrast"))


def luma_histogram(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id", F.least(F.floor(luminance() * 256), F.lit(255)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_stats(hist: DataFrame, quantiles: tuple[float, ...] = (0.01, 0.5, 0.99)) -> DataFrame:
    """Count, mean of bin centres and linear quantiles, from a frame's at most 256 bins."""
    w = Window.partitionBy("image_id").orderBy("bin")
    run = hist.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy("image_id"))})
    out = [F.max("all").alias("samples"), (F.sum((F.col("bin") + 0.5) / 256.0 * F.col("n")) / F.max("all")).alias("mean")]
    for q in quantiles:
        pos, before = F.lit(q) * (F.col("all") - 1), F.col("upto") - F.col("n")
        value = (F.col("bin") + clamp((pos - before) / F.col("n"), 0.0, 1.0)) / 256.0
        out.append(F.max(F.when((before <= pos) & (pos < F.col("upto")), value)).alias(f"q{round(q * 100):02d}"))
    return run.groupBy("image_id").agg(*out)


def channels(px: DataFrame) -> DataFrame:
    return px.select("image_id", F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in "rgb"])))


def channel_histogram(px: DataFrame) -> DataFrame:
    return channels(px).groupBy("image_id", "channel", "v").agg(F.count(F.lit(1)).alias("n"))


def channel_stats(px: DataFrame) -> DataFrame:
    return channels(px).groupBy("image_id", "channel").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("stddev"), F.min("v").alias("minimum"), F.max("v").alias("maximum"))


def dominant_colors(px: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent colours by the upper four bits of each channel; the smaller key wins ties."""
    key = F.shiftright("r", 4) * 256 + F.shiftright("g", 4) * 16 + F.shiftright("b", 4)
    counts = px.groupBy("image_id", key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("image_id")
    ranked = counts.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), "key")), "frequency": F.col("n") / F.sum("n").over(w)})
    return ranked.where(F.col("rank") <= n).select("image_id", F.col("rank").cast("int").alias("rank"), "key", "n", "frequency")
