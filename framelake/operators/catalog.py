"""Catalog operators: paths, hashes, orphans, histories, resumable work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Extensions that the image scan takes (fixed values).
SCANNED = ["png", "jpg", "jpeg", "webp", "arw", "cr2", "cr3", "dng", "nef"]
#: Least and greatest value of each scalar adjustment.
BOUNDS = {"exposure": (-10.0, 10.0), "temperature": (1500.0, 12000.0)} | {k: (-1.0, 1.0) for k in ("contrast", "highlights", "shadows", "whites", "blacks", "tint", "vibrance", "saturation")}
#: Which stages' results are void after a stage changed.
VOID = {"decode": ["decode", "mask", "preview", "histogram", "export"], "mask": ["preview", "histogram", "export"]}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def safe_path(path: Column) -> Column:
    """Relative, of plain parts only."""
    parts = F.split(path, "/")
    return ~path.rlike(r"^[/\\]|[\\:]") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def content_hash(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def same_path(a: Column, b: Column) -> Column:
    """Whether an output would overwrite its input: paths are told apart without regard to case."""
    return F.lower(a) == F.lower(b)


def decode_error(width: Column, height: Column, most: int = 4_000_000_000, bytes_per_pixel: int = 4) -> Column:
    """ok, too_large or overflow, before anything is decoded; an overflow is a result, not an exception."""
    size = F.try_multiply(F.try_multiply(width, height), F.lit(bytes_per_pixel).cast("long"))
    return F.when(size.isNull(), "overflow").when(size > most, "too_large").otherwise("ok")


def mask_states(masks: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """``masks`` with status: Valid where an artifact of the same key is there, else Pending (waiting for inference)."""
    have = artifacts.select(key, F.lit(True).alias("_have")).distinct()
    return masks.join(have, key, "left").withColumn("status", F.when(F.col("_have").isNull(), "Pending").otherwise("Valid")).drop("_have")


def copy_summary(copies: DataFrame, image: str) -> DataFrame:
    """Of copies (image, model, missing, is_default): their number, distinct missing models, defaults, and whether there is just one default."""
    out = copies.groupBy(image).agg(F.count(F.lit(1)).alias("copies"), F.count_distinct(F.when(F.col("missing"), F.col("model"))).alias("missing_models"), F.count_if("is_default").alias("defaults"))
    return out.withColumn("one_default", F.col("defaults") == 1)


def preview_key(source: Column, copy: Column) -> Column:
    return F.sha2(F.concat(source, F.char(F.lit(0)), copy), 256)


def validated(edits: DataFrame) -> DataFrame:
    """edits (key, value) with a status: ok, unknown, not_finite or out_of_range."""
    low = F.create_map(*[F.lit(x) for k, (a, _) in BOUNDS.items() for x in (k, a)])
    high = F.create_map(*[F.lit(x) for k, (_, b) in BOUNDS.items() for x in (k, b)])
    key, v = F.col("key"), F.col("value")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return edits.withColumn("status", F.when(~key.isin(*BOUNDS), "unknown").when(bad, "not_finite").when((v < F.try_element_at(low, key)) | (v > F.try_element_at(high, key)), "out_of_range").otherwise("ok"))


def history(edits: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Edits of each image in order, with the value before."""
    w = Window.partitionBy(key).orderBy(*order)
    return edits.withColumns({"step": F.row_number().over(w).cast("int"), "before": F.lag("value").over(w)})


def carried(rows: DataFrame, key: str, order: list[str], value: str, into: str) -> DataFrame:
    """``rows`` with the last non-null ``value`` of the same key at or before each row.

    Rows are sorted over the cluster by key and order, so a key with very many rows spans partitions; what each
    partition hands on (its last value of the key that it ends with) is one row a partition.
    """
    # written, so that a row's partition is the same in each of its uses
    placed = written(rows.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn(into, F.last(value, ignorenulls=True).over(within))
    ends = placed.where(F.col(value).isNotNull()).groupBy("part", key).agg(F.max_by(value, F.struct(*order)).alias("end"))
    # one row for each partition and key; a key that spans many partitions has as many rows, not as many as it has values
    before = placed.groupBy("part", key).agg(F.count(F.lit(1)).alias("n")).join(ends, ["part", key], "left")
    handed = before.withColumn("handed", F.last("end", ignorenulls=True).over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", key, "handed")
    return out.join(handed, ["part", key]).withColumn(into, F.coalesce(into, "handed")).drop("part", "handed")


def catalog_status(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Every name of either side: paired, without sidecar, or orphan sidecar."""
    a, b = images.select("name", F.lit(1).alias("i")), sidecars.select("name", F.lit(1).alias("s"))
    return a.join(b, "name", "full").select("name", F.when(F.col("s").isNull(), "no_sidecar").when(F.col("i").isNull(), "orphan_sidecar").otherwise("paired").alias("status"))


def with_preset(recipes: DataFrame, preset: dict[str, float], relative: bool = False) -> DataFrame:
    """``recipes`` (adjustments: a map, auto_tone) with a preset's keys on top.

    A relative exposure adds to the recipe's own and needs auto tone; a recipe without it stays
    as it was, with the status needs_auto_tone.
    """
    top = F.create_map(*[x for k, v in preset.items() for x in (F.lit(k), F.lit(float(v)))]) if preset else F.create_map().cast("map<string,double>")
    own = F.coalesce("adjustments", F.create_map().cast("map<string,double>"))

    def value(key: Column, a: Column, b: Column) -> Column:
        new = F.coalesce(b, a)
        return F.when((key == "exposure") & b.isNotNull(), F.coalesce(a, F.lit(0.0)) + b).otherwise(new) if relative else new

    refused = ~F.coalesce("auto_tone", F.lit(False)) if relative else F.lit(False)
    return recipes.withColumns({"status": F.when(refused, "needs_auto_tone").otherwise("ok"), "adjustments": F.when(refused, own).otherwise(F.map_zip_with(own, top, value))})


def mask_decision(facts: DataFrame, refresh: bool = False) -> DataFrame:
    """Where each mask's plane comes from; ``facts`` has booleans status_valid, artifact, source, decode, model, available. Nulls count as false."""
    is_true = lambda c: F.coalesce(F.col(c), F.lit(False))
    valid = is_true("status_valid") & is_true("artifact") & is_true("source") & is_true("decode") & is_true("model")
    out = F.when(F.lit(False) if refresh else valid, "persisted").when(is_true("available"), "inferred").when(is_true("artifact"), "cached_unavailable").otherwise("model_unavailable")
    return facts.withColumn("outcome", out)


def kept_by_recency(accesses: DataFrame, keys: list[str], entry: str, order: str, size: str, capacity: int) -> DataFrame:
    """Entries by their last access, newest first, and whether they and all newer ones fit ``capacity``."""
    last = accesses.groupBy(*keys, entry).agg(F.max(order).alias("last"), F.max_by(size, order).alias("size"))
    used = F.sum("size").over(Window.partitionBy(*keys).orderBy(F.desc("last")).rowsBetween(Window.unboundedPreceding, 0))
    return last.withColumn("kept", used <= capacity)


def deleted(copies: DataFrame, wanted: Column) -> DataFrame:
    """copies (is_default, in_trash) with what deleting those that are ``wanted`` gives: kept, deleted, already, or default, which is refused."""
    out = F.when(~F.coalesce(wanted, F.lit(False)), "kept").when(F.col("is_default"), "default").when(F.col("in_trash"), "already").otherwise("deleted")
    return copies.withColumns({"outcome": out, "in_trash": F.col("in_trash") | (out == "deleted")})


def duplicated(copies: DataFrame, key: str, name: str) -> DataFrame:
    """Each copy once more under its name with the least number that is free, and whether the source's name was unique."""
    w = Window.partitionBy(key, name)
    return copies.withColumns({"copy_name": F.concat(F.col(name), F.lit(" copy "), F.row_number().over(w.orderBy("id")).cast("string")), "unique": F.count(F.lit(1)).over(w) == 1})


def attempts(tries: DataFrame, key: str, order: list[str], ok: Column, retries: int) -> DataFrame:
    """How each job ends if it is tried up to ``retries`` times more: the first success, or failed after all; later tries never run."""
    placed = tries.withColumns({"_n": F.row_number().over(Window.partitionBy(key).orderBy(*order)), "_ok": ok}).where(F.col("_n") <= retries + 1)
    won = F.min(F.when(F.col("_ok"), F.col("_n")))
    return placed.groupBy(key).agg(won.alias("won"), F.max("_n").alias("ran")).select(key, F.when(F.col("won").isNull(), "failed").otherwise("ok").alias("status"), F.coalesce("won", "ran").cast("int").alias("used"))


def artifacts(actions: DataFrame, bundle: DataFrame) -> DataFrame:
    """actions (id, checksum) against a bundle's records: missing, mismatch or ok."""
    met = actions.join(bundle.select("id", F.col("checksum").alias("stored")), "id", "left")
    return met.withColumn("status", F.when(F.col("stored").isNull(), "missing").when(F.col("stored") != F.col("checksum"), "mismatch").otherwise("ok")).drop("stored")


def reused(analyses: DataFrame, saved: DataFrame) -> DataFrame:
    """analyses (image_id, fingerprint, value) with the saved value where its fingerprint is the same, and whether it was reused."""
    met = analyses.join(saved.select("image_id", F.col("fingerprint").alias("f"), F.col("value").alias("v")), "image_id", "left")
    same = F.coalesce(F.col("f") == F.col("fingerprint"), F.lit(False))
    return met.select("image_id", F.when(same, F.col("v")).otherwise(F.col("value")).alias("value"), same.alias("reused"))
