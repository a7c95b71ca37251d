"""Dataset catalogue: pairing, grouping, splitting. Rows are files or samples, never pixels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertab.functions.columns import as_col, unit_hash
from rastertab.functions.grid import attach
from rastertab.functions.ranking import spread_rank
from rastertab.functions.state import settle

# Suffixes that mark the modality of a file.
PAIR_SUFFIXES = (
    "_IMG", "_RGB", "_AGL", "_DSM", "_HEIGHT", "_CLASS",
    "_CLS", "_CLASSES", "_LABEL", "_LABELS", "_SEMANTIC", "_SEMANTICS",
)
KINDS = ("images", "heights", "classes")


def file_name(path) -> Column:
    return F.regexp_extract(as_col(path), r"([^/]*)$", 1)


def file_stem(path) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def pair_key(path) -> Column:
    """Upper-case stem with any run of modality suffixes stripped."""
    run = "|".join(s[1:] for s in PAIR_SUFFIXES)
    return F.regexp_replace(F.upper(file_stem(path)), f"(_({run}))+$", "")


def with_pair_key(files: DataFrame) -> DataFrame:
    return files if "key" in files.columns else files.withColumn("key", pair_key("path"))


def _matches(files: DataFrame) -> DataFrame:
    """Number of files and least path of each kind per (split, key)."""
    aggs = []
    for kind in KINDS:
        own = F.col("kind") == kind
        aggs += [F.count_if(own).alias(f"n_{kind}"), F.min(F.when(own, F.col("path"))).alias(kind)]
    return with_pair_key(files).groupBy("split", "key").agg(*aggs)


def pair_triplets(files: DataFrame) -> DataFrame:
    """One row per (split, key) with exactly one image, height and class file."""
    exact = (F.col("n_images") == 1) & (F.col("n_heights") == 1) & (F.col("n_classes") == 1)
    return _matches(files).where(exact).select(
        "split", "key", F.col("images").alias("image"), F.col("heights").alias("height"), "classes"
    )


def ambiguous_keys(files: DataFrame) -> DataFrame:
    """Keys that have an image but not exactly one file of each kind, with the counts."""
    off = (F.col("n_images") != 1) | (F.col("n_heights") != 1) | (F.col("n_classes") != 1)
    return _matches(files).where((F.col("n_images") > 0) & off).select(
        "split", "key", "n_images", "n_heights", "n_classes"
    )


def orphan_targets(files: DataFrame) -> DataFrame:
    """Height and class keys without an image."""
    keyed = with_pair_key(files)
    images = keyed.where(F.col("kind") == "images").select("split", "key").distinct()
    targets = keyed.where(F.col("kind").isin("heights", "classes")).select("split", "kind", "key").distinct()
    return targets.join(images, ["split", "key"], "left_anti")


def missing_modalities(files: DataFrame) -> DataFrame:
    """Images that lack a height or a class file, one row per missing modality."""
    found = _matches(files).where(F.col("n_images") > 0)
    lacking = F.filter(
        F.array(F.when(F.col("n_heights") == 0, F.lit("height")), F.when(F.col("n_classes") == 0, F.lit("class"))),
        lambda m: m.isNotNull(),
    )
    return found.select("split", "key", F.col("images").alias("image"), F.explode(lacking).alias("missing"))


def pair_exact(files: DataFrame, image_suffix: str = "_RGB", height_suffix: str = "_AGL") -> DataFrame:
    """Pairs ``<id>_RGB`` with ``<id>_AGL`` by the exact prefix; unpaired files are dropped."""

    def side(kind: str, suffix: str, name: str) -> DataFrame:
        return files.where(F.col("kind") == kind).select(
            "split", F.regexp_extract(file_name("path"), f"^(.*){suffix}\\.h5$", 1).alias("id"), F.col("path").alias(name)
        ).where(F.col("id") != "")

    return side("images", image_suffix, "image").join(side("heights", height_suffix, "height"), ["split", "id"])


def group_of(relative_path, rule: str = "audit") -> Column:
    """Geographic group of an image path relative to the images folder of its split.

    "audit": parent folders, else the stem up to the first ``_`` or ``-``; "first_dir": first
    folder, else ''; "final": parent folders, else the stem without its last ``_part``; "city": file
    name up to the first ``_``.
    """
    path = as_col(relative_path)
    parents = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    nested = path.contains("/")
    stem = file_stem(path)
    if rule == "audit":
        return F.when(nested, parents).otherwise(F.regexp_extract(stem, r"^([^_-]*)", 1))
    if rule == "first_dir":
        return F.when(nested, F.substring_index(path, "/", 1)).otherwise("")
    if rule == "final":
        return F.when(nested, parents).otherwise(F.regexp_replace(stem, r"_[^_]*$", ""))
    if rule == "city":
        return F.substring_index(file_name(path), "_", 1)
    raise ValueError(f"unknown group rule {rule!r}")


def stratified_sample(samples: DataFrame, targets: DataFrame, seed: int = 7, city: str = "city") -> DataFrame:
    """Per split and city max(1, min(n, round(target * n / total))) samples, then capped at the target.

    ``targets`` is (split, target). **Departure**: the order comes from a hash of (seed, key), not
    from a shuffled generator, so the choice is stable under any partitioning.
    """
    samples = settle(samples, "samples")  # read four times below
    per_city = samples.groupBy("split", city).agg(F.count(F.lit(1)).alias("_n"))
    totals = samples.groupBy("split").agg(F.count(F.lit(1)).alias("_total"))
    shares = per_city.join(totals, "split").join(targets, "split").withColumn(
        "_share",
        F.greatest(
            F.lit(1), F.least(F.col("_n"), F.bround(F.col("target") * F.col("_n") / F.col("_total")).cast("bigint"))
        ),
    ).drop("_n", "_total")
    bounded = attach(samples, shares, ["split", city], "inner", spread=["key"])
    chosen = spread_rank(
        bounded, ["split", city], unit_hash(seed, F.col("key")), ["key"], "_rank", limit=F.col("_share")
    )
    capped = spread_rank(
        settle(chosen, "chosen"), ["split"], unit_hash(seed + 1, F.col("key")), ["key"], "_order", limit=F.col("target")
    )
    return capped.drop("_rank", "_share", "_order", "target")


def _validation_groups(samples: DataFrame, validation: Sequence[str] | None) -> DataFrame:
    spark = samples.sparkSession
    if validation:
        return spark.createDataFrame([(g,) for g in validation], "group string")
    # ranges of names are sorted on their own; only the ranges' sizes are accumulated
    down = F.col("group").desc()
    groups = samples.select("group").distinct().repartitionByRange(down).withColumn("_part", F.spark_partition_id())
    groups = settle(groups, "groups")
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = groups.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.greatest(F.lit(1), F.floor(F.sum("_n").over(everything) / 5)).alias("_held"),
    )
    place = F.row_number().over(Window.partitionBy("_part").orderBy(down)) + F.col("_off")
    return groups.join(sizes, "_part").withColumn("_place", place).where("_place <= _held").select("group")


def split_by_group(samples: DataFrame, validation: Sequence[str] | None = None) -> DataFrame:
    """Adds ``role`` (train or validation), holding out whole groups; default: the last fifth, at least one."""
    held = _validation_groups(samples, validation).withColumn("_held", F.lit(True))
    others = [c for c in samples.columns if c != "group"]
    return attach(samples, held, ["group"], spread=others or ["group"]).withColumn(
        "role", F.when(F.col("_held"), "validation").otherwise("train")
    ).drop("_held")


def split_problems(samples: DataFrame, validation: Sequence[str] | None = None) -> DataFrame:
    """Reasons why the split must not be used, one row each; no row means usable."""
    roles = split_by_group(samples, validation).agg(
        F.countDistinct("group").alias("groups"),
        F.count_if(F.col("group") == "").alias("blank"),
        F.count_if(F.col("role") == "train").alias("train"),
        F.count_if(F.col("role") == "validation").alias("held"),
    )
    checks = F.array(
        F.when(F.col("blank") > 0, F.lit("blank_group")),
        F.when((F.col("groups") < 2) & F.lit(not validation), F.lit("fewer_than_two_groups")),
        F.when(F.col("train") == 0, F.lit("empty_train")),
        F.when(F.col("held") == 0, F.lit("empty_validation")),
    )
    found = roles.select(F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("problem"), F.lit(None).cast("string").alias("group"))
    if not validation:
        return found
    wanted = samples.sparkSession.createDataFrame([(g,) for g in validation], "group string")
    unknown = wanted.join(samples.select("group").distinct(), "group", "left_anti")
    return found.unionByName(unknown.select(F.lit("unknown_group").alias("problem"), "group"))


def first_n_per_split(samples: DataFrame, limits: Mapping[str, int], name: str = "key") -> DataFrame:
    """The first n samples by name of each split named in ``limits``.

    The rank filter is a literal bound, so Spark keeps only that many rows per split in every task
    before it shuffles.
    """
    wanted = samples.where(F.col("split").isin(*limits))
    order = Window.partitionBy("split").orderBy(name)
    ranked = wanted.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max(limits.values()))
    own = F.lit(0)
    for split, n in limits.items():
        own = F.when(F.col("split") == split, F.lit(n)).otherwise(own)
    return ranked.where(F.col("_rank") <= own).drop("_rank")


def completeness(samples: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Observed against expected counts per split with one overall status on each row."""
    seen = samples.groupBy("split").agg(F.count(F.lit(1)).alias("observed"))
    if expected is None:
        return seen.select(
            "split", "observed", F.lit(None).cast("bigint").alias("expected"),
            F.lit("unknown_completeness").alias("status"),
        )
    both = seen.join(expected, "split", "full_outer").select(
        "split", F.coalesce("observed", F.lit(0)).alias("observed"), F.col("expected").cast("bigint")
    )
    everything = Window.partitionBy(F.lit(0))  # a handful of splits
    equal = F.bool_and(F.coalesce(F.col("observed") == F.col("expected"), F.lit(False))).over(everything)
    return both.withColumn("status", F.when(equal, "complete_attached_dataset").otherwise("subset"))


def upsert_by_key(old: DataFrame, new: DataFrame, key: str = "name", notes: DataFrame | None = None) -> DataFrame:
    """New records replace old ones of the same key, the rest stays; ``notes`` (key, finding) may be attached."""
    merged = old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
    return merged if notes is None else merged.join(notes, key, "left")


def group_counts(samples: DataFrame) -> DataFrame:
    """Samples per split and group, per split and in total (rollup)."""
    return samples.rollup("split", "group").agg(F.count(F.lit(1)).alias("samples"))


def key_consistency(keys: DataFrame) -> DataFrame:
    """Per kind: files, distinct dataset-key lists, and whether all files agree. Input (path, kind, key)."""
    per_file = keys.groupBy("kind", "path").agg(F.concat_ws(",", F.sort_array(F.collect_set("key"))).alias("keys"))
    return per_file.groupBy("kind").agg(
        F.count(F.lit(1)).alias("files"), F.countDistinct("keys").alias("key_lists"), F.min("keys").alias("first_keys")
    ).withColumn("consistent", F.col("key_lists") == 1)
