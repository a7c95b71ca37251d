"""Pixel audit and cleaning over long cell tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertab.functions.columns import finite, ratio
from rastertab.functions.grid import attach, tile_shape
from rastertab.functions.quantiles import exact_quantiles
from rastertab.schema import BUILDING, CLASS_COUNT, CLASS_NAMES, VOID_CLASS


def _legal():
    return F.coalesce(F.col("class").between(0, CLASS_COUNT - 1), F.lit(False))


def with_validity(cells: DataFrame) -> DataFrame:
    """valid = finite height and class in 0..6 (255 is void, not valid)."""
    return cells.withColumn("valid", finite("height") & _legal())


def clean_invalid(cells: DataFrame) -> DataFrame:
    """Non-finite heights become 0, classes become 0 where the cell is invalid."""
    marked = with_validity(cells)
    return marked.withColumn("height", F.when(finite("height"), F.col("height")).otherwise(0.0)).withColumn(
        "class", F.when(F.col("valid"), F.col("class")).otherwise(0)
    )


def clamp_height(cells: DataFrame, low: float = 0.0, high: float = 300.0) -> DataFrame:
    """Non-finite to 0, then clip to the range."""
    h = F.when(finite("height"), F.col("height")).otherwise(0.0)
    return cells.withColumn("height", F.greatest(F.lit(low), F.least(F.lit(high), h)))


def invalid_class_ids(cells: DataFrame, allow_void: bool = True) -> DataFrame:
    """(tile_id, class, pixels) of class ids outside 0..6; a tile without rows passes."""
    bad = ~_legal() & (F.col("class") != VOID_CLASS if allow_void else F.lit(True))
    return cells.where(bad).groupBy("tile_id", "class").agg(F.count(F.lit(1)).alias("pixels"))


def shape_mismatch(cells_by_modality: DataFrame) -> DataFrame:
    """Tiles whose modalities differ in rows x cols; input has a ``modality`` column."""
    shapes = tile_shape(cells_by_modality, ["tile_id", "modality"])
    size = F.struct("rows", "cols")
    return (
        shapes.groupBy("tile_id")
        .agg(F.min(size).alias("smallest"), F.max(size).alias("largest"), F.count(F.lit(1)).alias("modalities"))
        .where(F.col("smallest") != F.col("largest"))
        .select(
            "tile_id", "modalities",
            F.col("smallest.rows").alias("min_rows"), F.col("smallest.cols").alias("min_cols"),
            F.col("largest.rows").alias("max_rows"), F.col("largest.cols").alias("max_cols"),
        )
    )


# The percentiles a height report carries.
STAT_PERCENTILES = (0, 1, 5, 25, 50, 75, 95, 99, 100)
SPLIT_PERCENTILES = (0, 50, 75, 90, 95, 99, 99.5, 99.9, 100)


def _named(percentiles: Sequence[float]) -> dict[str, float]:
    return {f"p{str(p).replace('.', '_')}": p / 100.0 for p in percentiles}


def height_stats(cells: DataFrame, by: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Finite count, min, max and interpolated percentiles of finite heights.

    Groups without a finite height keep count 0, NULL min/max and NULL percentiles (the source
    material reports 0.0 for the latter).
    """
    h = F.when(finite("height"), F.col("height"))
    base = cells.groupBy(*by).agg(
        F.count(h).alias("finite_count"), F.min(h).alias("min"), F.max(h).alias("max")
    )
    return base.join(exact_quantiles(cells, list(by), h, _named(STAT_PERCENTILES)), list(by), "left")


def split_height_percentiles(cells: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Exact percentiles of all finite heights per split; the source material takes a strided sample per tile."""
    h = F.when(finite("height"), F.col("height"))
    return exact_quantiles(cells, list(by), h, _named(SPLIT_PERCENTILES), count_name="sampled")


def _rolled_up(cells: DataFrame, by: Sequence[str], counts: Sequence[Column]) -> DataFrame:
    """Rollup of ``counts`` by ``by``: pixels are counted per group first, only those counts are rolled up."""
    fine = cells.groupBy(*by).agg(*counts)
    return fine.rollup(*by).agg(*[F.sum(c).alias(c) for c in fine.columns[len(by):]])


def class_histogram(cells: DataFrame, by: Sequence[str] = ("split", "tile_id")) -> DataFrame:
    """Valid pixels per class, per tile, per split and in total (rollup); absent classes count 0."""
    counts = [F.count_if(F.col("class") == c).alias(f"c{c}") for c in range(CLASS_COUNT)]
    rolled = _rolled_up(with_validity(cells).where("valid"), by, counts)
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"c{c}").alias("pixels")) for c in range(CLASS_COUNT)])
    return rolled.select(*by, F.inline(rows))


def class_totals(cells: DataFrame) -> DataFrame:
    """(class, n) over all valid pixels with absent classes as 0."""
    counts = [F.count_if(F.col("class") == c).alias(f"c{c}") for c in range(CLASS_COUNT)]
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"c{c}").alias("n")) for c in range(CLASS_COUNT)])
    return with_validity(cells).where("valid").agg(*counts).select(F.inline(rows))


def invalid_pixel_counts(cells: DataFrame, by: Sequence[str] = ("split", "tile_id")) -> DataFrame:
    """Non-finite, illegal, void and total invalid pixels per tile and per split (rollup)."""
    void = F.col("class") == VOID_CLASS
    counts = [
        F.count_if(~finite("height")).alias("height_nonfinite"),
        F.count_if(~_legal() & ~F.coalesce(void, F.lit(False))).alias("class_illegal"),
        F.count_if(void).alias("void"),
        F.count_if(~F.col("valid")).alias("total_invalid"),
        F.count_if("valid").alias("valid_pixels"),
    ]
    return _rolled_up(with_validity(cells), by, counts)


def building_fraction(cells: DataFrame, by: Sequence[str] = ("split", "tile_id")) -> DataFrame:
    """Valid building pixels over max(valid pixels, 1), per tile and per split."""
    counts = [
        F.count_if(F.col("valid") & (F.col("class") == BUILDING)).alias("building"),
        F.count_if("valid").alias("valid_pixels"),
    ]
    sums = _rolled_up(with_validity(cells), by, counts)
    return sums.withColumn("fraction", F.col("building") / F.greatest(F.col("valid_pixels"), F.lit(1)))


def _count_map():
    entries = [
        F.struct(F.lit(str(c)).alias("key"), F.col(f"c{c}").alias("value")) for c in range(CLASS_COUNT)
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] > 0))


def audit_samples(cells: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One nested audit record per tile: height stats, class counts, invalid pixels, building share.

    ``samples`` may bring (tile_id, group, files…) to join in.
    """
    marked = with_validity(cells)
    counts = [F.count_if(F.col("valid") & (F.col("class") == c)).alias(f"c{c}") for c in range(CLASS_COUNT)]
    sums = marked.groupBy("split", "tile_id").agg(
        *counts,
        F.count_if(~finite("height")).alias("height_nonfinite"),
        F.count_if(~_legal()).alias("class_id_invalid"),
        F.count_if(~F.col("valid")).alias("total_invalid"),
        F.count_if("valid").alias("valid_pixel_count"),
        (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"),
    )
    stats = height_stats(marked, ["split", "tile_id"])
    names = list(_named(STAT_PERCENTILES))
    joined = sums.join(stats, ["split", "tile_id"])
    percentiles = F.map_from_arrays(
        F.array(*[F.lit(n[1:]) for n in names]), F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names])
    )
    records = joined.select(
        "split", "tile_id",
        F.array("rows", "cols").alias("shape"),
        F.struct("finite_count", "min", "max", percentiles.alias("percentiles")).alias("height_stats"),
        _count_map().alias("class_counts"),
        F.map_keys(_count_map()).alias("class_ids"),
        F.struct("height_nonfinite", "class_id_invalid", "total_invalid").alias("invalid_pixels"),
        "valid_pixel_count",
        (F.col(f"c{BUILDING}") / F.greatest("valid_pixel_count", F.lit(1))).alias("building_pixel_fraction"),
    )
    return records if samples is None else records.join(samples, "tile_id", "left")


def audit_splits(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """One nested record per split: sample count, sampled height stats, class counts, totals.

    ``samples`` is the output of :func:`audit_samples`.
    """
    sampled = height_stats(cells, ["split"])
    names = list(_named(STAT_PERCENTILES))
    sums = [F.sum(F.coalesce(F.col("class_counts")[str(c)], F.lit(0))).alias(f"c{c}") for c in range(CLASS_COUNT)]
    totals = samples.groupBy("split").agg(
        F.count(F.lit(1)).alias("sample_count"), *sums,
        F.sum("valid_pixel_count").alias("valid_pixel_count"),
        F.sum("invalid_pixels.total_invalid").alias("invalid_pixel_count"),
    )
    percentiles = F.map_from_arrays(F.array(*[F.lit(n[1:]) for n in names]), F.array(*names))
    return totals.join(sampled, "split", "left").select(
        "split", "sample_count",
        F.struct("finite_count", "min", "max", percentiles.alias("percentiles")).alias("height_stats"),
        F.lit(False).alias("height_percentiles_are_sampled"),
        _count_map().alias("class_counts"),
        "valid_pixel_count", "invalid_pixel_count",
        (F.col(f"c{BUILDING}") / F.greatest("valid_pixel_count", F.lit(1))).alias("building_pixel_fraction"),
    )


def audit_totals(splits: DataFrame, dataset_id: str, revision: str) -> DataFrame:
    """The single header record of a manifest."""
    if not dataset_id or not revision:
        raise ValueError("a manifest needs a dataset id and a revision")
    return splits.agg(
        F.sum("sample_count").alias("total_sample_count"),
        F.sum("valid_pixel_count").alias("total_valid_pixel_count"),
        F.sum("invalid_pixel_count").alias("total_invalid_pixel_count"),
    ).select(
        F.lit(1).alias("schema_version"),
        F.struct(
            F.lit(dataset_id).alias("id"), F.lit(revision).alias("revision"),
            F.current_timestamp().alias("audited_at_utc"),
        ).alias("dataset"),
        "*",
    )


def class_weights(histogram: DataFrame, rule: str = "balanced") -> DataFrame:
    """Weight per class from (class, n): "inv_sqrt" or "balanced" (clipped to 0.5..3)."""
    everything = Window.partitionBy(F.lit(0))  # seven rows
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    if rule == "inv_sqrt":
        raw = 1.0 / F.sqrt(n)
    elif rule == "balanced":
        total = F.greatest(F.sum("n").over(everything).cast("double"), F.lit(1.0))
        raw = F.sqrt(total / (CLASS_COUNT * n))
    else:
        raise ValueError(f"unknown class weight rule {rule!r}")
    scaled = histogram.withColumn("_raw", raw).withColumn("_mean", F.avg("_raw").over(everything))
    weight = F.col("_raw") / F.greatest(F.col("_mean"), F.lit(1e-6))
    if rule == "balanced":
        weight = F.greatest(F.lit(0.5), F.least(F.lit(3.0), weight))
    return scaled.withColumn("weight", weight).drop("_raw", "_mean")


def height_scale(cells: DataFrame, p: float = 99.5, split: str = "train") -> DataFrame:
    """max(1, p-th percentile) of all finite training heights; one row."""
    sample = cells.where((F.col("split") == split) & finite("height")).withColumn("_k", F.lit(0))
    return exact_quantiles(sample, ["_k"], "height", {"_p": p / 100.0}).select(
        F.greatest(F.lit(1.0), F.col("_p")).alias("height_scale")
    )


def _rgb(bands: DataFrame) -> DataFrame:
    return bands.groupBy("tile_id", "row", "col").agg(
        *[F.max(F.when(F.col("band") == i, F.col("value"))).alias(n) for i, n in enumerate("rgb")]
    )


def decode_palette(bands: DataFrame, palette: DataFrame | None = None) -> DataFrame:
    """Class ids from an RGB class image.

    A tile whose bands are all equal carries ids directly; otherwise (r, g, b) is looked up in
    ``palette`` (r, g, b, class), unmatched -1. Without a palette the class is NULL and
    :func:`palette_problems` lists the tile.
    """
    pixels = _rgb(bands)
    grey = pixels.groupBy("tile_id").agg(
        F.bool_and((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("_grey")
    )
    marked = attach(pixels, grey)
    if palette is None:
        looked_up = marked.withColumn("_class", F.lit(None).cast("int"))
    else:
        looked_up = marked.join(palette.withColumnRenamed("class", "_class"), ["r", "g", "b"], "left")
        looked_up = looked_up.withColumn("_class", F.coalesce("_class", F.lit(-1)))
    return looked_up.select(
        "tile_id", "row", "col",
        F.when(F.col("_grey"), F.col("r").cast("int")).otherwise(F.col("_class")).alias("class"),
    )


def palette_problems(bands: DataFrame) -> DataFrame:
    """Tiles that need an explicit palette, with their number of distinct colours."""
    return (
        _rgb(bands)
        .groupBy("tile_id")
        .agg(
            F.bool_and((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("_grey"),
            F.countDistinct("r", "g", "b").alias("colours"),
        )
        .where(~F.col("_grey"))
        .drop("_grey")
    )


# Largest value of the integer band types.
INTEGER_MAX = {"uint8": 255, "int16": 32767, "uint16": 65535, "int32": 2147483647, "uint32": 4294967295}


def normalize_bands(bands: DataFrame, dtype: str = "float32") -> DataFrame:
    """Bands to 0..255: uint8 unchanged, integers by their type maximum, floats stretched over p2..p98."""
    if dtype == "uint8":
        return bands
    value = F.when(finite("value"), F.col("value")).otherwise(0.0)

    def clipped(c):
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c))).cast("int")

    if dtype in INTEGER_MAX:
        return bands.withColumn("value", clipped(value / float(INTEGER_MAX[dtype]) * 255))
    sample = bands.where("valid") if "valid" in bands.columns else bands
    limits = exact_quantiles(sample, ["tile_id", "band"], value, {"_lo": 0.02, "_hi": 0.98})
    joined = attach(bands, limits, ["tile_id", "band"])
    stretched = F.try_divide(value - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 255
    return joined.withColumn(
        "value", F.when(F.col("_hi") > F.col("_lo"), clipped(stretched)).otherwise(0)
    ).drop("_lo", "_hi")


def fill_nodata_median(bands: DataFrame) -> DataFrame:
    """Invalid pixels take the truncated median of the valid ones of their tile and band (0 if none)."""
    medians = exact_quantiles(bands.where("valid"), ["tile_id", "band"], "value", {"_m": 0.5})
    filled = F.coalesce(F.col("_m").cast("bigint").cast("double"), F.lit(0.0))
    return attach(bands, medians, ["tile_id", "band"]).withColumn(
        "value", F.when(F.col("valid"), F.col("value")).otherwise(filled)
    ).drop("_m")


def valid_fraction(cells: DataFrame) -> DataFrame:
    """Share of valid pixels per tile and a flag for tiles with none; needs ``valid``."""
    return cells.groupBy("tile_id").agg(F.avg(F.col("valid").cast("double")).alias("valid_fraction")).withColumn(
        "no_valid_pixels", F.col("valid_fraction") == 0
    )


def rescale_unit_images(bands: DataFrame) -> DataFrame:
    """Images whose largest value is <= 1.5 are taken as 0..1 and multiplied by 255; clip, truncate."""
    top = bands.groupBy("tile_id").agg(F.max(F.when(finite("value"), F.col("value"))).alias("_top"))
    scaled = F.when(F.col("_top") <= 1.5, F.col("value") * 255.0).otherwise(F.col("value"))
    return attach(bands, top).withColumn(
        "value", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled))).cast("int")
    ).drop("_top")


# Channel mean and deviation of the usual image normalisation.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def standardize_bands(bands: DataFrame) -> DataFrame:
    """(v / 255 - mean) / std per band."""
    at = (F.col("band") + 1).cast("int")
    mean = F.element_at(F.array(*[F.lit(v) for v in CHANNEL_MEAN]), at)
    std = F.element_at(F.array(*[F.lit(v) for v in CHANNEL_STD]), at)
    return bands.withColumn("value", (F.col("value") / 255.0 - mean) / std)


def prediction_gate(pred: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Problems of a prediction per tile; an empty list passes.

    ``expected`` gives rows and cols per tile (default: the extent of the prediction itself).
    """
    ok = finite("pred_height")
    h = F.when(ok, F.col("pred_height"))
    sums = pred.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(~ok).alias("non_finite"), F.stddev_pop(h).alias("spread"),
        F.count_if(~F.coalesce(F.col("pred_class").between(0, CLASS_COUNT - 1), F.lit(False))).alias("bad_class"),
        (F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"),
    )
    if expected is None:
        sized = sums.withColumn("_want", F.col("_rows") * F.col("_cols"))
    else:
        sized = sums.join(expected.select("tile_id", (F.col("rows") * F.col("cols")).alias("_want")), "tile_id", "right")
    checks = [
        ("missing_cells", F.coalesce(F.col("cells"), F.lit(0)) != F.col("_want")),
        ("non_finite", F.col("non_finite") > 0),
        ("constant_height", F.coalesce(F.col("spread"), F.lit(0.0)) <= 1e-8),
        ("class_out_of_range", F.col("bad_class") > 0),
    ]
    problems = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda p: p.isNotNull())
    return sized.select("tile_id", problems.alias("problems"))


def non_finite_report(df: DataFrame) -> DataFrame:
    """Non-finite values per numeric column (each must be 0)."""
    numeric = [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    sums = df.agg(*[F.count_if(~finite(c)).alias(c) for c in numeric])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("non_finite")) for c in numeric])
    return sums.select(F.inline(rows))


def class_fractions(cells: DataFrame) -> DataFrame:
    """Share of cells per class name per tile, one column per class."""
    return cells.groupBy("tile_id").agg(
        *[F.avg((F.col("class") == c).cast("double")).alias(n) for c, n in enumerate(CLASS_NAMES)]
    )


def height_range(cells: DataFrame) -> DataFrame:
    """Heights clipped at 0 (0 where invalid) with an 8-bit preview scaled by the tile maximum."""
    usable = F.col("valid") & finite("height")
    clean = F.when(usable, F.greatest(F.col("height"), F.lit(0.0))).otherwise(0.0)
    base = cells.withColumn("height", clean)
    h = F.when(F.col("valid"), F.col("height"))
    limits = base.groupBy("tile_id").agg(F.min(h).alias("min_height"), F.max(h).alias("max_height"))
    scaled = F.col("height") / F.greatest(F.coalesce("max_height", F.lit(0.0)), F.lit(1e-6)) * 255
    return attach(base, limits).withColumn(
        "preview", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled))).cast("int")
    )
