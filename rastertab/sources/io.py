"""Sources and sinks: long cell tables, file listings, grid payloads, JSON reports, text logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertab.functions.columns import null_if_not_finite
from rastertab.functions.grid import attach, tile_shape
from rastertab.schema import CELL_SCHEMA


def scan_cells(spark: SparkSession, path: str, tiles: Sequence[int] | None = None) -> DataFrame:
    """Long cells with an explicit schema; a tile filter reaches the Parquet scan."""
    cells = spark.read.schema(CELL_SCHEMA).parquet(path)
    return cells if tiles is None else cells.where(F.col("tile_id").isin(*tiles))


def write_cells(cells: DataFrame, path: str, files: int | None = None) -> None:
    """Cells sorted by tile and position so that row-group statistics prune on ``tile_id``.

    Range partitioning on (tile_id, row) splits a giant tile over many files.
    """
    keys = ["tile_id", "row"]
    ranged = cells.repartitionByRange(files, *keys) if files else cells.repartitionByRange(*keys)
    ranged.sortWithinPartitions("tile_id", "row", "col").write.parquet(path)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files under ``<root>/<kind>/<split>/``; contents are never read."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    )
    base = root.rstrip("/").split("/")[-1]
    relative = F.regexp_extract("path", f"/\\Q{base}\\E/(.*)$", 1)
    parts = F.split(relative, "/")
    return found.select(
        F.try_element_at(parts, F.lit(1)).alias("kind"),
        F.try_element_at(parts, F.lit(2)).alias("split"),
        "path", "length",
        F.regexp_extract(relative, r"^[^/]+/[^/]+/(.*)$", 1).alias("relative_path"),
    )


def explode_grid(df: DataFrame, grid_size: int | None = None, values: str = "values") -> DataFrame:
    """Flat row-major array to (tile_id, row, col, value); a wrong length raises at run time.

    Without ``grid_size`` the edge is the square root of the array length.
    """
    n = F.size(values)
    edge = F.lit(grid_size) if grid_size else F.round(F.sqrt(n)).cast("int")
    checked = df.withColumn("_edge", edge).withColumn(
        "_ok", F.assert_true(F.size(values) == F.col("_edge") * F.col("_edge"), F.lit("array length is not gridSize squared"))
    )
    return checked.where(F.col("_ok").isNull()).select(
        "tile_id", "_edge", F.posexplode(values).alias("pos", "value")
    ).select(
        "tile_id",
        F.floor(F.col("pos") / F.col("_edge")).cast("int").alias("row"),
        (F.col("pos") % F.col("_edge")).cast("int").alias("col"),
        "value",
    )


def pack_grid(cells: DataFrame, value: str = "value", digits: int = 3, band_rows: int = 64) -> DataFrame:
    """Cells back to row-major arrays rounded to ``digits`` decimals: (tile_id, first_row, values).

    Every tile, whatever its size, comes in bands of ``band_rows`` rows (the last may have fewer), so no array grows
    with the number of rows. Missing cells are NULL.
    """
    placed = attach(cells, tile_shape(cells), how="inner").withColumn(
        "first_row", (F.floor(F.col("row") / band_rows) * band_rows).cast("int")
    )
    entry = F.struct(
        ((F.col("row") - F.col("first_row")) * F.col("cols") + F.col("col")).cast("int").alias("at"), F.round(F.col(value), digits).alias("v")
    )
    grouped = placed.groupBy("tile_id", "first_row", "rows", "cols").agg(
        F.map_from_entries(F.collect_list(entry)).alias("_m")
    )
    length = (F.least(F.lit(band_rows), F.col("rows") - F.col("first_row")) * F.col("cols")).cast("int")
    return grouped.select(
        "tile_id", "first_row",
        F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.try_element_at(F.col("_m"), i)).alias("values"),
    )


METRICS_SCHEMA = (
    "per_sample array<struct<sample:string,`group`:string,rmse:double,mae:double,correlation:double,"
    "semantic_miou:double,building_iou:double,building_boundary_f1:double,boundary_f1:double,"
    "valid_pixels:bigint,per_class_iou:map<string,double>>>"
)


def read_run_metrics(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Per-sample records of nested metrics JSON, one row per sample.

    ``multi_line`` reads one document per file, otherwise one document per line (splittable).
    """
    raw = spark.read.schema(METRICS_SCHEMA).json(path, multiLine=multi_line)
    return raw.select(F.input_file_name().alias("run"), F.inline("per_sample"))


def explode_class_iou(samples: DataFrame) -> DataFrame:
    """One row per sample and class."""
    return samples.select("run", "sample", F.explode("per_class_iou").alias("class_name", "iou"))


def without_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in every double column and double map."""
    out = []
    for name, kind in df.dtypes:
        if kind == "double":
            out.append(null_if_not_finite(name).alias(name))
        elif kind == "map<string,double>":
            out.append(F.transform_values(name, lambda _k, v: null_if_not_finite(v)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def write_tile_metrics(df: DataFrame, path: str) -> None:
    """One JSON line per tile under split=…; non-finite numbers become NULL."""
    without_non_finite(df).write.partitionBy("split").json(path)


def write_manifest(samples: DataFrame, splits: DataFrame, totals: DataFrame, path: str) -> None:
    """Manifest as three JSON-lines folders: samples, splits, totals.

    **Departure**: samples are lines of their own and not one array in one document, so that a
    release with many millions of samples never meets in one task.
    """
    samples.write.json(f"{path}/samples")
    splits.write.json(f"{path}/splits")
    totals.write.json(f"{path}/totals")


def parse_training_log(lines: DataFrame) -> DataFrame:
    """Epoch lines of a text log (column ``value``) to typed columns; other lines are dropped.

    Further input columns are kept.
    """
    kept = [c for c in lines.columns if c != "value"]

    def field(pattern: str, kind: str = "double"):
        return F.regexp_extract("value", pattern, 1).try_cast(kind)

    return lines.where(F.col("value").rlike(r"Epoch \d+/\d+")).select(
        *kept,
        field(r"^([\d.]+)s").alias("elapsed_sec"),
        field(r"Epoch (\d+)/", "int").alias("epoch"),
        field(r"Epoch \d+/(\d+)", "int").alias("epochs"),
        field(r"Train Loss: ([\d.eE+-]+)").alias("train_loss"),
        field(r"Val RMSE: ([\d.eE+-]+)m").alias("rmse"),
        field(r"MAE: ([\d.eE+-]+)m").alias("mae"),
        field(r"Pearson R: ([\d.eE+-]+)").alias("correlation"),
        field(r"LR: ([\d.eE+-]+)").alias("lr"),
    )


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_training_log(spark.read.text(path))
