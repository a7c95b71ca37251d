"""Raster views derived by Spark from the relational test tables (and their SQL twins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertab.functions.ranking import value_rank
from rastertab.schema import BUILDING, ROAD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 x 32 tiles laid over the event stream; the last tile is partial."""
    e = table(spark, sf_dir, "events").select(
        F.expr("event_id div 1024").alias("tile_id"),
        F.floor((F.col("event_id") % 1024) / 32).cast("int").alias("row"),
        (F.col("event_id") % 32).cast("int").alias("col"),
        F.col("value").alias("height"),
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
        "event_id",
    )
    r8, c8 = F.col("row") % 8, F.col("col") % 8
    e = e.withColumn(
        "b",
        ((3 * F.floor(F.col("row") / 8) + 5 * F.floor(F.col("col") / 8) + F.col("tile_id")) % 16).cast("int"),
    )
    box = r8.between(2, 5 + F.col("b") % 2) & c8.between(2, 4 + F.col("b") % 3) & (F.col("k") % 11 != 0)
    open_land = F.element_at(F.array(*[F.lit(v) for v in (1, 1, 1, 0, 2, 6)]), (F.col("k") % 6 + 1).cast("int"))
    land = F.element_at(
        F.array(*[F.lit(v) for v in ("urban", "sparse", "hilly", "forested")]),
        (F.col("tile_id") % 4 + 1).cast("int"),
    )
    return e.select(
        "tile_id", "row", "col", "height",
        F.when((r8 == 0) | (c8 == 0), F.lit(ROAD))
        .when(F.col("b") == 0, F.lit(4))
        .when(box, F.lit(BUILDING))
        .otherwise(open_land)
        .alias("class"),
        (F.col("k") / 100.0).alias("boundary"),
        land.alias("landscape"),
        "k", "event_id",
    )


def cells_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cells with NULL and NaN heights, void cells and an illegal class."""
    k = F.col("k")
    height = (
        F.when(k % 34 == 0, F.lit(None).cast("double"))
        .when(k % 17 == 0, F.lit(float("nan")))
        .otherwise(F.col("height"))
    )
    label = F.when(F.col("event_id") % 997 == 0, F.lit(99)).when(k % 19 == 0, F.lit(255)).otherwise(F.col("class"))
    split = F.when(F.col("tile_id") % 10 == 0, "val").when(F.col("tile_id") % 10 == 1, "test").otherwise("train")
    return (
        cells(spark, sf_dir)
        .withColumn("height", height)
        .withColumn("class", label)
        .withColumn("split", split)
    )


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with a damped height and the class of the cell to the left, wrapping."""
    base = cells(spark, sf_dir)
    moved = base.select(
        "tile_id", "row", ((F.col("col") + 1) % 32).cast("int").alias("col"), F.col("class").alias("pred_class"),
        F.col("boundary").alias("_b"),
    )
    return base.join(moved, ["tile_id", "row", "col"]).select(
        *base.columns,
        (F.lit(0.92) * F.col("height") + F.lit(0.65)).alias("pred_height"),
        "pred_class",
        ((F.col("_b") - 0.5) * 4.0).alias("pred_boundary_logit"),
        (F.col("height") >= 0).alias("valid"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as (target, predicted) pairs for pooled metrics at volume."""
    return table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus",
        F.col("l_extendedprice").alias("height"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pred_height"),
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven class scores on a 3 x 3 grid per embedding vector; its last value is a bias of the last class."""
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").alias("tile_id"), F.get("embedding", F.lit(63)).alias("bias"), F.posexplode("embedding").alias("pos", "v"))
        .where(F.col("pos") < 63)
        .select(
            "tile_id",
            F.floor((F.col("pos") % 9) / 3).cast("int").alias("row"),
            (F.col("pos") % 3).cast("int").alias("col"),
            F.floor(F.col("pos") / 9).cast("int").alias("class"),
            (F.col("v").cast("double") + F.when(F.col("pos") >= 54, F.col("bias").cast("double")).otherwise(0.0)).alias("logit"),
        )
    )


def grid8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat 64-value raster per embedding vector."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("tile_id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("values"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three modality files per document, with gaps and duplicates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    split = F.when(F.col("doc_id") % 10 == 0, "val").when(F.col("doc_id") % 10 == 1, "test").otherwise("train")
    stem = F.concat_ws("_", "source", F.col("doc_id").cast("string"))
    d = F.col("doc_id")
    kinds = F.array(
        F.when(d % 43 != 0, F.struct(F.lit("images").alias("kind"), F.lit("_RGB").alias("suffix"))),
        F.when(d % 37 != 0, F.struct(F.lit("heights").alias("kind"), F.lit("_AGL").alias("suffix"))),
        F.struct(F.lit("classes").alias("kind"), F.lit("_CLS").alias("suffix")),
        F.when(d % 41 == 0, F.struct(F.lit("classes").alias("kind"), F.lit("_CLASSES").alias("suffix"))),
    )
    return (
        docs.select(
            "doc_id", "source", split.alias("split"), stem.alias("stem"),
            F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("m"),
        )
        .select(
            "split",
            F.col("m.kind").alias("kind"),
            F.concat("m.kind", F.lit("/"), "split", F.lit("/"), "stem", "m.suffix", F.lit(".h5")).alias("path"),
            F.col("source").alias("city"),
            "doc_id",
        )
    )


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three image bands per cell, as 8-bit style integers held in doubles."""
    c = cells(spark, sf_dir)
    return c.select(
        "tile_id", "row", "col",
        F.posexplode(
            F.array(
                (F.col("k") * 2.5),
                (F.col("height") / 2.0),
                (F.col("k") + F.col("class") * 10).cast("double"),
            )
        ).alias("band", "value"),
        (F.col("k") % 13 != 0).alias("valid"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training history per user, one epoch per event."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")).cast("double"))
    e = value_rank(e, ["user_id"], "at", "event_id", "epoch", "epochs")
    return e.select(
        F.col("user_id").alias("run_id"),
        F.col("epoch").cast("int").alias("epoch"),
        F.col("value").alias("rmse"),
        (F.col("value") / 2).alias("mae"),
        (1 - F.col("value") / 1000).alias("correlation"),
    )
