"""Fixed contracts: the class dimension and the layout of the long cell table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Class ids, names, labels and display colours.
CLASSES = (
    (0, "others", "Others", "#d9d9d9"),
    (1, "ground", "Ground", "#b6c99e"),
    (2, "low_vegetation", "Low vegetation", "#83a96f"),
    (3, "building", "Building", "#c7cbd1"),
    (4, "water", "Water", "#72aee8"),
    (5, "road", "Road", "#e8e1d6"),
    (6, "tree", "Tree", "#4f8258"),
)
CLASS_NAMES = tuple(c[1] for c in CLASSES)
CLASS_COUNT = len(CLASSES)
OTHERS, GROUND, LOW_VEGETATION, BUILDING, WATER, ROAD, TREE = range(CLASS_COUNT)
VOID_CLASS = 255

CELL_SCHEMA = T.StructType(
    [
        T.StructField("tile_id", T.LongType(), False),
        T.StructField("row", T.IntegerType(), False),
        T.StructField("col", T.IntegerType(), False),
        T.StructField("height", T.DoubleType()),
        T.StructField("class", T.IntegerType()),
        T.StructField("boundary", T.DoubleType()),
    ]
)

CELL_KEY = ["tile_id", "row", "col"]


def classes(spark: SparkSession) -> DataFrame:
    """The seven-row class dimension."""
    return spark.createDataFrame(list(CLASSES), "id int, name string, label string, color string")


def class_name(class_id) -> F.Column:
    """Class id column to its name; NULL outside 0..6."""
    names = F.array(*[F.lit(n) for n in CLASS_NAMES])
    return F.when(class_id.between(0, CLASS_COUNT - 1), F.element_at(names, (class_id + 1).cast("int")))
