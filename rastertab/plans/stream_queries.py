"""Streaming queries (survey group 2.10), drained to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastertab.functions.state import new_path
from rastertab.plans import fixtures as fx
from rastertab.plans.registry import query
from rastertab.streaming import ingest

BATCHES, FILES = 3, 2  # batches of arrivals, and files of each


def _session(spark, rocks: bool = False):
    """A session of its own whose state has one partition per core, as state cannot be coalesced later."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    if rocks:
        own.conf.set(
            "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        )
    return own


_SCHEMA = "split string, kind string, path string, arrived timestamp"
LATE = "kind = 'heights' AND doc_id % 53 = 0"  # files that the pairing query gets after their time


def _file_stream(spark, sf_dir, kind=None, late=None):
    """The catalogue's files as a stream of several batches, in order of arrival.

    A batch is a range of documents in FILES files. The last batch but for ``late`` is far off in time, which lets the
    watermark pass all others.
    """
    offset = F.when(F.col("kind") == "images", 0).when(F.col("kind") == "heights", 20).otherwise(40)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") + offset)
    rows = fx.files(spark, sf_dir).withColumn("arrived", at).withColumn("late", F.expr(late or "false"))
    rows = rows.withColumn("file", (F.col("doc_id") % FILES).cast("int"))
    kinds = [kind] if kind else ["images"]
    most = rows.agg(F.max("arrived").alias("m"), (F.max("doc_id") + 1).alias("n")).first()
    end = spark.range(FILES).select(
        F.lit("end").alias("split"), F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"),
        F.format_string("images/end/end%d_RGB.h5", "id").alias("path"), (F.lit(most.m) + F.expr("INTERVAL 2 DAYS")).alias("arrived"),
        F.col("id").cast("int").alias("file"),
    )
    rows = rows.where(F.col("kind") == kind) if kind else rows
    path, batch = new_path(spark, "arrivals"), F.floor(F.col("doc_id") * BATCHES / most.n)

    def write(some):  # one file per value of ``file``
        some.select("split", "kind", "path", "arrived", "file").repartition(FILES, "file").write.partitionBy("file").mode("append").parquet(path)

    for k in range(BATCHES):
        write(rows.where((batch == k) & ~F.col("late")))
    write(end)
    if late:
        write(rows.where("late"))
    return spark.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", FILES).parquet(path).drop("file")


@query("ss1_stream_verdicts", """
WITH n AS (SELECT split, key, count(*) FILTER (kind='images') AS n_images, count(*) FILTER (kind='heights') AS n_heights, count(*) FILTER (kind='classes') AS n_classes FROM files GROUP BY split, key)
SELECT split, key, CASE WHEN n_images=0 THEN 'orphan' WHEN n_images>1 OR n_heights>1 OR n_classes>1 THEN 'duplicate' WHEN n_heights=0 OR n_classes=0 THEN 'missing' ELSE 'triplet' END AS verdict, n_images, n_heights, n_classes FROM n""")
def ss1_verdicts(spark, sf_dir):
    out = ingest.run_append(ingest.stream_verdicts(_file_stream(_session(spark), sf_dir)), "verdicts")
    return spark.read.parquet(out).where(F.col("split") != "end").select(
        "split", "key", "verdict", "n_images", "n_heights", "n_classes"
    )


@query("ss1_stream_pair_triplets", "SELECT i.split, i.key, i.path AS image, h.path AS height, c.path AS classes FROM files i JOIN files h ON h.kind='heights' AND h.split=i.split AND h.key=i.key JOIN files c ON c.kind='classes' AND c.split=i.split AND c.key=i.key WHERE i.kind='images'")
def ss1_triplets(spark, sf_dir):
    own = _session(spark)
    streams = [_file_stream(own, sf_dir, k) for k in ("images", "heights", "classes")]
    out = ingest.run_append(ingest.stream_pair_triplets(*streams), "triplets")
    return spark.read.parquet(out).where(F.col("split") != "end").select("split", "key", "image", "height", "classes")


@query("ss1_stream_pairing", f"""
WITH n AS (SELECT split, key, count(*) FILTER (kind='images') AS n_images, count(*) FILTER (kind='heights') AS n_heights, count(*) FILTER (kind='classes') AS n_classes FROM files WHERE NOT ({LATE}) GROUP BY split, key)
SELECT split, key, CASE WHEN n_images=0 THEN 'orphan' WHEN n_images>1 OR n_heights>1 OR n_classes>1 THEN 'duplicate' WHEN n_heights=0 OR n_classes=0 THEN 'missing' ELSE 'triplet' END AS verdict, n_images, n_heights, n_classes FROM n
UNION ALL SELECT split, key, 'late', 0, 1, 0 FROM files WHERE {LATE}""")
def ss1_pairing(spark, sf_dir):
    own = _session(spark, rocks=True)
    out = ingest.run_append(ingest.stream_pairing(_file_stream(own, sf_dir, late=LATE)), "pairing")
    return ingest.settled_pairs(spark.read.parquet(out)).where("split <> 'end'").select(
        "split", "key", "verdict", "n_images", "n_heights", "n_classes"
    )


@query("ss2_stream_audit", f"""SELECT split, {", ".join(f"count(*) FILTER (valid AND class={c}) AS class_{c}" for c in range(7))},
count(*) FILTER (height IS NULL OR isnan(height)) AS height_nonfinite, count(*) FILTER (class NOT BETWEEN 0 AND 6 AND class<>255) AS class_illegal, count(*) FILTER (class=255) AS void, count(*) FILTER (valid) AS valid_pixels FROM dirty_ok GROUP BY split""")
def ss2(spark, sf_dir):
    path = new_path(spark, "tiles")
    fx.cells_dirty(spark, sf_dir).select("split", "tile_id", "row", "col", "height", "class").repartition(8).write.parquet(path)
    stream = _session(spark).readStream.schema(
        "split string, tile_id bigint, row int, col int, height double, class int"
    ).option("maxFilesPerTrigger", 2).parquet(path)
    return ingest.merged_audit(spark.read.parquet(ingest.run_complete(ingest.stream_audit(stream), "audit")))
