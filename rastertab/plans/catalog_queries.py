"""Catalogue and source/sink queries (survey groups 2.1 and 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastertab.functions.state import new_path
from rastertab.operators import audit, catalog, metrics
from rastertab.plans import fixtures as fx
from rastertab.plans.registry import query, rounded, unit_sql
from rastertab.sources import io

_N = "count(*) FILTER (kind='images') AS n_images, count(*) FILTER (kind='heights') AS n_heights, count(*) FILTER (kind='classes') AS n_classes"


@query("sr1_scan_cells", 'SELECT tile_id, "row", col, height, class, boundary FROM cells')
def sr1(spark, sf_dir):
    path = new_path(spark, "cells")
    io.write_cells(fx.cells(spark, sf_dir).select("tile_id", "row", "col", "height", "class", "boundary"), path, 4)
    return io.scan_cells(spark, path)


@query("sr2_list_files", "SELECT DISTINCT kind, split, city FROM files")
def sr2(spark, sf_dir):
    """Folders of a <kind>/<split>/<city>/ tree that Spark writes from the catalogue."""
    root = new_path(spark, "tree")
    fx.files(spark, sf_dir).write.partitionBy("kind", "split", "city").parquet(root)

    def value(part, name):
        return F.regexp_extract(part, f"^{name}=([^/]*)", 1).alias(name)

    found = io.list_files(spark, root)
    return found.select(value("kind", "kind"), value("split", "split"), value("relative_path", "city")).distinct()


@query("sr3_explode_grid", 'SELECT tile_id, "row", col, value FROM grid8')
def sr3(spark, sf_dir):
    return io.explode_grid(fx.grid8(spark, sf_dir), 8)


@query("sr4_pack_grid", """SELECT tile_id, CAST("row"//8*8 AS INT) AS first_row, array_to_string(list(printf('%.3f', value + 0.0) ORDER BY "row", col), ' ') AS packed FROM
(SELECT tile_id, "row", col, CAST(round(value, 2) AS DOUBLE) AS value FROM (SELECT tile_id, "row", col, height AS value FROM cells)) GROUP BY tile_id, "row"//8*8""")
def sr4(spark, sf_dir):
    g = fx.cells(spark, sf_dir).select("tile_id", "row", "col", F.round("height", 2).alias("value"))
    packed = io.pack_grid(g, band_rows=8)
    texts = F.transform(F.filter("values", lambda v: v.isNotNull()), lambda v: F.format_string("%.3f", v))
    return packed.select("tile_id", "first_row", F.array_join(texts, " ").alias("packed"))


def _samples_json(spark, sf_dir):
    t = metrics.tile_metrics(fx.pred(spark, sf_dir))
    rec = F.struct(
        F.col("tile_id").cast("string").alias("sample"), F.col("landscape").alias("group"), "rmse", "mae", "correlation",
        "semantic_miou", "building_iou", "boundary_f1", "valid_pixels", "per_class_iou",
    )
    path = new_path(spark, "metrics")
    t.select(F.array(rec).alias("per_sample")).write.json(path)  # one document per line
    return path


@query("sr5_read_run_metrics", "SELECT tile_id::VARCHAR AS sample, landscape AS \"group\", round(rmse,6) AS rmse, round(iou3,6) AS building, valid_pixels FROM tiles")
def sr5(spark, sf_dir):
    s = io.read_run_metrics(spark, _samples_json(spark, sf_dir), multi_line=False)
    return rounded(s.select("sample", "group", "rmse", F.col("per_class_iou")["building"].alias("building"), "valid_pixels"))


@query("sr6_write_tile_metrics", "SELECT tile_id, CASE WHEN tile_id%2=0 THEN 'val' ELSE 'test' END AS split, CASE WHEN tile_id=1 THEN NULL ELSE round(rmse,6) END AS rmse FROM tiles")
def sr6(spark, sf_dir):
    t = metrics.tile_metrics(fx.pred(spark, sf_dir)).withColumn("split", F.when(F.col("tile_id") % 2 == 0, "val").otherwise("test"))
    t = t.withColumn("rmse", F.when(F.col("tile_id") == 1, float("nan")).otherwise(F.col("rmse")))
    path = new_path(spark, "tile-metrics")
    io.write_tile_metrics(t, path)
    return rounded(spark.read.schema("tile_id bigint, rmse double, split string").json(path))


@query("sr7_write_manifest", """SELECT count(DISTINCT tile_id) AS total_sample_count, count(*) FILTER (valid) AS total_valid_pixel_count, count(*) FILTER (NOT valid) AS total_invalid_pixel_count FROM dirty_ok""")
def sr7(spark, sf_dir):
    c = fx.cells_dirty(spark, sf_dir)
    samples = audit.audit_samples(c)
    splits = audit.audit_splits(c, samples)
    path = new_path(spark, "manifest")
    io.write_manifest(samples, splits, audit.audit_totals(splits, "cells", "1"), path)
    return spark.read.schema(
        "total_sample_count bigint, total_valid_pixel_count bigint, total_invalid_pixel_count bigint"
    ).json(f"{path}/totals")


@query("sr8_read_training_log", "SELECT run_id, epoch, round(rmse,3) AS rmse, round(mae,3) AS mae FROM history")
def sr8(spark, sf_dir):
    h = fx.history(spark, sf_dir)
    line = F.format_string(
        "%.1fs 1 Epoch %02d/%02d | Train Loss: 1.0000 | Val RMSE: %.3fm | MAE: %.3fm | Pearson R: 0.500 | LR: 1.00e-05 #%d",
        F.col("epoch") * 1.0, F.col("epoch"), F.lit(999), F.round("rmse", 3), F.round("mae", 3), F.col("run_id"),
    )
    path = new_path(spark, "log")
    h.select(line.alias("value")).write.text(path)
    raw = spark.read.text(path)
    run = F.regexp_extract("value", r"#(\d+)$", 1).cast("bigint")
    return io.parse_training_log(raw.withColumn("run_id", run)).select("run_id", "epoch", "rmse", "mae")


@query("ds01_pair_key", "SELECT path, key FROM files")
def ds01(spark, sf_dir):
    return fx.files(spark, sf_dir).select("path", catalog.pair_key("path").alias("key"))


@query("ds02_pair_triplets", "SELECT split, key, image, height, classes FROM samples")
def ds02(spark, sf_dir):
    return catalog.pair_triplets(fx.files(spark, sf_dir))


@query("ds03_ambiguous_keys", f"SELECT * FROM (SELECT split, key, {_N} FROM files GROUP BY split, key) WHERE n_images>0 AND (n_images<>1 OR n_heights<>1 OR n_classes<>1)")
def ds03(spark, sf_dir):
    return catalog.ambiguous_keys(fx.files(spark, sf_dir))


@query("ds04_orphan_targets", "SELECT DISTINCT split, key, kind FROM files f WHERE kind<>'images' AND NOT EXISTS (SELECT 1 FROM files i WHERE i.kind='images' AND i.split=f.split AND i.key=f.key)")
def ds04(spark, sf_dir):
    return catalog.orphan_targets(fx.files(spark, sf_dir))


@query("ds05_missing_modalities", f"""
WITH m AS (SELECT split, key, min(path) FILTER (kind='images') AS image, {_N} FROM files GROUP BY split, key HAVING count(*) FILTER (kind='images')>0)
SELECT split, key, image, 'height' AS missing FROM m WHERE n_heights=0 UNION ALL SELECT split, key, image, 'class' FROM m WHERE n_classes=0""")
def ds05(spark, sf_dir):
    return catalog.missing_modalities(fx.files(spark, sf_dir))


@query("ds06_pair_exact", """SELECT i.split, regexp_extract(i.path, '([^/]*)_RGB\\.h5$', 1) AS id, i.path AS image, h.path AS height FROM files i JOIN files h
ON i.kind='images' AND h.kind='heights' AND h.split=i.split AND replace(replace(i.path,'images/','heights/'),'_RGB','_AGL')=h.path""")
def ds06(spark, sf_dir):
    return catalog.pair_exact(fx.files(spark, sf_dir))


@query("ds07_group_of", """
WITH p AS (SELECT doc_id, CASE WHEN doc_id%3=0 THEN 'north/' ELSE '' END || CASE WHEN doc_id%6=0 THEN 'inner/' ELSE '' END || source || CASE WHEN doc_id%2=0 THEN '-' ELSE '_' END || doc_id || '_RGB.h5' AS path FROM documents)
SELECT path, CASE WHEN doc_id%6=0 THEN 'north/inner' WHEN doc_id%3=0 THEN 'north' ELSE regexp_extract(path,'^([^_-]*)',1) END AS audit, CASE WHEN doc_id%3=0 THEN 'north' ELSE '' END AS first_dir,
CASE WHEN doc_id%6=0 THEN 'north/inner' WHEN doc_id%3=0 THEN 'north' ELSE replace(path,'_RGB.h5','') END AS final, split_part(regexp_extract(path,'([^/]*)$',1),'_',1) AS city FROM p""")
def ds07(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "source")
    i = F.col("doc_id")
    path = F.concat(
        F.when(i % 3 == 0, "north/").otherwise(""), F.when(i % 6 == 0, "inner/").otherwise(""), "source",
        F.when(i % 2 == 0, "-").otherwise("_"), i.cast("string"), F.lit("_RGB.h5"),
    )
    p = d.select(path.alias("path"))
    return p.select("path", *[catalog.group_of("path", r).alias(r) for r in ("audit", "first_dir", "final", "city")])


def _samples(spark, sf_dir):
    f = fx.files(spark, sf_dir)
    cities = catalog.with_pair_key(f).groupBy("split", "key").agg(F.first("city").alias("city"))
    return catalog.pair_triplets(f).join(cities, ["split", "key"])


@query("ds08_stratified_sample", f"""
WITH c AS (SELECT split, city, count(*) AS n FROM samples GROUP BY ALL), t AS (SELECT split, count(*) AS total FROM samples GROUP BY split),
s AS (SELECT c.split, city, greatest(1, least(n, round_even(30.0*n/total, 0)))::BIGINT AS share FROM c JOIN t USING (split)),
a AS (SELECT *, row_number() OVER (PARTITION BY split, city ORDER BY {unit_sql("7", "key")}, key) AS i FROM samples JOIN s USING (split, city)),
o AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {unit_sql("8", "key")}, key) AS j FROM a WHERE i<=share)
SELECT split, city, key FROM o WHERE j<=30""")
def ds08(spark, sf_dir):
    s = _samples(spark, sf_dir)
    targets = s.select("split").distinct().withColumn("target", F.lit(30))
    return catalog.stratified_sample(s, targets).select("split", "city", "key")


@query("ds09_split_by_group", """
WITH g AS (SELECT DISTINCT city FROM samples), h AS (SELECT city, row_number() OVER (ORDER BY city DESC) <= greatest(1, count(*) OVER () // 5) AS held FROM g)
SELECT key, split, s.city AS "group", CASE WHEN held THEN 'validation' ELSE 'train' END AS role FROM samples s JOIN h USING (city)""")
def ds09(spark, sf_dir):
    s = _samples(spark, sf_dir).withColumnRenamed("city", "group")
    return catalog.split_by_group(s).select("key", "split", "group", "role")


@query("ds09_split_problems", "SELECT 'unknown_group' AS problem, 'nowhere' AS \"group\"")
def ds09b(spark, sf_dir):
    s = _samples(spark, sf_dir).withColumnRenamed("city", "group")
    return catalog.split_problems(s, ["src0", "nowhere"])


@query("ds10_first_n_per_split", "SELECT split, key FROM samples QUALIFY row_number() OVER (PARTITION BY split ORDER BY key) <= CASE split WHEN 'train' THEN 24 ELSE 6 END")
def ds10(spark, sf_dir):
    s = catalog.pair_triplets(fx.files(spark, sf_dir))
    return catalog.first_n_per_split(s, {"train": 24, "val": 6, "test": 6}).select("split", "key")


@query("ds11_completeness", """
WITH e AS (SELECT * FROM (VALUES ('train', 3), ('val', 2), ('extra', 1)) v(split, expected)), o AS (SELECT split, count(*) AS observed FROM samples GROUP BY split)
SELECT split, coalesce(observed,0) AS observed, expected::BIGINT AS expected, 'subset' AS status FROM o FULL JOIN e USING (split)""")
def ds11(spark, sf_dir):
    expected = spark.createDataFrame([("train", 3), ("val", 2), ("extra", 1)], "split string, expected int")
    return catalog.completeness(catalog.pair_triplets(fx.files(spark, sf_dir)), expected)


@query("ds12_upsert_by_key", """
WITH o AS (SELECT doc_id AS name, n_chars AS size FROM documents), n AS (SELECT doc_id AS name, quality AS size FROM labels)
SELECT name, size FROM o WHERE name NOT IN (SELECT name FROM n) UNION ALL SELECT name, size FROM n""")
def ds12(spark, sf_dir):
    old = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("n_chars").alias("size"))
    new = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), F.col("quality").cast("bigint").alias("size"))
    return catalog.upsert_by_key(old, new)


@query("ds13_group_counts", 'SELECT split, city AS "group", count(*) AS samples FROM samples GROUP BY ROLLUP (split, city)')
def ds13(spark, sf_dir):
    return catalog.group_counts(_samples(spark, sf_dir).withColumnRenamed("city", "group"))


@query("ds14_key_consistency", """
WITH k AS (SELECT kind, path, CASE kind WHEN 'images' THEN 'image' WHEN 'heights' THEN 'height' ELSE 'classes' END AS key FROM files UNION ALL SELECT kind, path, 'aux' FROM files WHERE kind='heights' AND doc_id%5=0),
f AS (SELECT kind, path, string_agg(key, ',' ORDER BY key) AS keys FROM k GROUP BY kind, path)
SELECT kind, count(*) AS files, count(DISTINCT keys) AS key_lists, min(keys) AS first_keys, count(DISTINCT keys)=1 AS consistent FROM f GROUP BY kind""")
def ds14(spark, sf_dir):
    f = fx.files(spark, sf_dir)
    name = F.when(F.col("kind") == "images", "image").when(F.col("kind") == "heights", "height").otherwise("classes")
    extra = F.when((F.col("kind") == "heights") & (F.col("doc_id") % 5 == 0), F.lit("aux"))
    keys = F.filter(F.array(name, extra), lambda k: k.isNotNull())
    return catalog.key_consistency(f.select("path", "kind", F.explode(keys).alias("key")))
