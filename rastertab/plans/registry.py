"""Registered queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

# SQL forms of the views in fixtures.py; a view may use the ones above it.
VIEWS = {
    "ev": """SELECT event_id, event_id // 1024 AS tile_id, CAST((event_id % 1024) // 32 AS INT) AS "row",
        CAST(event_id % 32 AS INT) AS col, value AS height,
        CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events""",
    "evb": """SELECT *, CAST((3 * ("row" // 8) + 5 * (col // 8) + tile_id) % 16 AS INT) AS b FROM ev""",
    "cells": """SELECT tile_id, "row", col, height,
        CASE WHEN "row" % 8 = 0 OR col % 8 = 0 THEN 5 WHEN b = 0 THEN 4
             WHEN "row" % 8 BETWEEN 2 AND 5 + b % 2 AND col % 8 BETWEEN 2 AND 4 + b % 3 AND k % 11 <> 0 THEN 3
             ELSE [1,1,1,0,2,6][k % 6 + 1] END AS class,
        k / 100.0::DOUBLE AS boundary, ['urban','sparse','hilly','forested'][tile_id % 4 + 1] AS landscape,
        k, event_id FROM evb""",
    "cells_dirty": """SELECT tile_id, "row", col, CASE WHEN k % 34 = 0 THEN NULL WHEN k % 17 = 0 THEN 'nan'::DOUBLE ELSE height END AS height,
        CASE WHEN event_id % 997 = 0 THEN 99 WHEN k % 19 = 0 THEN 255 ELSE class END AS class, boundary, landscape, k, event_id,
        CASE WHEN tile_id % 10 = 0 THEN 'val' WHEN tile_id % 10 = 1 THEN 'test' ELSE 'train' END AS split FROM cells""",
    "dirty_ok": """SELECT *, height IS NOT NULL AND NOT isnan(height) AND class BETWEEN 0 AND 6 AS valid FROM cells_dirty""",
    "pred": """SELECT c.*, 0.92 * c.height + 0.65 AS pred_height, l.class AS pred_class,
        (l.boundary - 0.5) * 4.0 AS pred_boundary_logit
        FROM cells c JOIN cells l ON l.tile_id = c.tile_id AND l."row" = c."row" AND (l.col + 1) % 32 = c.col""",
    "pairs": """SELECT l_returnflag, l_linestatus, l_extendedprice AS height, l_extendedprice * (1 - l_discount) AS pred_height FROM lineitem""",
    "history": """SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS epoch,
        value AS rmse, value / 2 AS mae, 1 - value / 1000 AS correlation FROM events""",
    "bands": """SELECT tile_id, "row", col, 0 AS band, k * 2.5::DOUBLE AS value, k % 13 <> 0 AS valid FROM cells
        UNION ALL SELECT tile_id, "row", col, 1, height / 2.0, k % 13 <> 0 FROM cells
        UNION ALL SELECT tile_id, "row", col, 2, CAST(k + class * 10 AS DOUBLE), k % 13 <> 0 FROM cells""",
    "docs3": """SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN 'val' WHEN doc_id % 10 = 1 THEN 'test' ELSE 'train' END AS split,
        source || '_' || doc_id AS stem FROM documents""",
    "files": """SELECT split, kind, kind || '/' || split || '/' || stem || suffix || '.h5' AS path, source AS city, doc_id, upper(stem) AS key
        FROM (SELECT *, 'images' AS kind, '_RGB' AS suffix FROM docs3 WHERE doc_id % 43 <> 0
        UNION ALL SELECT *, 'heights', '_AGL' FROM docs3 WHERE doc_id % 37 <> 0
        UNION ALL SELECT *, 'classes', '_CLS' FROM docs3
        UNION ALL SELECT *, 'classes', '_CLASSES' FROM docs3 WHERE doc_id % 41 = 0)""",
    "samples": """SELECT split, key, city, min(path) FILTER (kind = 'images') AS image, min(path) FILTER (kind = 'heights') AS height,
        min(path) FILTER (kind = 'classes') AS classes FROM files GROUP BY split, key, city
        HAVING count(*) FILTER (kind = 'images') = 1 AND count(*) FILTER (kind = 'heights') = 1 AND count(*) FILTER (kind = 'classes') = 1""",
    "logits": """SELECT vec_id AS tile_id, CAST((p % 9) // 3 AS INT) AS "row", CAST(p % 3 AS INT) AS col, CAST(p // 9 AS INT) AS class,
        CAST(embedding[p + 1] AS DOUBLE) + CASE WHEN p >= 54 THEN CAST(embedding[64] AS DOUBLE) ELSE 0 END AS logit FROM embeddings, (SELECT unnest(range(63)) AS p)""",
    "grid8": """SELECT vec_id AS tile_id, CAST(p // 8 AS INT) AS "row", CAST(p % 8 AS INT) AS col, CAST(embedding[p + 1] AS DOUBLE) AS value
        FROM embeddings, (SELECT unnest(range(64)) AS p)""",
    "off8": """SELECT dr, dc FROM (SELECT unnest([-1,0,1]) AS dr), (SELECT unnest([-1,0,1]) AS dc) WHERE dr <> 0 OR dc <> 0""",
    "off9": """SELECT dr, dc FROM (SELECT unnest([-1,0,1]) AS dr), (SELECT unnest([-1,0,1]) AS dc)""",
    "off4": """SELECT dr, dc FROM off8 WHERE dr = 0 OR dc = 0""",
    "edges": """SELECT c.*, CASE WHEN c.class = 3 THEN (SELECT count(*) FROM off4 o JOIN pred n ON n.tile_id = c.tile_id
        AND n."row" = c."row" + o.dr AND n.col = c.col + o.dc WHERE n.class = 3) < 4 ELSE false END AS target_edge,
        CASE WHEN c.pred_class = 3 THEN (SELECT count(*) FROM off4 o JOIN pred n ON n.tile_id = c.tile_id
        AND n."row" = c."row" + o.dr AND n.col = c.col + o.dc WHERE n.pred_class = 3) < 4 ELSE false END AS pred_edge FROM pred c""",
    "tiles_m": """SELECT p.tile_id, p.landscape, sqrt(avg((pred_height - height)^2)) AS rmse, avg(abs(pred_height - height)) AS mae,
        corr(pred_height, height) AS correlation, """
    + ", ".join(
        f"count(*) FILTER (class={c} AND pred_class={c})::DOUBLE / nullif(count(*) FILTER (class={c} OR pred_class={c}),0) AS iou{c}"
        for c in range(7)
    )
    + """, 2.0 * count(*) FILTER (class=3 AND pred_class=3) / nullif(count(*) FILTER (class=3) + count(*) FILTER (pred_class=3), 0) AS building_f1,
        2.0 * count(*) FILTER (target_edge AND pred_edge) / nullif(count(*) FILTER (target_edge) + count(*) FILTER (pred_edge), 0) AS boundary_f1,
        2.0 * count(*) FILTER (target_edge AND pred_boundary_logit >= 0) / nullif(count(*) FILTER (target_edge) + count(*) FILTER (pred_boundary_logit >= 0), 0) AS boundary_head_f1,
        count(*) AS valid_pixels FROM edges p GROUP BY p.tile_id, p.landscape""",
    "tiles": """SELECT *, iou3 AS building_iou, list_avg(list_filter([iou0,iou1,iou2,iou3,iou4,iou5,iou6], lambda x: x IS NOT NULL)) AS semantic_miou FROM tiles_m""",
}
_NAMES = list(VIEWS)


def _needed(text: str) -> list[str]:
    found: set[str] = set()

    def visit(sql: str) -> None:
        for name in _NAMES:
            if name not in found and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", sql, re.I):
                found.add(name)
                visit(VIEWS[name])

    visit(text)
    return [n for n in _NAMES if n in found]


def with_views(sql: str) -> str:
    """Prefix a statement with the views it reads."""
    body = sql.strip()
    views = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in _needed(body))
    if not views:
        return body
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if own:
        return f"WITH RECURSIVE {views}, {body[own.end():]}"
    return f"WITH RECURSIVE {views} {body}"


def quantile_sql(value: str, p: float) -> str:
    """SQL twin of a number in exact_quantiles: rounded step by step, where quantile_cont may fuse steps or not."""
    values, at = f"list_sort(list({value}))", f"({p!r}::DOUBLE*(count({value})-1))"
    low, high = f"{values}[floor({at})::BIGINT+1]", f"{values}[ceil({at})::BIGINT+1]"
    blend = f"{low}*(ceil({at})-{at})+{high}*({at}-floor({at}))"
    return f"CASE WHEN floor({at})=ceil({at}) THEN {low} ELSE greatest({low}, least({high}, {blend})) END"


def unit_sql(*parts: str) -> str:
    """SQL twin of unit_hash."""
    return f"(('0x'||md5(concat_ws('|', {', '.join(parts)}))[1:8])::UBIGINT/4294967296.0::DOUBLE)"


def query(name: str, sql: str | None = None):
    """Register a query function (spark, sf_dir) -> DataFrame and, if given, its SQL twin."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def rounded(df, digits: int = 6):
    """Round every double column so that sums in another order compare equal."""
    from pyspark.sql import functions as F

    return df.select(
        *[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes]
    )
