"""Tiny rasters as cell tables."""

import numpy as np


def cells(spark, tiles, **layers):
    """``tiles`` maps tile_id to a class array; further layers map tile_id to an array each."""
    rows, names = [], ["tile_id", "row", "col", "class", *layers]
    for tile, labels in tiles.items():
        for (r, c), v in np.ndenumerate(np.asarray(labels)):
            extra = []
            for layer in layers.values():
                value = np.asarray(layer[tile])[r, c]
                extra.append(bool(value) if np.asarray(layer[tile]).dtype == bool else float(value))
            rows.append((tile, r, c, int(v), *extra))
    kinds = ["bigint", "int", "int", "int"]
    for layer in layers.values():
        kinds.append("boolean" if np.asarray(next(iter(layer.values()))).dtype == bool else "double")
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def grid(df, value, shape, fill=np.nan):
    out = np.full(shape, fill, dtype=object)
    for r in df.select("row", "col", value).collect():
        out[r["row"], r["col"]] = r[value]
    return out
