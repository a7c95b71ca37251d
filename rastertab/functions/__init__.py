from rastertab.functions.columns import finite, python_round, js_round, ratio
from rastertab.functions.grid import attach, core, gather, row_major_rank, tile_shape, with_halo
from rastertab.functions.quantiles import exact_quantiles
from rastertab.functions.state import settle

__all__ = [
    "attach", "core", "exact_quantiles", "finite", "gather", "js_round", "python_round",
    "ratio", "row_major_rank", "settle", "tile_shape", "with_halo",
]
