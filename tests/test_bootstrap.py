import hashlib
import math

import pytest

from rastertab.operators.reports import RESIDUES, poisson_steps, replicate_sums


def test_replicate_sums_are_one_row_a_replicate_and_task_and_equal_plain_loops(spark):
    """Rows were spread over all replicates before anything was summed."""
    rows = [(t, None if t % 7 == 0 else t / 3.0, math.inf if t == 5 else 1.0 + t) for t in range(60)]
    df = spark.createDataFrame(rows, "tile_id bigint, a double, b double").coalesce(1)
    got = {r["replicate"]: r for r in replicate_sums(df, ["a", "b"], 40, 7).collect()}
    parts = replicate_sums(df.repartition(3), ["a", "b"], 40, 7)
    assert len(got) == 40 and parts.count() <= 120
    for r in range(1, 41):
        want = {"s_a": 0.0, "n_a": 0, "s_b": 0.0, "n_b": 0}
        for t, a, b in rows:
            text = hashlib.md5(f"{t}|7".encode()).hexdigest()
            u = (int(text[:7], 16) + r * int(text[7:14], 16)) % RESIDUES / RESIDUES
            w = sum(u >= c for c in poisson_steps())
            for m, v in (("a", a), ("b", b)):
                if v is not None and w:
                    want[f"s_{m}"] += w * v
                    want[f"n_{m}"] += w
        for name, v in want.items():
            assert got[r][name] == pytest.approx(v) if math.isfinite(v) else not math.isfinite(got[r][name])
