import datetime as dt
from types import SimpleNamespace

import pandas as pd

from rastertab.functions.state import new_path
from rastertab.plans.stream_queries import _SCHEMA, _session
from rastertab.streaming import ingest

T0 = dt.datetime(2024, 5, 1, 12)


def stream(spark, batches):
    """A stream of one file per batch."""
    own, path = _session(spark, rocks=True), new_path(spark, "arrivals")
    for rows in batches:
        data = [(s, k, p, T0 + dt.timedelta(minutes=m)) for s, k, p, m in rows]
        own.createDataFrame(data, _SCHEMA).repartition(1).write.mode("append").parquet(path)
    return own.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def path(kind, key):
    return f"{kind}/{key}{ {'images': '_RGB', 'heights': '_AGL', 'classes': '_CLS'}[kind] }.h5"


def test_pairing_tells_every_file(spark):
    kinds = ("images", "heights", "classes")
    first = [("train", "images", path("images", "a1"), 0), ("train", "images", path("images", "a2"), 1), ("train", "heights", path("heights", "a3"), 1)]
    first += [("train", k, path(k, "a4"), 2) for k in kinds] + [("train", k, path(k, "a5"), 2) for k in kinds]
    second = [("train", "heights", path("heights", "a1"), 5), ("train", "images", path("images", "a1"), 5), ("train", "classes", "classes/a5_CLASSES.h5", 6)]
    third = [("train", "classes", path("classes", "a1"), 8), ("val", "images", path("images", "a1"), 8)]
    end = [("end", "images", path("images", "z"), 3000)]
    late = [("train", "classes", path("classes", "a2"), 4)]
    rows = spark.read.parquet(ingest.run_append(ingest.stream_pairing(stream(spark, [first, second, third, end, late])), "pairing"))
    told = sorted((r.split, r.key, r.verdict, r.n_images, r.n_heights, r.n_classes) for r in rows.where("split <> 'end'").collect())
    assert told == [
        ("train", "A1", "triplet", 1, 1, 1), ("train", "A2", "late", 0, 0, 1), ("train", "A2", "missing", 1, 0, 0), ("train", "A3", "orphan", 0, 1, 0),
        ("train", "A4", "triplet", 1, 1, 1), ("train", "A5", "duplicate", 1, 1, 2), ("train", "A5", "triplet", 1, 1, 1), ("val", "A1", "missing", 1, 0, 0),
    ]
    settled = sorted((r.key, r.verdict) for r in ingest.settled_pairs(rows).where("split = 'train'").collect())
    assert settled == [("A1", "triplet"), ("A2", "late"), ("A2", "missing"), ("A3", "orphan"), ("A4", "triplet"), ("A5", "duplicate")]
    assert rows.where("key = 'A1' AND split = 'train'").first().first_arrival is not None


class State:
    """A value and timers as Spark keeps them, with the number of calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def test_pairing_calls_state_per_bucket_not_per_key():
    state, pairing = State(), ingest._Pairing(100)
    pairing.init(state)
    clock = lambda at: SimpleNamespace(getCurrentWatermarkInMs=lambda: at)
    fired = lambda at: SimpleNamespace(getExpiryTimeInMs=lambda: at)
    files = [("train", f"K{i}", kind, path(kind, f"k{i}"), 1000 + i) for i in range(400) for kind in ("images", "heights", "classes") if kind != "heights" or i % 4]
    frame = pd.DataFrame(files, columns=["split", "key", "kind", "path", "at"])
    told = pd.concat(pairing.handleInputRows((0,), iter([frame[:500], frame[500:]]), clock(0)))
    assert set(told["verdict"]) == {"triplet"} and len(told) == 300 and state.timers == [1100] and state.calls == 3
    told = pd.concat(pairing.handleExpiredTimer((0,), clock(1300), fired(1100)))  # keys 0 to 199 are over
    assert set(told["verdict"]) == {"missing"} and len(told) == 50 and state.timers == [1100, 1300] and state.calls == 6
    late = pd.concat(pairing.handleInputRows((0,), iter([frame[:3]]), clock(1300)))
    assert list(late["verdict"]) == ["late"] * 3 and state.calls == 7
    told = pd.concat(pairing.handleExpiredTimer((0,), clock(9000), fired(1300)))
    assert len(told) == 50 and state.value is None and state.calls == 9


def test_audit_parts_add_up(spark):
    own, where = _session(spark), new_path(spark, "tiles")
    schema = "split string, tile_id bigint, row int, col int, height double, class int"
    cells = [("train", 1, r, c, float(r), (r + c) % 7) for r in range(40) for c in range(40)] + [("val", 2, 0, c, None, 255) for c in range(3)]
    own.createDataFrame(cells, schema).repartition(3).write.parquet(where)
    parts = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)
    out = spark.read.parquet(ingest.run_complete(ingest.stream_audit(parts), "audit"))
    assert out.where("split = 'train'").count() > 8  # one tile is spread over many states
    merged = {r.split: r for r in ingest.merged_audit(out).collect()}
    assert merged["train"].valid_pixels == 1600 and sum(merged["train"][f"class_{k}"] for k in range(7)) == 1600
    assert (merged["val"].void, merged["val"].height_nonfinite, merged["val"].valid_pixels) == (3, 3, 0)
