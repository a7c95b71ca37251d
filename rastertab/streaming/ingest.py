"""Structured Streaming forms of pairing and auditing as files and tiles arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rastertab.functions.columns import finite
from rastertab.functions.state import new_path
from rastertab.operators.audit import with_validity
from rastertab.operators.catalog import KINDS, pair_key
from rastertab.schema import CLASS_COUNT, VOID_CLASS


def _arrivals(files: DataFrame, watermark: str) -> DataFrame:
    """(split, key, path, arrived) with the watermark; a path announced twice counts once."""
    keyed = files.withColumn("key", pair_key("path")).withWatermark("arrived", watermark)
    return keyed.dropDuplicatesWithinWatermark(["path"])


def stream_pair_triplets(
    images: DataFrame, heights: DataFrame, classes: DataFrame, watermark: str = "10 minutes", wait: str = "10 minutes"
) -> DataFrame:
    """A triplet as soon as its three files are there: two chained stream-stream joins.

    Each input is (split, path, arrived TIMESTAMP). State is bounded by ``wait``: files further apart
    do not pair. Duplicates cannot be known yet; :func:`stream_verdicts` settles those.
    """
    i = _arrivals(images, watermark).select("split", "key", F.col("path").alias("image"), F.col("arrived").alias("at_i"))
    h = _arrivals(heights, watermark).select(
        F.col("split").alias("split_h"), F.col("key").alias("key_h"), F.col("path").alias("height"), F.col("arrived").alias("at_h")
    )
    c = _arrivals(classes, watermark).select(
        F.col("split").alias("split_c"), F.col("key").alias("key_c"), F.col("path").alias("classes"), F.col("arrived").alias("at_c")
    )
    span = F.expr(f"INTERVAL {wait}")

    def near(a: str, b: str):
        return (F.col(a) >= F.col(b) - span) & (F.col(a) <= F.col(b) + span)

    pair = i.join(h, (F.col("split") == F.col("split_h")) & (F.col("key") == F.col("key_h")) & near("at_h", "at_i"))
    pair = pair.drop("at_h", "split_h", "key_h")  # a stream carries one event time
    triple = pair.join(c, (F.col("split") == F.col("split_c")) & (F.col("key") == F.col("key_c")) & near("at_c", "at_i"))
    return triple.select("split", "key", "image", "height", "classes", F.col("at_i").alias("arrived"))


def stream_verdicts(files: DataFrame, watermark: str = "10 minutes", wait: str = "10 minutes") -> DataFrame:
    """One settled row per (split, key) session: triplet, missing, duplicate or orphan.

    Input (split, kind, path, arrived). A session closes when the watermark passes ``wait`` after its
    last file, so every file ends in exactly one row; in append mode rows never change afterwards.
    """
    counts = []
    for kind in KINDS:
        own = F.col("kind") == kind
        counts += [F.count_if(own).alias(f"n_{kind}"), F.min(F.when(own, F.col("path"))).alias(kind)]
    seen = _arrivals(files, watermark).groupBy(F.session_window("arrived", wait), "split", "key").agg(*counts)
    n = [F.col(f"n_{k}") for k in KINDS]
    verdict = (
        F.when(n[0] == 0, "orphan")
        .when((n[0] > 1) | (n[1] > 1) | (n[2] > 1), "duplicate")
        .when((n[1] == 0) | (n[2] == 0), "missing")
        .otherwise("triplet")
    )
    return seen.select(
        "split", "key", verdict.alias("verdict"), *[f"n_{k}" for k in KINDS], *KINDS,
        F.col("session_window.start").alias("first_arrival"),
    )


PAIRING_BUCKETS = 1024  # states of a pairing stream
_HELD = ["split", "key", "kind", "path", "arrived", "due"]  # what is kept of a file


class _Pairing(StatefulProcessor):
    """Files of a bucket of keys: triplets at once, what is wrong at expiry, late files as they come.

    State is one value with the files of the bucket's open keys; a key's files go when its time, ``wait_ms`` after its
    first file, is over. A value is looked up, so no scan passes over what was deleted before, and a bucket is read and
    written once for all its keys.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        types = ["string"] * 4 + ["bigint"] * 2
        self.held = handle.getValueState("held", ", ".join(f"{c} array<{t}>" for c, t in zip(_HELD, types)))

    def _open(self) -> tuple[dict, dict]:
        """Files by path and time of expiry of each open (split, key)."""
        files: dict[tuple, dict[str, tuple[str, int]]] = {}
        due: dict[tuple, int] = {}
        held = self.held.get()
        for split, name, kind, path, at, until in zip(*held) if held else ():
            files.setdefault((split, name), {})[path] = (kind, at)
            due[split, name] = until
        return files, due

    def _keep(self, files: dict, due: dict) -> None:
        rows = [(*name, kind, path, at, due[name]) for name, some in files.items() for path, (kind, at) in some.items()]
        if rows:
            self.held.update(tuple(list(column) for column in zip(*rows)))
        else:
            self.held.clear()

    def _row(self, key, verdict: str, files: dict[str, tuple[str, int]]) -> dict:
        held = {k: sorted(p for p, (kind, _) in files.items() if kind == k) for k in KINDS}
        first = min((at for _, at in files.values()), default=None)
        return {"split": key[0], "key": key[1], "verdict": verdict, **{f"n_{k}": len(held[k]) for k in KINDS},
                **{k: held[k][0] if held[k] else None for k in KINDS}, "first_arrival": first}

    def _frame(self, rows: list[dict]) -> pd.DataFrame:
        names = ["split", "key", "verdict", *(f"n_{k}" for k in KINDS), *KINDS, "first_arrival"]
        return pd.DataFrame(rows, columns=names).astype({f"n_{k}": "int64" for k in KINDS} | {"first_arrival": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        water, out = timerValues.getCurrentWatermarkInMs(), []
        files, due = self._open()
        next_due, fresh = min(due.values(), default=None), {}
        for frame in rows:
            for split, name, kind, path, at in zip(*(frame[c].tolist() for c in ("split", "key", "kind", "path", "at"))):
                at_key = (split, name)
                if path in files.get(at_key, ()) or path in fresh.get(at_key, ()):
                    continue  # announced twice
                if at < water:
                    out.append(self._row(at_key, "late", {path: (kind, at)}))
                else:
                    fresh.setdefault(at_key, {})[path] = (kind, at)
        for at_key, some in fresh.items():
            if at_key not in due:
                due[at_key] = min(at for _, at in some.values()) + self.wait_ms
            own = files.setdefault(at_key, {})
            own.update(some)
            if [sum(kind == k for kind, _ in own.values()) for k in KINDS] == [1, 1, 1]:
                out.append(self._row(at_key, "triplet", own))
        if fresh:
            first = min(due.values())
            if next_due is None or first < next_due:
                self.handle.registerTimer(first)
            self._keep(files, due)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        water, fired, out = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs(), []
        files, due = self._open()
        over = [name for name, until in due.items() if until <= fired or until < water]
        for name in over:
            some = files.pop(name)
            del due[name]
            n = [sum(kind == k for kind, _ in some.values()) for k in KINDS]
            if n != [1, 1, 1]:
                verdict = "orphan" if n[0] == 0 else "duplicate" if max(n) > 1 else "missing"
                out.append(self._row(name, verdict, some))
        if over:
            self._keep(files, due)
            if due:
                self.handle.registerTimer(min(due.values()))
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def stream_pairing(
    files: DataFrame, watermark: str = "10 minutes", wait_seconds: int = 600, buckets: int = PAIRING_BUCKETS
) -> DataFrame:
    """Every file of the stream in some row: triplet, orphan, missing, duplicate or late.

    Input (split, kind, path, arrived). A triplet is told as soon as its three files are there. ``wait_seconds`` after a
    key's first file, on the clock of the watermark, orphans, keys that miss a file and keys with more files of a kind
    are told, a duplicate also where a triplet was told before. A file that comes after the watermark has passed it is
    a row of its own, so that late files are sinked and not lost. Needs the RocksDB state store.

    Keys are dealt over ``buckets`` states; one holds the files of its open keys, and a batch reads those it has rows for.
    """
    # Spark drops late rows before they reach state where it knows the event time; a plain number keeps them
    keyed = files.withWatermark("arrived", watermark).select(
        "split", pair_key("path").alias("key"), "kind", "path", F.unix_millis("arrived").alias("at")
    )
    counts = ", ".join([*(f"n_{k} bigint" for k in KINDS), *(f"{k} string" for k in KINDS)])
    dealt = keyed.withColumn("bucket", F.pmod(F.xxhash64("split", "key"), F.lit(buckets)).cast("int"))
    rows = dealt.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Pairing(wait_seconds * 1000), outputStructType=f"split string, key string, verdict string, {counts}, first_arrival bigint",
        outputMode="Append", timeMode="EventTime",
    )
    return rows.withColumn("first_arrival", F.timestamp_millis("first_arrival"))


def settled_pairs(rows: DataFrame) -> DataFrame:
    """Rows of :func:`stream_pairing` without the triplets that later turned out to be duplicates."""
    twice = rows.where("verdict = 'duplicate'").select("split", "key").distinct()
    return rows.where("verdict <> 'triplet'").unionByName(
        rows.where("verdict = 'triplet'").join(twice, ["split", "key"], "left_anti")
    )


SALTS = 64  # parts of a split's running counts


def stream_audit(cells: DataFrame, salts: int = SALTS) -> DataFrame:
    """Running class histogram and invalid counts per (split, part); use update or complete mode.

    Cells are dealt over ``salts`` parts by tile row, so that one tile or split of very many cells keeps all tasks and
    state partitions busy; :func:`merged_audit` adds the parts up.
    """
    void = F.coalesce(F.col("class") == VOID_CLASS, F.lit(False))
    legal = F.coalesce(F.col("class").between(0, CLASS_COUNT - 1), F.lit(False))
    valid = F.col("valid")
    part = F.pmod(F.xxhash64("tile_id", "row"), F.lit(salts)).cast("int").alias("part")
    return with_validity(cells).groupBy("split", part).agg(
        *[F.count_if(valid & (F.col("class") == c)).alias(f"class_{c}") for c in range(CLASS_COUNT)],
        F.count_if(~finite("height")).alias("height_nonfinite"),
        F.count_if(~legal & ~void).alias("class_illegal"),
        F.count_if(void).alias("void"),
        F.count_if(valid).alias("valid_pixels"),
    )


def merged_audit(parts: DataFrame) -> DataFrame:
    """One row per split from the parts of :func:`stream_audit`."""
    return parts.groupBy("split").agg(*[F.sum(c).alias(c) for c in parts.columns if c not in ("split", "part")])


def run_append(stream: DataFrame, label: str) -> str:
    """Drain an append-mode stream into a Parquet folder; exactly once through its checkpoint."""
    spark = stream.sparkSession
    out = new_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("path", out).option("checkpointLocation", new_path(spark, f"{label}-checkpoint")).start()
    )
    query.awaitTermination()
    return out


def run_complete(stream: DataFrame, label: str) -> str:
    """Drain an aggregate in complete mode, replacing the result at each batch.

    The result has one row per split, and a batch that runs again writes the same rows.
    """
    spark = stream.sparkSession
    out = new_path(spark, label)
    query = (
        stream.writeStream.outputMode("complete").trigger(availableNow=True)
        .option("checkpointLocation", new_path(spark, f"{label}-checkpoint"))
        .foreachBatch(lambda batch, _id: batch.write.mode("overwrite").parquet(out)).start()
    )
    query.awaitTermination()
    return out
