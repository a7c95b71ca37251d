"""MinHash near-duplicate detection with tensored banding.

A table key is a pair of half keys, one from each of two small collections. With m half keys of k minhashes on either
side a text has m * m tables of 2k minhashes, for 2mk minhashes instead of 2kmm: at a similarity of 0.8 that is 310
instead of 9610. Two texts meet in a table exactly if they agree in a half key of each side; at the threshold they miss
each other with a probability below ``MISS``.

1. Texts become sets of hashed shingles; equal sets collapse by fingerprint.
2. A few tables of the tensor give every text one or two centres, with which it is compared on full sets. That joins
   nearly all copies into classes, at a cost that is linear in any group.
3. Only half keys that different classes share can make a table where something is left to find. Their pairs are formed
   for those texts alone, so no text writes all m * m keys. Texts of different classes that meet in a table and agree in
   enough half keys put their classes into one family.
4. Inside a family, pairs of different classes that meet in a table are confirmed on full sets.

Every pair of step 3 and 4 is searched in blocks of bounded size; no table, class or family is gathered in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertab.functions.state import settle
from rastertab.llm.common import lists_of, over_texts
from rastertab.llm.ngram_join import shingle_set
from rastertab.llm.scans import dealt_parts
from rastertab.llm.stars import forest, roots

HALF = 5  # minhashes of a half key
MISS = 1e-5  # chance that a pair at the threshold shares no table
FEW = 1e-6  # chance that a pair at the threshold agrees in too few half keys
DIRECT = 12  # tables that name centres
CENTRES = 2  # centres a text is compared with before the search that leaves nothing out
CHUNK = 256  # texts that are compared with one copy of a centre
BLOCK = 1024  # texts of a table or family that one task compares among themselves
SEEN = 200_000  # fingerprints a task remembers so as not to sign copies twice; a bound on memory only
GOLD = np.uint64(0x9E3779B97F4A7C15)


def half_keys(percent: int) -> int:
    """Half keys a side needs at this threshold."""
    return math.ceil(math.log(MISS / 2) / math.log1p(-((percent / 100) ** HALF)))


def least_agreement(percent: int) -> int:
    """Half keys in which two linked texts agree at least, but for a chance of FEW."""
    n, p = 2 * half_keys(percent), (percent / 100) ** HALF
    total, k = 0.0, 0
    while (total := total + math.comb(n, k) * p**k * (1 - p) ** (n - k)) < FEW:
        k += 1
    return max(2, k)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Hasher:
    """Half keys of shingle sets: int64, 2m of them, the first side first."""

    def __init__(self, percent: int):
        self.count = 2 * half_keys(percent)
        rng = np.random.default_rng(percent)
        self.odd = rng.integers(0, 2**31, self.count * HALF, np.uint32) * np.uint32(2) + np.uint32(1)
        self.flip = rng.integers(0, 2**32, self.count * HALF, np.uint32)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        high = (hashes >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.odd), 2**32 - 1, np.uint32)
        for at in range(0, len(high), 512):
            values = high[at : at + 512, None] ^ self.flip
            values *= self.odd
            np.minimum(low, values.min(axis=0), out=low)
        return low

    def keys(self, minima: list[np.ndarray]) -> np.ndarray:
        parts = np.array(minima, np.uint64).reshape(len(minima), self.count, HALF)
        out = np.broadcast_to(_mix(np.arange(1, self.count + 1, dtype=np.uint64) * GOLD), parts.shape[:2])
        for k in range(HALF):
            out = _mix((out + parts[:, :, k]) * GOLD)
        return out.astype(np.int64)


def signed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, fp_a, fp_b, halves): set size, fingerprint and, for the first of equal sets in a task, half keys."""

    def start():
        hasher, seen = Hasher(percent), set()

        def step(texts):
            sizes, a, b, minima, has = [], [], [], [], []
            for text in texts:
                hashes = shingle_set(text, size)
                mark = xxhash.xxh3_128_digest(hashes.tobytes())
                sizes.append(len(hashes))
                a.append(int.from_bytes(mark[:8], "little", signed=True))
                b.append(int.from_bytes(mark[8:], "little", signed=True))
                has.append(len(hashes) > 0 and mark not in seen)
                if has[-1]:
                    minima.append(hasher.minima(hashes))
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(mark)
            flat = hasher.keys(minima).ravel() if minima else np.zeros(0, np.int64)
            return [sizes, a, b, lists_of(flat, [hasher.count * h for h in has], pa.int64())]

        return step

    return over_texts(docs.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("bigint")), start,
                      "n bigint, fp_a bigint, fp_b bigint, halves array<bigint>")


def _columns(batches, n: int) -> list[np.ndarray] | None:
    """Columns of a whole partition of numbers."""
    kept = [b for b in batches if b.num_rows]
    if not kept:
        return None
    return [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in kept]) for k in range(n)]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return begins, np.concatenate((begins[1:], [len(key)]))


def centres(rows: DataFrame) -> DataFrame:
    """(doc_id, centre) from ``rows`` (key, doc_id): the first text of each key, in an order that differs by key.

    A key that several partitions share has a centre in each; those are compared with the least of them.
    """

    def run(batches):
        columns = _columns(batches, 2)
        if columns is None:
            return
        key, doc = columns
        begins, ends = _runs(key)
        first = np.repeat(doc[begins], ends - begins)
        other = first != doc
        rims = np.unique([0, len(begins) - 1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((doc[other], doc[begins[rims]]))), pa.array(np.concatenate((first[other], doc[begins[rims]]))),
                pa.array([None] * int(other.sum()) + key[begins[rims]].tolist(), pa.int64()),
            ],
            ["doc_id", "centre", "rim"],
        )

    mixed = rows.select("key", "doc_id", F.xxhash64("doc_id", "key").alias("_h"))
    dealt = mixed.repartitionByRange(dealt_parts(rows), "key", "_h").sortWithinPartitions("key", "_h").select("key", "doc_id")
    found = settle(dealt.mapInArrow(run, "doc_id bigint, centre bigint, rim bigint"), "centres")
    rims = found.where("rim IS NOT NULL").select(F.col("rim").alias("key"), "doc_id")  # two rows per partition
    across = rims.join(rims.groupBy("key").agg(F.min("doc_id").alias("centre")), "key").where("doc_id <> centre")
    return found.where("rim IS NULL").select("doc_id", "centre").union(across.select("doc_id", "centre"))


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) of the ``pairs`` (doc_id, centre) that link on full sets. Hot centres are copied once per CHUNK texts."""

    def run(batches):
        key, middle, out = None, [], []
        for batch in batches:
            for centre, salt, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (centre, salt) != key:
                    key, middle = (centre, salt), []
                mine = shingle_set(text, size)
                if doc == centre:
                    middle.append(mine)
                elif any(linked(mine, m, percent) for m in middle):
                    out.append((doc, centre))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    load = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    spread = pairs.join(load, "centre").select("centre", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("salt"), "doc_id")
    middles = load.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("centre").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    met = texts.join(spread.union(middles).hint("merge"), "doc_id").select("centre", "salt", "doc_id", "text", (F.col("doc_id") != F.col("centre")).alias("_m"))
    dealt = met.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "_m").select("centre", "salt", "doc_id", "text")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def open_keys(rows: DataFrame) -> DataFrame:
    """Rows (key, comp, doc_id, side) whose key holds two classes or more; no key is gathered."""

    def run(batches):
        columns = _columns(batches, 4)
        if columns is None:
            return
        key, comp = columns[:2]
        begins, ends = _runs(key)
        keep, rim = comp[begins] != comp[ends - 1], np.zeros(len(begins), bool)
        rim[[0, -1]] = True  # such a run may go on in another partition
        size = ends - begins
        some, edge = np.repeat(keep | rim, size), np.repeat(rim, size)
        yield pa.RecordBatch.from_arrays([*(pa.array(c[some]) for c in columns), pa.array(edge[some])], ["key", "comp", "doc_id", "side", "rim"])

    rows = rows.select("key", "comp", "doc_id", "side")
    dealt = rows.repartitionByRange(dealt_parts(rows), "key", "comp").sortWithinPartitions("key", "comp")
    found = settle(dealt.mapInArrow(run, "key bigint, comp bigint, doc_id bigint, side int, rim boolean"), "open")
    rims = found.where("rim")
    split = rims.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    return found.where("NOT rim").drop("rim").union(rims.drop("rim").join(split, "key", "left_semi"))


def _pairs(sketch: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, agree: int):
    """(i, j, agreement) of the pairs left x right with different classes that agree in ``agree`` half keys or more."""
    for at in range(0, len(left), 64):
        some = left[at : at + 64]
        same = np.zeros((len(some), len(right)), np.int16)
        for k in range(sketch.shape[1]):
            same += sketch[some, k][:, None] == sketch[right, k][None, :]
        i, j = np.nonzero((same >= agree) & (comp[some][:, None] != comp[right][None, :]))
        yield some[i], right[j], same[i, j]


def _sketches(column) -> np.ndarray:
    flat = b"".join(column)
    return np.frombuffer(flat, "<u2").reshape(len(column), -1)


def met_classes(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) edges between classes whose texts meet in a table and agree in enough half keys.

    ``rows`` is (key, comp, doc_id, sketch). A table of more than BLOCK texts is searched as pairs of blocks.
    """
    agree = least_agreement(percent)

    def run(batches):
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        key, u, v, block, comp = (np.concatenate([b.column(k).to_numpy() for b in kept]) for k in range(5))
        sketch = _sketches([s for b in kept for s in b.column(5).to_pylist()])
        fresh = (key[1:] != key[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        begins = np.flatnonzero(np.concatenate(([True], fresh)))
        ends = np.concatenate((begins[1:], [len(key)]))
        run_of, size, edges = np.repeat(np.arange(len(begins)), ends - begins), ends - begins, []
        small = size[run_of] <= 8
        for step in range(1, 8):
            i = np.flatnonzero(small[:-step] & (run_of[:-step] == run_of[step:]) & (comp[:-step] != comp[step:]))
            for at in range(0, len(i), 65536):
                x = i[at : at + 65536]
                x = x[(sketch[x] == sketch[x + step]).sum(axis=1) >= agree]
                edges.append((comp[x], comp[x + step]))
        for r in np.flatnonzero(size > 8):
            every = np.arange(begins[r], ends[r])
            left, right = every[block[every] == u[every[0]]], every[block[every] == v[every[0]]]
            for i, j, _ in _pairs(sketch, comp, left, right, agree):
                edges.append(forest(comp[i], comp[j]))
        a, b = forest(*(np.concatenate(x) for x in zip(*edges))) if edges else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    load = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(load, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    placed = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = placed.select("key", F.least("block", "_o").alias("u"), F.greatest("block", "_o").alias("v"), "block", "comp", "sketch")
    keys = ["key", "u", "v"]
    return cut.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def family_links(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) links on full sets that join all linked classes of each family; ``members`` is (family, comp, doc_id, sketch).

    Classes of more than BLOCK texts have blocks of their own, so that no block pair of one class is searched.
    """
    agree = least_agreement(percent)

    def search(ids, comps, texts, marks, blocks, u, v):
        comp, block, sketch = np.array(comps), np.array(blocks), _sketches(marks)
        left, right = np.flatnonzero(block == u), np.flatnonzero(block == v)
        names, now = np.unique(comp, return_inverse=True)
        now, sets, out = np.arange(len(names))[now], {}, []
        found = [np.stack(p) for p in _pairs(sketch, comp, left, right, agree)]
        if not found:
            return out
        i, j, same = np.concatenate(found, axis=1)
        for k in np.argsort(-same, kind="stable"):
            x, y = int(i[k]), int(j[k])
            if now[x] == now[y]:
                continue
            for z in (x, y):
                if z not in sets:
                    sets[z] = shingle_set(texts[z], size)
            if linked(sets[x], sets[y], percent):
                now[now == now[y]] = now[x]
                out.append((ids[x], ids[y]))
        return out

    def run(batches):
        key, held, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != key:
                    if len(held) > 1:
                        out += search(*zip(*held), key[1], key[2])
                    key, held = row[:3], []
                held.append((row[4], row[5], row[6], row[7], row[3]))
        if len(held) > 1:
            out += search(*zip(*held), key[1], key[2])
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    per_class = members.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("m")).withColumn("own", F.col("m") > BLOCK)
    rest = per_class.where("NOT own").groupBy("family").agg(F.ceil(F.sum("m") / BLOCK).cast("int").alias("shared"))
    placed = members.join(per_class, ["family", "comp"]).join(rest, "family", "left")
    alone = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("m") / BLOCK)).cast("bigint")
    # a block is named by a hash: of its class and part, or of the part of the small classes
    block = F.when(F.col("own"), F.xxhash64("comp", alone)).otherwise(F.pmod(F.xxhash64("comp"), F.coalesce("shared", F.lit(1))).cast("bigint"))
    placed = settle(placed.select("family", "comp", "doc_id", "sketch", block.alias("block"), F.when(F.col("own"), F.col("comp")).alias("owner")), "blocks")
    blocks = placed.select("family", "block", "owner").distinct()
    other = blocks.select("family", F.col("block").alias("with"), F.col("owner").alias("_w"))
    # pairs of block names, not of texts; each block meets those at or after it
    met = blocks.join(other, "family").where("block <= with AND NOT coalesce(owner = _w, false)").select("family", F.col("block").alias("u"), F.col("with").alias("v"))
    met = settle(met, "block_pairs")
    sides = met.select("family", "u", "v", F.col("u").alias("block")).union(met.where("u <> v").select("family", "u", "v", F.col("v").alias("block")))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    whole = settle(texts.join(placed.hint("merge"), "doc_id"), "family_texts")
    keys = ["family", "u", "v"]
    spread = whole.join(sides.hint("merge"), ["family", "block"]).select(*keys, "block", "doc_id", "comp", "text", "sketch")
    return spread.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: class of near-duplicate texts by exact Jaccard similarity.

    Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets and they meet in a table;
    component_id is the smallest doc_id reachable by links. NULL, empty and blank texts have no shingles and link with
    nothing. Rows with the same doc_id are one node, whatever their texts; rows without a doc_id link with nothing and
    have no component. No rows give no rows; other columns are left out.
    """
    m = half_keys(percent)
    marks = settle(signed(docs, size, percent), "signed")
    some = marks.where("n > 0").select("doc_id", "fp_a", "fp_b", (F.size("halves") > 0).alias("has"))
    reps = some.groupBy("fp_a", "fp_b").agg(F.min(F.when(F.col("has"), F.col("doc_id"))).alias("rep"))
    copies = settle(some.join(reps, ["fp_a", "fp_b"]).select("doc_id", "rep").distinct(), "copies")
    equal = copies.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    heads = copies.where("doc_id = rep").select("doc_id").distinct()

    base = marks.where(F.size("halves") > 0).select("doc_id", "halves")
    diagonal = F.transform(F.sequence(F.lit(0), F.lit(min(DIRECT, m) - 1)), lambda i: F.xxhash64(F.get("halves", i), F.get("halves", i + m)))
    named = centres(base.select(F.explode(diagonal).alias("key"), "doc_id"))
    rep_of = lambda c: copies.select(F.col("doc_id").alias(c), F.col("rep").alias(f"_{c}"))
    pairs = named.join(rep_of("doc_id"), "doc_id").join(rep_of("centre"), "centre").where("_doc_id <> _centre")
    few = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("_doc_id", "_centre").alias("h"), F.col("_centre").alias("c")))), 1, CENTRES)
    picked = pairs.groupBy("_doc_id").agg(few.alias("c")).select(F.col("_doc_id").alias("doc_id"), F.explode("c.c").alias("centre"))
    near = settle(confirmed(settle(picked, "picked"), docs, size, percent), "near")
    known = equal.union(near)
    found = roots(known)

    comp = heads.join(found, heads.doc_id == found.node, "left").select("doc_id", F.coalesce("root", "doc_id").alias("comp"))
    base = settle(base.join(comp, "doc_id"), "halves")
    keys = open_keys(base.select("comp", "doc_id", F.posexplode("halves").alias("at", "key")).withColumn("side", (F.col("at") >= m).cast("int")))
    side = lambda s: F.collect_set(F.when(F.col("side") == s, F.col("key")))  # noqa: E731  at most m of them
    both = settle(keys.groupBy("doc_id", "comp").agg(side(0).alias("x"), side(1).alias("y")).where("size(x) > 0 AND size(y) > 0"), "tensor")
    table = F.explode(F.flatten(F.transform("x", lambda x: F.transform("y", lambda y: F.xxhash64(x, y)))))
    tables = settle(open_keys(both.select(table.alias("key"), "comp", "doc_id", F.lit(0).alias("side"))).drop("side"), "tables")
    chosen = tables.select("doc_id").distinct()
    sketched = settle(_sketched(base.join(chosen, "doc_id")), "sketches")
    edges = settle(met_classes(tables.join(sketched.select("doc_id", "sketch"), "doc_id"), percent), "met")
    family = roots(edges)
    whole = family.union(family.select(F.col("root").alias("node"), "root")).distinct()
    members = sketched.join(whole.select(F.col("node").alias("comp"), F.col("root").alias("family")), "comp")
    links = settle(family_links(settle(members, "members"), docs, size, percent), "links")

    rooted = roots(known.union(links))
    nameless = over_texts(docs.where("doc_id IS NULL"), lambda: lambda texts: [[len(shingle_set(t, size)) for t in texts]], "n bigint")
    kept = marks.select("doc_id", "n").union(nameless.withColumn("doc_id", F.col("doc_id").cast("bigint"))).withColumnRenamed("n", "n_shingles")
    return kept.join(rooted, kept.doc_id == rooted.node, "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def _sketched(rows: DataFrame) -> DataFrame:
    """(doc_id, comp, sketch): 16 bits of each half key."""

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            flat = column.flatten().to_numpy().astype(np.uint64) >> np.uint64(40)
            width = len(flat) // max(1, batch.num_rows)
            rows = flat.astype("<u2").reshape(batch.num_rows, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "comp", "sketch"])

    return rows.select("doc_id", "comp", "halves").mapInArrow(run, "doc_id bigint, comp bigint, sketch binary")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest doc_id; columns as they were.

    Rows without a doc_id stay; rows that share the doc_id that stays all stay, as one document.
    """
    gone = classes(docs, size, percent).where("doc_id <> component_id").select("doc_id").distinct().alias("g")
    return docs.alias("d").join(gone, F.col("d.doc_id") == F.col("g.doc_id"), "left_anti")
