"""Prefix trie of conversations by the Euler-tour technique.

1. Turns are scanned in order (range partitions, running polynomial lanes), which gives every prefix of a conversation
   a 124-bit mark without gathering a conversation. Marks move from an original to a rebuilt conversation by
   arithmetic: a rebuilt prefix is the base's mark plus the shifted rest.
2. Equal marks are one node. Nodes are numbered densely by (smallest member, depth), which keeps chains together.
3. Every node has an enter and an exit arc; successors come from the order of siblings. The tour is list-ranked over
   blocks and by pointer doubling, so arcs get positions.
4. Leaves and savings of a subtree are differences of prefix sums at the positions of its two arcs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertab.functions.state import settle
from rastertab.llm.scans import BLOCK, PRIME, dealt_parts, list_rank, powers, running

LANES = {"t0": 1_103_515_245, "t1": 69_069, "t2": 1_664_525, "t3": 134_775_813}  # bases of the four lanes
GROUP, HEADS = 20, 4  # conversations share a base by GROUP; at most HEADS - 1 turns come from it
CHUNK_IDS = 4096  # ids that are written as one piece of text before hashing
LEAF_HASH = hashlib.sha256(b"").hexdigest()


def turn_marks(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, mark, words, t0..t3): a row per turn with a conv_id; texts stay behind."""

    def run(batches):
        for batch in batches:
            marks, words, lanes = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                r, t = (role or "").encode(), (text or "").encode()
                digest = hashlib.blake2b(len(r).to_bytes(8, "little") + r + t, digest_size=16).digest()
                marks.append(digest)
                words.append(len(t.split()))
                lanes.append(np.frombuffer(digest, "<u4"))
            flat = np.array(lanes, np.int64).reshape(-1, 4) % PRIME
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2).fill_null(""), pa.array(marks, pa.binary()), pa.array(words, pa.int64()),
                 *(pa.array(np.ascontiguousarray(flat[:, k])) for k in range(4))],
                ["conv_id", "turn", "role", "mark", "words", *LANES],
            )

    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    )
    return slim.mapInArrow(run, "conv_id bigint, turn bigint, role string, mark binary, words bigint, " + ", ".join(f"{c} bigint" for c in LANES))


def _shared(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, k0, k1, p0, p1, words, ends): a row per prefix of every rebuilt conversation.

    (depth, k0, k1) marks the prefix, (depth - 1, p0, p1) its parent; the root has depth 0 and no parent. ``ends`` tells
    the whole conversation from its proper prefixes.
    """
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "mark"]
    turns = running(settle(turn_marks(conversations), "marks"), order, ["conv_id"], lanes=LANES, label="turns")
    turns = settle(turns.drop("turn", "role", "mark"), "prefixes")
    at = lambda c, k: F.max(F.when(F.col("seq") == k, F.col(c)))
    picked = [f"run_{t}" for t in LANES] + ["words"]
    heads = settle(
        turns.groupBy("conv_id").agg(
            F.count(F.lit(1)).alias("n"), *(F.array(*(at(c, k) for k in range(1, HEADS))).alias(f"h_{c}") for c in picked)
        ),
        "heads",
    )
    base = heads.select(F.col("conv_id").alias("base"), F.col("n").alias("bn"), *(F.col(f"h_{c}").alias(f"b_{c}") for c in picked))
    who = heads.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(base, "base", "left").withColumn("h", _shared(F.col("conv_id")))
    who = who.withColumn("lb", F.least("h", F.coalesce("bn", F.lit(0)))).withColumn("own", F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    head = lambda side, c, k: F.when(k > 0, F.get(F.col(f"{side}_{c}"), k.cast("int") - 1)).otherwise(0)
    who = settle(
        who.select(
            "conv_id", "h", "lb", "own",
            *(head("b", f"run_{t}", F.col("lb")).alias(f"from{j}") for j, t in enumerate(LANES)),
            *(head("h", f"run_{t}", F.least("h", "n")).alias(f"gone{j}") for j, t in enumerate(LANES)),
            *(F.col(f"b_{c}") for c in picked),
        ),
        "rebuilt",
    )

    def key(lanes) -> list[Column]:
        a, b, c, d = lanes
        return [F.shiftleft(a, 31).bitwiseOR(b), F.shiftleft(c, 31).bitwiseOR(d)]

    names = ["k0", "k1", "p0", "p1"]
    depth = F.explode(F.sequence(F.lit(0), F.col("lb").cast("int"))).alias("d")
    kept = who.select("conv_id", "lb", "own", *(f"b_{c}" for c in picked), depth)
    of = lambda k: key([head("b", f"run_{t}", k) for t in LANES])
    none = F.lit(None).cast("bigint")
    first = kept.select(
        "conv_id", F.col("d").cast("bigint").alias("depth"), *(c.alias(n) for c, n in zip(of(F.col("d")), names)),
        *(F.when(F.col("d") > 0, c).otherwise(none).alias(n) for c, n in zip(of(F.col("d") - 1), names[2:])),
        head("b", "words", F.col("d")).cast("bigint").alias("words"), ((F.col("d") == F.col("lb")) & (F.col("own") == 0)).alias("ends"),
    )
    # own turns after the first h: lanes lose what stood before them and move by lb - h places
    inverse = [pow(b, PRIME - 2, PRIME) for b in LANES.values()]
    rest = turns.where(F.col("seq") > _shared(F.col("conv_id"))).join(who, "conv_id")
    now, before = [], []
    for j, (t, b) in enumerate(LANES.items()):
        back = F.lit(1).cast("bigint")
        for k in range(1, HEADS):
            back = F.when(F.col("h") - F.col("lb") == k, F.lit(pow(inverse[j], k, PRIME)).cast("bigint")).otherwise(back)
        run, gone = F.col(f"run_{t}"), F.col(f"gone{j}")
        moved = lambda s: (F.col(f"from{j}") + back * ((s - gone + PRIME) % PRIME)) % PRIME  # noqa: B023, E731
        now.append(moved(run))
        before.append(moved(F.col(f"before_{t}")))
    rest = _with_before(rest)
    later = rest.select(
        "conv_id", (F.col("lb") + F.col("seq") - F.col("h")).alias("depth"), *(c.alias(n) for c, n in zip([*key(now), *key(before)], names)),
        "words", (F.col("seq") - F.col("h") == F.col("own")).alias("ends"),
    )
    return first.unionByName(later)


def _with_before(rows: DataFrame) -> DataFrame:
    """Lanes of the prefix one turn shorter, from the turn's own term."""
    lanes = list(LANES)

    def run(batches):
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy()  # noqa: B023, E731
            made = [(col(f"run_{t}") - col(t) * powers(LANES[t], col("seq"))) % PRIME for t in lanes]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], names=[*batch.schema.names, *(f"before_{t}" for t in lanes)])

    kept = ["conv_id", "seq", "words", "h", "lb", "own", *(f"from{j}" for j in range(4)), *(f"gone{j}" for j in range(4)), *lanes, *(f"run_{t}" for t in lanes)]
    slim = rows.select(*(F.col(c).cast("bigint").alias(c) for c in kept))
    return slim.mapInArrow(run, ", ".join(f"{c} bigint" for c in [*kept, *(f"before_{t}" for t in lanes)]))


def end_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from ``ends`` (node, conv_id): hash of the ids in ascending order, comma-joined.

    The text of a node's ids is written in pieces by ranges of (node, conv_id); the hash itself, which is sequential by
    nature, streams over those pieces with constant memory.
    """

    def write(batches):
        node, ids, out = None, [], []
        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != node or len(ids) >= CHUNK_IDS:
                    if ids:
                        out.append((node, ids[0], ",".join(map(str, ids)).encode()))
                    node, ids = n, []
                ids.append(c)
        if ids:
            out.append((node, ids[0], ",".join(map(str, ids)).encode()))
        for at in range(0, len(out), 4096):
            some = out[at : at + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _, _ in some], pa.int64()), pa.array([i for _, i, _ in some], pa.int64()), pa.array([t for _, _, t in some], pa.binary())],
                ["node", "at", "ids"],
            )

    def digest(batches):
        node, state, done = None, None, []
        for batch in batches:
            for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != node:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(t)
                else:
                    state.update(b"," + t)
            yield _hashes(done)
            done = []
        if state is not None:
            yield _hashes([(node, state.hexdigest())])

    def _hashes(rows):
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.string())], ["node", "ends_sha256"])

    dealt = ends.select("node", "conv_id").repartitionByRange(dealt_parts(ends), "node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = dealt.mapInArrow(write, "node bigint, at bigint, ids binary")
    joined = pieces.repartition("node").sortWithinPartitions("node", "at").select("node", "ids")
    return joined.mapInArrow(digest, "node bigint, ends_sha256 string")


def tour(nodes: DataFrame) -> DataFrame:
    """(arc, next) of the Euler tour: arc 2v enters node v, 2v + 1 leaves it. ``nodes`` is (v, parent)."""
    sib = settle(running(nodes.where("parent IS NOT NULL"), ["parent", "v"], ["parent"], label="siblings"), "placed")
    after = sib.select("parent", (F.col("seq") - 1).alias("seq"), F.col("v").alias("beside"))
    leave = sib.join(after, ["parent", "seq"], "left").select(
        (2 * F.col("v") + 1).alias("arc"), F.coalesce(2 * F.col("beside"), 2 * F.col("parent") + 1).alias("next")
    )
    child = sib.where("seq = 1").select(F.col("parent").alias("v"), F.col("v").alias("child"))
    enter = nodes.join(child, "v", "left").select((2 * F.col("v")).alias("arc"), F.coalesce(2 * F.col("child"), 2 * F.col("v") + 1).alias("next"))
    top = nodes.where("parent IS NULL").select((2 * F.col("v") + 1).alias("arc"), F.lit(None).cast("bigint").alias("next"))
    return enter.unionByName(leave).unionByName(top)


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per node of the prefix trie of the rebuilt conversations, see :func:`rebuilt_turns`.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, members_end). conv_id is
    the node's smallest member. Rows without a conv_id are left out, and so are extra columns; turns are ordered by
    turn (NULL first), ties by role, then by a hash of role and text; equal rows are turns of their own. NULL roles and
    texts are empty. A table without conversations has no nodes, not even a root.
    """
    rows = settle(rebuilt_turns(conversations), "nodes")
    mark = ["depth", "k0", "k1"]
    grouped = rows.groupBy(*mark).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("p0").alias("p0"), F.min("p1").alias("p1"),
        F.min("words").alias("words"),
    )
    numbered = running(grouped, ["conv_id", "depth"], label="numbered").withColumn("v", F.col("seq") - 1).drop("seq")
    numbered = settle(numbered, "numbered")
    above = numbered.select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("v").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = settle(numbered.join(above, ["depth", "p0", "p1"], "left"), "parents")
    arcs = settle(tour(nodes.select("v", "parent")), "tour")
    ranked = list_rank(arcs, block)
    total = 2 * nodes.count()
    ends_at = ranked.groupBy(F.floor(F.col("arc") / 2).alias("v")).agg(
        F.max(F.when(F.col("arc") % 2 == 0, total - F.col("left"))).alias("enter"), F.max(F.when(F.col("arc") % 2 == 1, total - F.col("left"))).alias("exit")
    )
    met = nodes.join(ends_at, "v").withColumn("leaf", (F.col("exit") == F.col("enter") + 1).cast("bigint")).withColumn(
        "own", (F.col("n_convs") - 1) * F.col("words")
    )
    met = settle(met, "positions")
    steps = met.select(F.inline(F.array(
        F.struct("v", F.col("enter").alias("pos"), F.lit(-1).cast("bigint").alias("sign"), F.col("leaf"), F.col("own")),
        F.struct("v", F.col("exit").alias("pos"), F.lit(1).cast("bigint").alias("sign"), F.lit(0).cast("bigint").alias("leaf"), F.lit(0).cast("bigint").alias("own")),
    )))
    summed = running(steps, ["pos"], sums=["leaf", "own"], label="sums")
    inside = lambda c: F.sum(F.when(F.col("sign") > 0, F.col(f"run_{c}")).otherwise(F.col(c) - F.col(f"run_{c}")))
    below = summed.groupBy("v").agg(inside("leaf").alias("n_leaves"), inside("own").alias("saved_tokens"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("v")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = rows.where("ends").select(*mark, F.col("conv_id").alias("member"))
    ends = settle(ends.join(numbered.select(*mark, "v"), mark).select(F.col("v").alias("node"), F.col("member").alias("conv_id")), "ends")
    hashes = end_hashes(ends).withColumnRenamed("node", "v")
    counted = ends.groupBy(F.col("node").alias("v")).agg(F.count(F.lit(1)).alias("members_end"))
    out = met.join(below, "v").join(children, "v", "left").join(hashes, "v", "left").join(counted, "v", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(LEAF_HASH)).alias("ends_sha256"), F.coalesce("members_end", zero).alias("members_end"),
    )
