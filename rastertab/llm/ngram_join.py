"""N-gram Jaccard join by T-occurrence search with DivideSkip.

1. Every text becomes its set of hashed n-word shingles. Sets that are equal collapse by fingerprint.
2. Blocks for the search come from partition signatures: the hash space is cut into more parts than two linked sets
   can differ in, so they agree on at least one part that is not empty. Documents that share a signature, directly or
   by way of others, form a family; documents without a family link with nothing.
3. Inside a family, an inverted index over the members' shingles answers each member's T-occurrence query: the short
   lists are merged and counted, the long ones are probed by binary search for the candidates left, and documents
   that reach the overlap the two set sizes require are links. Candidates already connected to the query are skipped,
   since a class needs no second link. Families above ``SPLIT`` members are cut anew without the shingles of frequent
   passages. Families that are still above ``BLOCK`` members or ``VOLUME`` shingles first lose the documents that have too
   few shingles in common with all others together to link with any, then they are searched as pairs of blocks: only
   then a text is copied, once for each block of its family.
4. Links and copies are contracted to classes.

No step gathers a key of unbounded size: signatures are range-partitioned by (signature, document), so one that a
third of all documents share spreads over partitions and yields a chain instead of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertab.functions.state import discard, settle
from rastertab.llm.common import PIECE_ROWS, lists_of, over_texts
from rastertab.llm.stars import dealt_parts, forest, roots

BLOCK = 2048  # members of a family that one task searches among themselves
VOLUME = 1 << 21  # shingles of a family that one task searches among themselves
SPLIT = 64  # members of a family above which it is signed anew without the shingles of frequent passages
SEEN = 200_000  # fingerprints a task remembers so as not to sign copies twice; a bound on memory only
PART_BITS = 14  # counters handed on in one row
SKETCH = 18  # 2^18 counters tell the shingles of frequent passages in families that are too large
ODD = np.uint64(0x9E3779B97F4A7C15)
MU = 0.01  # DivideSkip's weight of a probe against a merge step


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; of all words if fewer; empty without words."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z are lowered, only ASCII blanks split
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    out = h[: len(h) - n + 1] + np.uint64(n)
    for k in range(1, n):
        out = _mix(out * ODD) + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(out * ODD))


class Signer:
    """Partition signatures for a Jaccard threshold of ``percent`` / 100.

    Sizes fall into bands whose bounds grow by 100 / percent. Linked sets lie in the same or in neighbouring bands, so
    each set signs for its own band and the next, by the number of parts of that label. Linked sets of a label with
    largest size r differ in at most H = 2r (100 - percent) / (100 + percent) shingles, hence agree on one of H + 1
    parts; ``spare`` further parts make one of those a part that is not empty, if either set has at most ``spare``
    empty parts. Sets with more also sign their empty parts, so that two such sets meet there.
    """

    def __init__(self, percent: int):
        self.percent = percent
        tops, top = [], 1.0
        while top < 2**40:
            tops.append(int(top))
            top = max(top * 100 / percent, top + 1)
        self.tops = np.array(tops)  # band i holds sizes above tops[i - 1], up to tops[i]

    def parts(self, label: int, thinned: bool = False) -> tuple[int, int]:
        top = int(self.tops[label])
        differ = 2 * top * (100 - self.percent) // (100 + self.percent)
        spare = 2 + differ // (6 if thinned else 25)  # sets without their frequent shingles leave more parts empty
        return differ + 1 + spare, spare

    def sign(self, hashes: np.ndarray, frequent: np.ndarray | None = None) -> np.ndarray:
        """Signatures of a set. With ``frequent`` (a flag per hash bucket) the shingles it flags make up one part of
        their own, never signed, and the others are cut as before: one agreeing part more is certain, so linked sets
        still share a signature, but no longer on the strength of frequent passages."""
        if not len(hashes):
            return np.zeros(0, np.int64)
        band, out = int(np.searchsorted(self.tops, len(hashes))), []
        if frequent is not None:
            hashes = hashes[~frequent[sketch_buckets(hashes)]]
        for label in (band, band + 1):
            parts, spare = self.parts(label, frequent is not None)
            bounds = np.arange(1, parts, dtype=np.uint64) * np.uint64(2**64 // parts)
            ends = np.concatenate(([0], np.searchsorted(hashes, bounds), [len(hashes)]))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(hashes ^ ODD), dtype=np.uint64)))
            part = np.arange(parts, dtype=np.uint64) + np.uint64(label << 40)
            sums = _mix((total[ends[1:]] - total[ends[:-1]]) + _mix((part + np.uint64(1)) * ODD))
            full = ends[1:] > ends[:-1]
            out.append(sums if (~full).sum() > spare else sums[full])
        return np.concatenate(out).astype(np.int64)


def sketch_buckets(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes + ODD) >> np.uint64(64 - SKETCH)).astype(np.int64)


def sketch_counts(docs: DataFrame, size: int) -> DataFrame:
    """(part, counts): how many of ``docs`` fall into each hash bucket, 2^PART_BITS packed counters a row.

    A task hands on its counters as they are, so their rows are 2^(SKETCH - PART_BITS) a task, whatever the texts.
    """
    schema = "part int, counts binary"

    def packed(total: dict[int, np.ndarray]):
        values = [v.tobytes() for v in total.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(values, pa.binary())], ["part", "counts"])

    def count(batches):
        total = np.zeros(1 << SKETCH, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, sketch_buckets(shingle_set(text.as_py(), size)), 1)
        parts = total.reshape(-1, 1 << PART_BITS)
        yield packed({i: v for i, v in enumerate(parts) if v.any()})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(counts.as_py(), np.int64)
                total[part] = total[part] + own if part in total else own
        if total:
            yield packed(total)

    return docs.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema)


def frequent_buckets(docs: DataFrame, size: int) -> np.ndarray:
    """Flags of the hash buckets that clearly more of ``docs`` fall into than the average: those of passages that many
    documents share. Which ones are flagged decides about cost only."""

    counts = np.zeros(1 << SKETCH)
    for r in sketch_counts(docs, size).collect():  # 2^4 rows, 2^SKETCH counts in all
        counts[r.part << PART_BITS : (r.part + 1) << PART_BITS] = np.frombuffer(r.counts, np.int64)
    usual = np.median(counts)
    return counts > usual + np.maximum(20, 6 * np.sqrt(usual))


def signed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, fp_a, fp_b, sigs): set size, fingerprint and, for the first of equal sets in a task, signatures."""

    def start():
        signer, seen = Signer(percent), set()

        def step(texts):
            sizes, a, b, sigs = [], [], [], []
            for text in texts:
                hashes = shingle_set(text, size)
                mark = xxhash.xxh3_128_digest(hashes.tobytes())
                sizes.append(len(hashes))
                a.append(int.from_bytes(mark[:8], "little", signed=True))
                b.append(int.from_bytes(mark[8:], "little", signed=True))
                sigs.append(np.zeros(0, np.int64) if mark in seen else signer.sign(hashes))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(mark)
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            return [sizes, a, b, lists_of(flat, [len(s) for s in sigs], pa.int64())]

        return step

    return over_texts(docs.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("bigint")), start,
                      "n bigint, fp_a bigint, fp_b bigint, sigs array<bigint>")


def chains(pairs: DataFrame) -> DataFrame:
    """(a, b) edges that connect all documents of each signature of ``pairs`` (sig, doc_id)."""

    def run(batches):
        edges, first, last = [], None, None
        for batch in batches:
            sig, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            if last is not None:
                sig, doc = np.concatenate(([last[0]], sig)), np.concatenate(([last[1]], doc))
            first = first or (int(sig[0]), int(doc[0]))
            last = (int(sig[-1]), int(doc[-1]))
            same = (sig[1:] == sig[:-1]) & (doc[1:] != doc[:-1])
            edges.append(np.unique(np.stack([doc[:-1][same], doc[1:][same]]), axis=1))
        if first is None:
            return
        a, b = forest(*np.concatenate(edges, axis=1)) if edges else np.zeros((2, 0), np.int64)
        ends = np.array([first, last])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([a, ends[:, 1]])), pa.array(np.concatenate([b, ends[:, 1]])),
                pa.array([None] * len(a) + ends[:, 0].tolist(), pa.int64()),
            ],
            ["a", "b", "sig"],
        )

    n = dealt_parts(pairs)
    dealt = pairs.select("sig", "doc_id").repartitionByRange(n, "sig", "doc_id").sortWithinPartitions("sig", "doc_id")
    found = settle(dealt.mapInArrow(run, "a bigint, b bigint, sig bigint"), "chains")
    ends = found.where("sig IS NOT NULL").select("sig", "a")  # two rows per partition: signatures cut by its bounds
    across = ends.join(ends.groupBy("sig").agg(F.min("a").alias("b")), "sig").where("a <> b").select("a", "b")
    return found.where("sig IS NULL").select("a", "b").union(across)


def divide_skip(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) of ``left`` with ``right`` that connect all sets which links connect: a spanning forest."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(right, sizes[right])
    flat = np.concatenate([sets[i] for i in right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begins = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    terms, ends = flat[begins], np.concatenate((begins[1:], [len(flat)]))
    width = len(sets)
    ranks = np.empty(width, np.int64)
    ranks[right] = np.arange(len(right))  # postings are in the order of ``right``
    postings = np.repeat(np.arange(len(terms)), ends - begins) * width + ranks[owner]
    comp, groups, links = np.arange(width), width, []
    for q in left:
        mine = sets[q]
        at = np.searchsorted(terms, mine)
        at = at[terms[np.minimum(at, len(terms) - 1)] == mine]
        least = -(-percent * len(mine) // 100)  # the smallest overlap that any partner needs
        if len(at) < least or not len(at):
            continue
        length = ends[at] - begins[at]
        skip = int(max(0, min(least - 1, least / (MU * np.log2(length.max() + 1) + 1))))
        by_length = at[np.argsort(length, kind="stable")]
        short, long = by_length[: len(at) - skip], by_length[len(at) - skip :]
        runs = ends[short] - begins[short]
        shift = np.repeat(begins[short] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs)
        counts = np.bincount(owner[np.arange(runs.sum()) + shift], minlength=width)
        need = -(-percent * (len(mine) + sizes) // (100 + percent))
        cand = np.flatnonzero((counts > 0) & (counts + skip >= need) & (np.minimum(len(mine), sizes) >= need))
        step = 8
        while len(cand := cand[comp[cand] != comp[q]]):
            some, cand = cand[:step], cand[step:]
            step *= 4
            keys = long[:, None] * width + ranks[some][None, :]
            spot = np.minimum(np.searchsorted(postings, keys.ravel()), len(postings) - 1)
            found = (postings[spot] == keys.ravel()).reshape(keys.shape).sum(axis=0)
            for j in some[counts[some] + found >= need[some]]:
                if comp[j] != comp[q]:
                    comp[comp == comp[j]] = comp[q]
                    links.append((int(q), int(j)))
                    groups -= 1
        if groups == 1:
            break
    return links


def family_links(members: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) links among ``members`` (family, u, v, block, doc_id, text), each (family, u, v) searched by itself."""

    def search(rows):
        ids, sets, blocks, u, v = rows
        left, right = np.flatnonzero(np.array(blocks) == u), np.flatnonzero(np.array(blocks) == v)
        if u == v:
            order = np.argsort([len(s) for s in sets], kind="stable")
            left = right = order
        if not len(left) or not len(right):
            return []
        return [(ids[i], ids[j]) for i, j in divide_skip(sets, left, right, percent)]

    def run(batches):
        key, ids, sets, blocks, out = None, [], [], [], []
        pieces = (batch.slice(at, PIECE_ROWS) for batch in batches for at in range(0, batch.num_rows, PIECE_ROWS))
        for piece in pieces:
            for *k, block, doc, text in zip(*(c.to_pylist() for c in piece.columns)):
                if k != key:
                    if len(ids) > 1:
                        out += search((ids, sets, blocks, key[1], key[2]))
                    key, ids, sets, blocks = k, [], [], []
                ids.append(doc)
                sets.append(shingle_set(text, size))
                blocks.append(block)
        if len(ids) > 1:
            out += search((ids, sets, blocks, key[1], key[2]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"]
        )

    keys = ["family", "u", "v"]
    dealt = members.select(*keys, "block", "doc_id", "text").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a bigint, b bigint")


def sizes(member: DataFrame) -> DataFrame:
    return member.groupBy("family").agg(F.count(F.lit(1)).alias("m"))


def blocks_of(member: DataFrame, block: int) -> DataFrame:
    """(family, blocks) of the families of ``member`` (doc_id, family, n) that have anything to search."""
    load = member.groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("volume")).where("m > 1")
    return load.select("family", F.ceil(F.greatest(F.col("m") / block, F.col("volume") / VOLUME)).cast("int").alias("blocks"))


def unlinked(texts: DataFrame, member: DataFrame, size: int, percent: int, part: int = 100) -> DataFrame:
    """(doc_id) of ``member`` (doc_id, family, n, texts) that link with nothing in their family, whole families given.

    What two sets share, the family has twice. So if less than ``percent`` of a set's shingles stand in another text of
    the family, it has no link. Clashes of hashes only let more documents stay, as do several texts of one doc_id, and
    counting in the lowest ``part`` of 100 of the hash space alone, which tells most of them by fewer rows.
    """
    held = texts.select("doc_id", "text").join(member.select("doc_id", "family").hint("merge"), "doc_id")
    top = np.uint64((2**64 - 1) * part // 100)

    def start():
        def step(batch):
            sets = [s[: np.searchsorted(s, top, "right")] for s in (shingle_set(t, size) for t in batch)]
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            return [lists_of(flat, [len(s) for s in sets], pa.int64())]

        return step

    spread = over_texts(held, start, "hashes array<bigint>", keep=("doc_id", "family"))
    each = spread.select("doc_id", "family", F.explode("hashes").alias("h")).select(F.xxhash64("family", "h").alias("h"), "doc_id")
    once = each.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("doc_id")).where("c = 1")
    alone = once.groupBy("doc_id").agg(F.count(F.lit(1)).alias("alone"))
    few = member.where("texts = 1").join(alone, "doc_id").where(100 * (F.col("n") - F.col("alone")) < percent * F.col("n"))
    return few.select("doc_id")


def split_families(texts: DataFrame, large: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, family) of the documents of ``large`` (doc_id) with these ``texts``, signed anew without frequent passages.

    Families grow too large where passages that many documents share make up whole parts of otherwise different
    texts. Linked documents stay together in the families found here, too.
    """
    flags = texts.sparkSession.sparkContext.broadcast(np.packbits(frequent_buckets(texts, size)))  # 2^SKETCH bits

    def start():
        signer, frequent = Signer(percent), np.unpackbits(flags.value).astype(bool)
        return lambda texts: [
            (lambda s: lists_of(np.concatenate([np.zeros(0, np.int64), *s]), [len(x) for x in s], pa.int64()))(
                [signer.sign(shingle_set(t, size), frequent) for t in texts]
            )
        ]

    marks = over_texts(texts, start, "sigs array<bigint>")
    found = roots(chains(marks.select(F.explode("sigs").alias("sig"), "doc_id")))
    ids = large.select("doc_id").distinct()
    return ids.join(found, ids.doc_id == found.node, "left").select("doc_id", F.coalesce("root", "doc_id").alias("family"))


def classes(docs: DataFrame, size: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: class of near-duplicate texts by exact Jaccard similarity.

    Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest doc_id reachable by links. NULL, empty and blank texts have no shingles and link with nothing. Rows with
    the same doc_id are one node, whatever their texts; rows without a doc_id link with nothing and have no
    component. Equal texts are equal sets, hence linked. No rows give no rows; other columns are left out.
    """
    signatures = settle(signed(docs, size, percent), "signed")
    marks = settle(signatures.drop("sigs"), "marks")
    some = marks.where("n > 0").select("doc_id", "fp_a", "fp_b")
    reps = some.groupBy("fp_a", "fp_b").agg(F.min("doc_id").alias("rep"))
    copies = settle(some.join(reps, ["fp_a", "fp_b"]).select("doc_id", "rep").distinct(), "copies")
    edges = copies.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    near = chains(signatures.select(F.explode("sigs").alias("sig"), "doc_id"))
    discard(signatures)
    families = roots(near.union(edges))
    heads = copies.where("doc_id = rep").select("doc_id").distinct()
    member = heads.join(families, heads.doc_id == families.node, "left").select(
        "doc_id", F.coalesce("root", "doc_id").alias("family")
    )
    member = settle(member.join(sizes(member).where("m > 1"), "family"), "families")
    held = marks.groupBy("doc_id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    large = member.where(F.col("m") > SPLIT).select("doc_id")
    if large.isEmpty():
        member = settle(member.select("doc_id", "family").join(held, "doc_id"), "sized")
    else:
        texts = settle(
            docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(large.hint("merge"), "doc_id"), "large"
        )
        kept = member.where(F.col("m") <= SPLIT).select("doc_id", "family")
        member = kept.union(split_families(texts, large, size, percent))
        member = settle(member.join(held, "doc_id"), "sized")
        for part in (min(100, 3 * (100 - percent) // 2), 100):  # most go by a part of the hashes, the rest by all
            whole = settle(member.join(blocks_of(member, block).where("blocks > 1").select("family"), "family"), "whole")
            if whole.isEmpty():
                break
            gone = settle(unlinked(texts, whole, size, percent, part), "unlinked")
            member = settle(member.join(gone, "doc_id", "left_anti"), "linkable")
        discard(texts)
    member = settle(
        member.join(blocks_of(member, block), "family")
        .select("doc_id", "family", "blocks", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("block")),
        "members",
    )
    spread = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(member.hint("merge"), "doc_id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"), "block", "doc_id", "text")
    )
    links = settle(family_links(spread, size, percent), "links")
    rooted = roots(links.union(edges))
    nameless = _sizes(docs.where("doc_id IS NULL"), size).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    kept = marks.select("doc_id", "n").union(nameless).withColumnRenamed("n", "n_shingles")
    return kept.join(rooted, kept.doc_id == rooted.node, "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")
    )


def _sizes(docs: DataFrame, size: int) -> DataFrame:
    return over_texts(docs, lambda: lambda texts: [[len(shingle_set(t, size)) for t in texts]], "n bigint")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest doc_id; columns as they were.

    Rows without a doc_id stay; rows that share the doc_id that stays all stay, as one document.
    """
    gone = classes(docs, size, percent).where("doc_id <> component_id").select("doc_id").distinct().alias("g")
    return docs.alias("d").join(gone, F.col("d.doc_id") == F.col("g.doc_id"), "left_anti")
