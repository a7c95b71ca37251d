"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

Every window of a benchmark item is searched from the term of it that is rarest in the corpus. The postings of those
terms (document, position, neighbouring words) are stored; a posting less the term's offset gives the start of a
candidate, and the lists of the window's other terms are intersected there, on the words the posting carries.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertab.functions.state import settle

WINDOW = 10
SLACK = 5  # words by which a proximity match may be wider than the window
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # A-Z are lowered after the cut


def raw_words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), NOT_WORD), "")


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    plain = F.length(word) == F.octet_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, at, words) of every run of ``window`` words of an item, or of all its words if fewer."""
    words = F.transform(raw_words(), lowered)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("words"))
        .where(F.size("words") > 0)
        .select("item_id", "words", F.explode(starts).alias("at"))
        .select("item_id", "at", F.slice("words", F.col("at") + 1, window).alias("words"))
    )


def anchored(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows`` with the rarest term of each in ``docs`` and its offset; equally rare terms: the first.

    A window is its words, so texts that share an item_id, or have none, keep all of theirs.
    """
    terms = settle(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    seen = docs.select(F.explode(raw_words()).alias("word")).select(lowered(F.col("word")).alias("term"))
    counts = seen.join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    each = windows.select("words").distinct().select("words", F.posexplode("words").alias("offset", "term"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term")).alias("r")
    found = each.join(counts, "term", "left").groupBy("words").agg(rarest)
    return windows.join(found, "words").select("item_id", "at", "words", "r.n", "r.offset", "r.term")


def postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """(term, doc_id, text_hash, pos, before, near): where ``terms`` stand, with ``reach`` words to either side.

    ``near[before]`` is the term itself. Only hits are kept while the words stream by; ``terms`` is joined without a
    hint, so Spark broadcasts it by its stored size or else exchanges.
    """
    begins = F.greatest(F.col("pos") - reach, F.lit(0))
    return (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), raw_words().alias("words"))
        .select("doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "word"))
        .withColumn("term", lowered(F.col("word")))
        .join(terms, "term")
        .select(
            "term", "doc_id", "text_hash", "pos", (F.col("pos") - begins).alias("before"),
            F.transform(F.slice("words", begins + 1, F.col("pos") - begins + 1 + reach), lowered).alias("near"),
        )
    )


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """(doc_id, text_hash, item_id, kind, pos, n): exact and proximity matches.

    kind 'phrase': the ``n`` words from ``pos`` on are a window of the item. kind 'proximity': the rarest term of a
    window stands at ``pos`` and at least ``window`` - 1 of the window's words (all, where it has two) lie within
    ``slack`` words of their place, in any order, without the phrase being there.
    """
    windows = settle(anchored(docs, item_windows(benchmark, window)).where("n > 0"), "windows")
    terms = settle(windows.select("term").distinct(), "terms")
    index = settle(postings(docs, terms, window - 1 + slack), "postings")
    shapes = settle(
        windows.select("term", "offset", F.size("words").alias("n")).distinct(), "shapes"
    )
    tried = index.join(shapes, "term").where(F.col("before") >= F.col("offset"))
    phrase = F.array_join(F.slice("near", F.greatest(F.col("before") - F.col("offset"), F.lit(0)) + 1, F.col("n")), " ")
    wanted = windows.select(
        "item_id", "at", "offset", F.array_join("words", " ").alias("phrase")
    )
    exact = (
        tried.select("doc_id", "text_hash", (F.col("pos") - F.col("offset")).alias("pos"), "n", "offset", phrase.alias("phrase"))
        .join(wanted.drop("at").distinct(), ["offset", "phrase"])
        .select("doc_id", "text_hash", "item_id", F.lit("phrase").alias("kind"), "pos", "n")
    )
    if slack <= 0:
        return exact
    # the second-rarest lists, offset-adjusted with slack: words of the window around the anchor, counted per window
    around = index.select(
        "term", "doc_id", "text_hash", "pos", F.explode(F.array_distinct(F.col("near"))).alias("other")
    )
    others = windows.select("item_id", "at", "words", "term", F.explode(F.array_distinct("words")).alias("other"),
                            F.size(F.array_distinct("words")).alias("of"))
    close = (
        around.join(others, ["term", "other"])
        .groupBy("doc_id", "text_hash", "item_id", "at", "words", "pos")
        .agg(F.count(F.lit(1)).alias("found"), F.first("of").alias("of"))
        .where(F.col("found") >= F.when(F.col("of") > 2, F.col("of") - 1).otherwise(F.col("of")))
        .groupBy("doc_id", "text_hash", "item_id").agg(F.min("pos").alias("pos"), F.max("found").alias("n"))
    )
    c, e = close.alias("c"), exact.select("doc_id", "text_hash", "item_id").distinct().alias("e")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"e.{k}")) for k in ("doc_id", "text_hash", "item_id")]
    close = c.join(e, same, "left_anti")
    return exact.unionByName(
        close.select("doc_id", "text_hash", "item_id", F.lit("proximity").alias("kind"), "pos", F.col("n").cast("int").alias("n"))
    )


def hit_words(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_hit, items): words inside any phrase match, and the items matched, sorted."""
    phrases = found.where("kind = 'phrase'")
    return phrases.groupBy("doc_id", "text_hash").agg(
        F.expr(
            """aggregate(array_sort(collect_set(struct(pos, n))), named_struct('hit', 0L, 'end', 0L),
                (a, s) -> named_struct('hit', a.hit + greatest(0L, s.pos + s.n - greatest(s.pos, a.end)),
                                       'end', greatest(a.end, cast(s.pos + s.n AS bigint))), a -> a.hit)"""
        ).alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) of every document.

    NULL and empty texts have no words; items without words match nothing. All texts of an item_id count; those without one
    count as hits and contaminate, but there is no id to list, so n_items may be 0 then. Rows are told apart by doc_id and text: repeated rows and NULL ids get the verdict of their text. Without items or
    documents nothing is hit. Other columns are left out.
    """
    hits = hit_words(matches(docs, benchmark, window, slack=0))
    all_docs = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"),
                           F.size(raw_words()).cast("bigint").alias("n_words")).alias("d")
    h = hits.alias("h")
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_hash") == F.col("h.text_hash"))
    return all_docs.join(h, same, "left").select(
        "d.doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a phrase match, columns as they were."""
    h = hit_words(matches(docs, benchmark, window, slack=0)).alias("h")
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.xxhash64("d.text") == F.col("h.text_hash"))
    return docs.alias("d").join(h, same, "left_anti")
