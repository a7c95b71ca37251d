"""Line dedup with a fixed-depth template tree, in DataFrame functions only.

A line descends by its token count and its leading tokens (digits generalised) to a leaf. In a leaf, a token that
recurs at its position stays a constant, any other becomes ``<*>``; lines with the same outcome share a template.
Templates that recur across documents are dropped wherever they stand.

Copies of whole documents also repeat their lines, so a template counts the groups of documents it stands in: equal
texts are one document, and texts that share more than two thirds of their lines with others are one group. A line is
known again as a whole, a long one by either end, so that common openings make no copies. Nor do they make templates:
beyond the leading tokens, which the tree has fixed, half of the tokens must recur too. Boilerplate of any length goes,
copies are left to near-duplicate detection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertab.functions.state import settle

DEPTH = 3  # leading tokens that the tree looks at
MIN_TOKENS = 4  # shorter lines are no templates
MIN_DOCS = 5  # groups of documents in which a template recurs
MOSTLY = 2 / 3  # share of a text's lines that other texts have too, above which it belongs to a group
MIN_CONSTANT = 0.5  # share of constant tokens that a template needs beyond the leading ones
WILD = "<*>"
LONG = 16  # tokens of a line from which a copy may well differ in one of them


TOKENS = "array_remove(split({}, '[\\\\x20\\\\x09-\\\\x0D]+'), '')"


def line_rows(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(text_hash, line_no, line, leaf, anchors) of every line with at least ``min_tokens`` tokens.

    The leaf is the token count and the leading ``depth`` tokens. A line is known again by its anchors: the whole line,
    in lines of ``LONG`` tokens or more either half of so many at its two ends. Digits are generalised in all of them.
    """
    half = LONG // 2
    ends = f"array(xxhash64(array_join(slice(w, 1, {half}), ' ')), xxhash64(concat('end ', array_join(slice(w, -{half}, {half}), ' '))))"
    mark = f"""named_struct('leaf', xxhash64(size(w), array_join(slice(w, 1, {depth}), ' ')),
        'anchors', IF(size(w) >= {LONG}, {ends}, array(xxhash64(array_join(w, ' ')))))"""
    general = TOKENS.format("regexp_replace(l, '[0-9]+', '0')")
    return (
        docs.select(F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"))
        .selectExpr("text_hash", "lines", f"transform(lines, l -> {general}) AS words")
        .selectExpr("text_hash", "lines", f"transform(words, w -> IF(size(w) >= {min_tokens}, {mark}, NULL)) AS marks")
        .selectExpr(
            "text_hash",
            """inline(filter(transform(lines, (l, i) -> named_struct('line_no', i, 'line', l,
                'leaf', marks[i].leaf, 'anchors', marks[i].anchors)), x -> x.anchors IS NOT NULL))""",
        )
    )


def copy_groups(places: DataFrame, mostly: float = MOSTLY) -> DataFrame:
    """(text_hash, group) of the texts that share more than ``mostly`` of their lines; all others stand for themselves.

    ``places`` has (text_hash, line_no, anchors) once for each line. A group is named by its least anchor. Anchors of
    one text alone name none, so changed words do not part copies; a text without its group's least anchor has the
    next one, which the texts with both lead back to the least.
    """
    each = places.select("text_hash", "line_no", F.explode("anchors").alias("anchor"))
    shared = (
        each.groupBy("anchor").agg(F.min("text_hash").alias("one"), F.max("text_hash").alias("other"))
        .where("one <> other").select("anchor", F.lit(True).alias("shared"))
    )
    texts = settle(
        each.join(shared, "anchor", "left").groupBy("text_hash")
        .agg(
            F.slice(F.array_sort(F.collect_set(F.when(F.col("shared"), F.col("anchor")))), 1, 2).alias("least"),
            F.size(F.collect_set(F.when(F.col("shared"), F.col("line_no")))).alias("n"),
            F.size(F.collect_set("line_no")).alias("of"),
        )
        .where(F.col("n") > mostly * F.col("of"))
        .selectExpr("text_hash", "least[0] AS anchor", "get(least, 1) AS next"),
        "copies",
    )
    led = texts.where("next IS NOT NULL").groupBy(F.col("next").alias("anchor")).agg(F.min("anchor").alias("to"))
    return texts.join(led, "anchor", "left").select("text_hash", F.coalesce("to", "anchor").alias("group"))


def recurring(rows: DataFrame, key: str, by: str, min_docs: int = MIN_DOCS) -> DataFrame:
    """The values of ``key`` that stand with ``min_docs`` values of ``by`` or more."""
    once = rows.select(key, by).distinct()
    return once.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select(key)


def text_templates(
    docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS,
    min_constant: float = MIN_CONSTANT,
) -> DataFrame:
    """(text_hash, line_no, template) of every line whose template recurs, once for each distinct text."""
    rows = line_rows(docs, depth, min_tokens)
    places = settle(rows.drop("line").distinct(), "places")
    leaves = recurring(places, "leaf", "text_hash", min_docs)  # a leaf has no fewer texts than its templates groups
    inside = settle(
        rows.drop("anchors").join(leaves, "leaf", "left_semi").dropDuplicates(["text_hash", "line_no"]), "leaves"
    )
    line = ["text_hash", "line_no", "leaf"]
    tokens = inside.select(*line, F.posexplode(F.expr(TOKENS.format("line"))).alias("at", "token"))
    variable = F.col("token").rlike("[0-9]")
    constants = (
        tokens.where(~variable).groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_docs).select("leaf", "at", "token", F.lit(True).alias("constant"))
    )
    shown = F.when(F.col("constant"), F.col("token")).otherwise(WILD)
    templates = settle(
        tokens.join(constants, ["leaf", "at", "token"], "left")
        .groupBy(*[F.col(c) for c in line])
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", shown.alias("s")))), lambda x: x.s), " ")
            .alias("template"),
            F.avg(F.when(F.col("at") >= depth, F.coalesce(F.col("constant"), F.lit(False)).cast("int"))).alias("share"),
        )
        .where(F.col("share") >= min_constant),
        "templates",
    )
    groups = copy_groups(places)
    grouped = templates.join(groups, "text_hash", "left").withColumn("group", F.coalesce("group", "text_hash"))
    found = recurring(grouped, "template", "group", min_docs)
    return templates.join(found, "template", "left_semi").select("text_hash", "line_no", "template")


def template_lines(docs: DataFrame, **rules) -> DataFrame:
    """(doc_id, text_hash, line_no, template) of every line whose template recurs; rules as of ``text_templates``."""
    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).distinct()
    return named.join(text_templates(docs, **rules), "text_hash").select("doc_id", "text_hash", "line_no", "template")


def drop_template_lines(docs: DataFrame, counts: bool = False, **rules) -> DataFrame:
    """``docs`` without the lines of recurring templates; n_chars, where present, follows the text.

    With ``counts`` also n_lines and n_dropped. NULL texts stay NULL and empty ones empty; a text whose lines are all
    templates becomes empty, its row stays. Rows are treated by their text alone, whatever their id; equal texts count
    as one document. No rows give no rows; other columns, whatever their names, pass through.
    """
    gone = text_templates(docs.select("text"), **rules).groupBy("text_hash").agg(F.collect_set("line_no").alias("gone"))
    left, right = docs.alias("d"), gone.alias("g")
    same = F.xxhash64("d.text") == F.col("g.text_hash")
    lines = F.split(F.col("d.text"), "\n")
    kept = F.filter(lines, lambda line, i: ~F.array_contains(F.col("g.gone"), i))
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(F.array_join(kept, "\n"))
    columns = [F.col(f"d.`{c}`") if c not in ("text", "n_chars") else F.length(text).cast("bigint").alias(c)
               if c == "n_chars" else text.alias(c) for c in docs.columns]
    if counts:
        columns += [
            F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
            F.coalesce(F.size("g.gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        ]
    return left.join(right, same, "left").select(*columns)
