"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastertab.llm import (
    byte_bpe, cross_parsing, line_templates, ngram_join, ordinal_quality, positional_index, prefix_trie, quality_llr,
    secret_cnn, tensor_minhash, token_counts, token_files, whitening,
)
from rastertab.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _classes_sql(percent: int, last: str = "") -> str:
    """Classes of texts whose sets of 4-word shingles link at ``percent``, by counting shared shingles of all pairs."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, array_to_string(w[i:i+3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w)-2)) AS i FROM d WHERE len(w) >= 4) UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= {percent} * (u.n + v.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
cc(doc_id, c) USING KEY (doc_id) AS (SELECT doc_id, doc_id FROM d UNION SELECT m.doc_id, min(k.c) FROM cc k JOIN e ON e.a = k.doc_id JOIN recurring.cc m ON m.doc_id = e.b WHERE k.c < m.c GROUP BY m.doc_id)
SELECT cc.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id{last} FROM cc LEFT JOIN n USING (doc_id)"""


@query("op1_byte_bpe")
def op1(spark, sf_dir):
    rows = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op4_quality_llr")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_llr.judge(docs, quality_llr.fit(docs, table(spark, sf_dir, "labels")))


@query("op6_ngram_join", _classes_sql(85))
def op6(spark, sf_dir):
    return ngram_join.classes(table(spark, sf_dir, "documents"), size=4, percent=85)


@query("op9_line_templates")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_template_lines(docs, counts=True).select("doc_id", "text", "n_lines", "n_dropped")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op10_positional_index", f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w)-n+2)) AS i FROM b)),
dw AS (SELECT r, n, i, array_to_string(w[i:i+n-1], ' ') AS run FROM (SELECT r, w, n, unnest(range(1, len(w)-n+2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT r, item_id, i, n FROM dw JOIN bw USING (n, run)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i+n)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)""")
def op10(spark, sf_dir):
    found = positional_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query("op5_token_files")
def op5(spark, sf_dir):
    rows = token_files.token_files(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op2_cross_parsing")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = cross_parsing.fit(docs.where("doc_id IS NOT NULL").where(~held_out))
    found = cross_parsing.languages(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op7_ordinal_quality")
def op7(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # graded ratings: 0 toxic, 1 poor, 2 good
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = ordinal_quality.fit(docs, labels.select("doc_id", grade.alias("grade")))
    return ordinal_quality.grade(docs, model).select(
        "doc_id", "expected_grade", F.get("tails", F.lit(0)).alias("p_not_toxic"), F.get("tails", F.lit(1)).alias("p_good"), "kept"
    )


@query("op8_token_counts")
def op8(spark, sf_dir):
    found = token_counts.section_tokens(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_tokens", F.size("begins").cast("bigint").alias("n_sections"), "n_crossing",
        F.array_max("tokens").cast("bigint").alias("most_in_section"), "tokens",
    )


@query("op3_secret_cnn")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secret_cnn.scan(docs, secret_cnn.fit(docs))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
    )


@query("op11_prefix_trie")
def op11(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_tensor_minhash", _classes_sql(80, ", c = cc.doc_id AS kept"))
def op12(spark, sf_dir):
    found = tensor_minhash.classes(table(spark, sf_dir, "documents"), size=4, percent=80)
    # a row without a doc_id is a class of its own
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def whitened_rows(embeddings):
    """A row per vector and component."""
    found = whitening.whiten(embeddings, "vec_id")
    wide = found.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return wide.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"), "identity_error",
    )


@query("op13_whitening")
def op13(spark, sf_dir):
    return whitened_rows(table(spark, sf_dir, "embeddings"))
