"""The corpus operators' queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, html_extract, language_id, ngram_join, packing, pii_tagger, prefix_trie, quality_rules, rule_ensemble, token_sstable, url_rules, warc_fixity
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the public tokenizers; it is a parameter of the operators and never copied."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records against a replica that was damaged by rule: md5(url) 00 changed, 01 lost."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), "url", "html")
    mark = F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 2)
    damaged = F.when(mark == "00", F.concat("html", F.lit("?"))).otherwise(F.col("html"))
    primary, replica = (df.select("record_id", warc_fixity.record(F.col("record_id"), F.col("url"), F.col("html")).alias("bytes")) for df in (pages, pages.where(mark != "01").withColumn("html", damaged)))
    return warc_fixity.audit(primary, replica).withColumnRenamed("record_id", "page_id")


def op2_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rule_ensemble.score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = token_sstable.read(token_sstable.write(docs, tokenizer_path(), end_id=0))
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = pii_tagger.tagged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.col(f"n_{kind}") for kind in pii_tagger.BASE]
    return tagged.select("doc_id", *counts, F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_added")


def op6_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ngram_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, num=85, den=100)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*names)


def op9_html_text_to_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, tokenizer_path(), end_id=2, size=1024)
    placed = packing.place(cut.select("doc_id", "piece", "start", F.col("length").cast("long"), F.crc32("ids").alias("ids_crc32"), "task", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


OP1_SQL = """
WITH r AS (
  SELECT page_id, substr(md5(coalesce(url, '')), 1, 2) AS mark, coalesce(html, '') AS body,
         strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
           || 'WARC-Record-ID: <urn:record:' || page_id || '>' || chr(13) || chr(10)
           || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
           || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10))
         + strlen(coalesce(html, '')) + 4 AS n_bytes
  FROM pages)
SELECT page_id, CAST(coalesce(sum(n_bytes) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       CAST(n_bytes AS BIGINT) AS n_bytes,
       CASE mark WHEN '00' THEN 'changed' WHEN '01' THEN 'missing' ELSE 'ok' END AS status
FROM r
"""

#: Measures of the threshold table: what is divided by what.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"), "marks_per_word": ("n_marks", "n_words"), "mean_word_length": ("word_chars", "n_words"), "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"), "stop_word_share": ("n_stop_words", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_word_share": ("n_repeat_words", "n_words"),
}


def _op8_sql() -> str:
    holds = []
    for r in quality_rules.RULES:
        value = "CAST({} AS DOUBLE) / nullif({}, 0)".format(*RATIOS[r.value])
        holds += [f"coalesce({value} {sign} {bound}, true)" for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    count = lambda chars: f"CAST(length(regexp_replace(t, '[^{chars}]', '', 'g')) AS BIGINT)"
    stops = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w,
  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM documents),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS k FROM d)),
p AS (SELECT r, count(DISTINCT i + j) AS n FROM g, (SELECT unnest(range(3)) AS j) WHERE n > 1 GROUP BY r),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, {count("#*$%&|<>")} AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
  {count("!?")} AS n_marks, {count("0-9")} AS n_digits, CAST(length(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) AS BIGINT) AS n_upper, len(lines) AS n_lines, len([x FOR x IN w IF lower(rtrim(x, '.,;:!?')) IN ({stops})]) AS n_stop_words FROM d LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(holds)} AS kept FROM b
"""


#: Nodes are lists of turns; a subtree is the nodes that begin with a node's list. The first part makes crc32 from its polynomial.
OP12_SQL = """
WITH RECURSIVE crcs(i, c, k) AS (SELECT i, i, 0 FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM crcs WHERE k < 8),
crc AS (SELECT i, c FROM crcs WHERE k = 8),
ids AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
walk(c, s, k, r) AS (SELECT c, s, 1, CAST(4294967295 AS BIGINT) FROM ids UNION ALL SELECT w.c, s, k + 1, xor((SELECT crc.c FROM crc WHERE i = xor(r & 255, ascii(substr(s, k, 1)))), r >> 8) FROM walk w WHERE k <= length(s)),
h AS (SELECT c, CAST(xor(r, 4294967295) % 9 AS BIGINT) AS h FROM walk WHERE k = length(s) + 1),
t AS (SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({'d': d, 'b': b} ORDER BY turn NULLS FIRST, d) AS own FROM t GROUP BY c),
p AS (SELECT l.c, coalesce(f.own[1:h.h], []) || l.own[h.h + 1:] AS path FROM l JOIN h ON h.c = l.c LEFT JOIN l f ON f.c = l.c - l.c % 5),
m AS (SELECT c, path, unnest(range(len(path) + 1)) AS depth FROM p),
q AS (SELECT c, depth, len(path) AS n, path[1:depth] AS key, path[1:depth - 1] AS above, CASE WHEN depth > 0 THEN path[depth].b ELSE 0 END AS b FROM m),
v AS (SELECT key, depth, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b, count(*) FILTER (WHERE n > depth) = 0 AS leaf, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM q GROUP BY key, depth),
z AS (SELECT key[1:k] AS key, k AS depth, sum((n_convs - 1) * b) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM (SELECT *, unnest(range(depth + 1)) AS k FROM v) GROUP BY 1, 2),
n AS (SELECT above AS key, depth - 1 AS depth, count(*) AS children FROM v WHERE depth > 0 GROUP BY 1, 2)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN z ON z.key = v.key AND z.depth = v.depth LEFT JOIN n ON n.key = v.key AND n.depth = v.depth LEFT JOIN v u ON u.key = v.above AND u.depth = v.depth - 1 AND v.depth > 0
"""

#: Every order is played through, document by document.
OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, len([x FOR x IN fails IF x]) AS n_fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
e AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, x.i, y.i, z.i] AS p FROM e a, e b, e x, e y, e z WHERE len(list_distinct([a.i, b.i, x.i, y.i, z.i])) = 5),
s AS (SELECT array_to_string([substr('ABCDE', i, 1) FOR i IN p], '') AS filter_order, e.i AS step, p[e.i] AS k, p[1:e.i - 1] AS before FROM o, e),
r AS (SELECT part, filter_order, step, k, fails[k] AS failing, len([i FOR i IN before IF fails[i]]) > 0 AS gone, n_fails, n, good, toxic FROM s, c),
g AS (SELECT part, filter_order, step, k, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failing AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_merkle_audit": OP1_SQL, "op8_quality_rules": _op8_sql(), "op12_prefix_trie": OP12_SQL, "op13_filter_audit": OP13_SQL}
