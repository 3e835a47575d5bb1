"""Queries over the sentences, tokens and spans of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import spans, text
from linkloom.operators import links, sentences
from linkloom.plans.registry import query, table

PIECES = r"""
pieces AS (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])(\s+)', '\1\2' || chr(1), 'g'), chr(1))) AS piece,
    unnest(range(len(string_split(regexp_replace(text, '([.!?])(\s+)', '\1\2' || chr(1), 'g'), chr(1))))) AS sentence_idx
  FROM documents
), offsets AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY sentence_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars_start FROM pieces),
sentences AS (
  SELECT doc_id, sentence_idx, CAST(chars_start AS BIGINT) AS chars_start, regexp_replace(piece, '\s+$', '') AS sentence,
    CAST(chars_start AS BIGINT) + length(regexp_replace(piece, '\s+$', '')) AS chars_end
  FROM offsets WHERE regexp_replace(piece, '\s+$', '') <> ''
)"""


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {PIECES} SELECT * FROM sentences")
def sentences_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sentences(spark, sf_dir)




@query(f"""
WITH {PIECES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_idx) - 1 AS sentence_idx, sentence FROM sentences
WHERE NOT regexp_matches(sentence, '(?i)^(?:(?:\\s+$)|(?:.*</?(?:a|b|div|p|span)>)|(?:[^a-z ]*[0-9])|(?:all rights reserved))') AND lower(sentence) NOT IN ({", ".join(f"'{x}'" for x in text.NULL_LITERALS)})
""".replace("\\\\", "\\"))
def sentence_blacklist_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = [r"\s+$", r".*</?(?:a|b|div|p|span)>", r"[^a-z ]*[0-9]", r"all rights reserved"]
    return sentences.without_blacklisted(document_sentences(spark, sf_dir), "doc_id", patterns).select("doc_id", "sentence_idx", "sentence")


@query(rf"""
WITH {PIECES}, padded AS (SELECT doc_id, sentence_idx, '  ' || sentence || chr(9) AS sentence, sentence_idx % 4 AS s, length(sentence) + 3 - sentence_idx % 3 AS e FROM sentences),
moved AS (SELECT doc_id, sentence_idx, regexp_replace(regexp_replace(sentence, '^\s+', ''), '\s+$', '') AS sentence, greatest(s - 2, 0) AS s, greatest(e - 2, 0) AS e FROM padded)
SELECT doc_id, sentence_idx, sentence, least(s, length(sentence)) AS chars_start, least(e, length(sentence)) AS chars_end FROM moved WHERE least(s, length(sentence)) < least(e, length(sentence))
""")
def sentence_strip_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_sentences(spark, sf_dir).select("doc_id", "sentence_idx", F.concat(F.lit("  "), "sentence", F.lit("\t")).alias("sentence"), (F.col("sentence_idx") % 4).alias("chars_start"), (F.length("sentence") + 3 - F.col("sentence_idx") % 3).alias("chars_end"))
    return sentences.stripped_spans(rows, "sentence", "chars_start", "chars_end")


@query(f"""
WITH {PIECES}, listed AS (SELECT doc_id, list(struct_pack(s := chars_start, e := chars_end) ORDER BY sentence_idx) AS spans FROM sentences GROUP BY doc_id),
asked AS (SELECT s.doc_id, s.sentence_idx, s.chars_start + 3 AS s, s.chars_end + 2 AS e, spans FROM sentences s JOIN listed USING (doc_id)),
placed AS (SELECT *, least(len(list_filter(spans, lambda x: x.e <= s)), len(spans) - 1) AS idx FROM asked)
SELECT doc_id, sentence_idx, idx, greatest(s - spans[idx + 1].s, 0) AS start, least(e, spans[idx + 1].e) - spans[idx + 1].s AS "end" FROM placed
""")
def span_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each sentence, a span from its fourth character to beyond its end, clamped to the document's sentences."""
    rows = document_sentences(spark, sf_dir)
    asked = rows.select("doc_id", "sentence_idx", (F.col("chars_start") + 3).alias("s"), (F.col("chars_end") + 2).alias("e"))
    found = sentences.clamped_spans(asked, rows, "doc_id", "s", "e")
    return found.select("doc_id", "sentence_idx", F.col("idx").cast("long").alias("idx"), F.col("from").alias("start"), F.col("to").alias("end"))


WANTED, UNWANTED = (w.replace("'", "''") for w in (spans.WANTED, spans.UNWANTED))


@query(f"""
WITH {PIECES}, asked AS (SELECT doc_id, sentence_idx, sentence, length(sentence) // 3 AS s, 2 * length(sentence) // 3 AS e FROM sentences WHERE length(sentence) >= 6)
SELECT doc_id, sentence_idx,
  CAST(CASE WHEN regexp_matches(substr(sentence, s + 1, 1), '{WANTED}') THEN CASE WHEN s >= 1 THEN s - length(regexp_extract(substr(sentence, 2, s - 1), '({WANTED}*)$', 1)) ELSE 0 END
    ELSE least(s + length(regexp_extract(substr(sentence, s + 1), '^({UNWANTED}*)', 1)), length(sentence) - 1) END AS BIGINT) AS chars_start,
  CAST(CASE WHEN regexp_matches(substr(sentence, e, 1), '{WANTED}') THEN e - 1 + length(regexp_extract(substr(sentence, e + 1), '^({WANTED}*)', 1))
    ELSE CASE WHEN e - 1 <= 1 THEN e - 1 ELSE greatest(e - 1 - length(regexp_extract(substr(sentence, 1, e), '({UNWANTED}*)$', 1)), 1) END END + 1 AS BIGINT) AS chars_end
FROM asked
""")
def span_harmonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_sentences(spark, sf_dir).where(F.length("sentence") >= 6).select("doc_id", "sentence_idx", "sentence", F.floor(F.length("sentence") / 3).cast("int").alias("s"), F.floor(2 * F.length("sentence") / 3).cast("int").alias("e"))
    start, end = sentences.harmonized(F.col("sentence"), F.col("s"), F.col("e"))
    return rows.select("doc_id", "sentence_idx", start.cast("long").alias("chars_start"), end.cast("long").alias("chars_end"))


TOKENS = rf"""
{PIECES}, marked AS (SELECT doc_id, sentence_idx, string_split(regexp_replace(sentence, '([\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s])', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM sentences),
parts AS (SELECT doc_id, sentence_idx, unnest(p) AS token, unnest(range(len(p))) AS i FROM marked),
placed AS (SELECT *, coalesce(sum(length(token)) OVER (PARTITION BY doc_id, sentence_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM parts),
tokens AS (SELECT doc_id, sentence_idx, CAST(i // 2 AS BIGINT) AS token_idx, token, CAST(s AS BIGINT) AS chars_start, CAST(s AS BIGINT) + length(token) AS chars_end FROM placed WHERE i % 2 = 1)"""


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.tokenize(document_sentences(spark, sf_dir), ["doc_id", "sentence_idx"], "sentence")


@query(f"WITH {TOKENS} SELECT * FROM tokens")
def tokens_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(spark, sf_dir)


@query(f"""
WITH {TOKENS}, asked AS (SELECT doc_id, sentence_idx, CAST(0 AS BIGINT) AS chars_start, length(sentence) - sentence_idx % 2 AS chars_end FROM sentences)
SELECT a.doc_id, a.sentence_idx, a.chars_start, a.chars_end, b.token_idx AS token_idx_from, e.token_idx + 1 AS token_idx_to
FROM asked a JOIN tokens b USING (doc_id, sentence_idx, chars_start) JOIN tokens e ON a.doc_id = e.doc_id AND a.sentence_idx = e.sentence_idx AND a.chars_end = e.chars_end WHERE e.token_idx >= b.token_idx
""")
def span_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = document_sentences(spark, sf_dir).select("doc_id", "sentence_idx", F.lit(0).cast("long").alias("chars_start"), (F.length("sentence") - F.col("sentence_idx") % 2).alias("chars_end"))
    found = sentences.token_spans(asked, document_sentences(spark, sf_dir), ["doc_id", "sentence_idx"])
    return found.select("doc_id", "sentence_idx", "chars_start", "chars_end", "token_idx_from", "token_idx_to")


@query(f"""
WITH {PIECES}, edges AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)
SELECT doc_id, sentence_idx, sentence FROM sentences
WHERE sentence_idx < 5 OR doc_id NOT IN (SELECT dst FROM edges WHERE dst NOT IN (SELECT src FROM edges))
""")
def tail_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scraped pages, orders and parts as the link graph."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    tails = links.tail_pages(edges, table(spark, sf_dir, "documents"), "src", "dst", "doc_id")
    return sentences.truncated_tails(document_sentences(spark, sf_dir), tails, "doc_id").select("doc_id", "sentence_idx", "sentence")


@query(f"""
WITH {PIECES}, around AS (SELECT *, coalesce(lag(sentence) OVER w, '') AS before, coalesce(lead(sentence) OVER w, '') AS after FROM sentences WINDOW w AS (PARTITION BY doc_id ORDER BY sentence_idx))
SELECT doc_id, sentence_idx, before, after, substr(sentence, 1, length(sentence) // 3) || '>>>' || substr(sentence, length(sentence) // 3 + 1, 2 * length(sentence) // 3 - length(sentence) // 3) || '<<<' || substr(sentence, 2 * length(sentence) // 3 + 1) AS highlighted FROM around
""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences.with_context(document_sentences(spark, sf_dir), "doc_id")
    start, end = (F.floor(k * F.length("sentence") / 3).cast("int") for k in (1, 2))
    return rows.select("doc_id", "sentence_idx", "before", "after", text.highlighted(F.col("sentence"), start, end).alias("highlighted"))


@query(f"WITH {PIECES} SELECT doc_id, string_agg(sentence, chr(10) ORDER BY sentence_idx) AS text FROM sentences GROUP BY doc_id")
def sentences_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.joined_text(document_sentences(spark, sf_dir), "doc_id")


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[\p{Cc}\p{Cf}]', '', 'g'), '\p{Z}+', ' ', 'g') AS cleaned FROM documents")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("SELECT n_chars // 500 AS bin, count(*) AS n, count(*) FILTER (n_chars < 500) AS n_short FROM documents GROUP BY 1")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.expr("n_chars div 500").alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 500).alias("n_short"))


@query(f"""
WITH RECURSIVE {TOKENS}, sized AS (SELECT doc_id, sentence_idx, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_idx) AS k FROM tokens GROUP BY doc_id, sentence_idx),
fold AS (
  SELECT doc_id, sentence_idx, k, n AS used, CAST(0 AS BIGINT) AS segment FROM sized WHERE k = 1
  UNION ALL
  SELECT s.doc_id, s.sentence_idx, s.k, CASE WHEN f.used > 0 AND f.used + s.n > 126 THEN s.n ELSE f.used + s.n END, f.segment + CASE WHEN f.used > 0 AND f.used + s.n > 126 THEN 1 ELSE 0 END
  FROM fold f JOIN sized s ON s.doc_id = f.doc_id AND s.k = f.k + 1
)
SELECT doc_id, sentence_idx, segment FROM fold
""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = document_tokens(spark, sf_dir).groupBy("doc_id", "sentence_idx").agg(F.count("*").alias("n"))
    return sentences.segmented(sized, "doc_id", "sentence_idx", "n", 128)


@query("""
WITH items AS (SELECT page_id, unnest(range(len(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>')))) AS sentence_idx,
  unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS to_url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS anchor FROM pages)
SELECT page_id, sentence_idx, 0 AS chars_start, length(anchor) AS chars_end, to_url FROM items
""")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and anchors of whole pages by the structural parse, list items being the containers."""
    from linkloom.sources import html

    rows = html.extract(table(spark, sf_dir, "pages"), "page_id", "url", "html", container="li")
    return rows.select("page_id", F.inline("links")).select("page_id", "sentence_idx", "chars_start", "chars_end", "to_url")
