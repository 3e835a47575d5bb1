"""Queries that keep links, sentences, tokens and pages consistent, and that sample pairs.

``documents`` stand in for scraped pages; every third sentence holds a link from its third character
on, and some links name a sentence that doesn't exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators import consistency, sampling, sentences
from linkloom.plans.registry import query, table
from linkloom.plans.sentence_queries import PIECES, TOKENS, document_sentences, document_tokens

PATTERNS = [r".*</?(?:a|b|div|p|span)>", r"[^a-z ]*[0-9]", r"all rights reserved"]
BLACKLISTED = rf"""(regexp_matches(sentence, '(?i)^(?:(?:.*</?(?:a|b|div|p|span)>)|(?:[^a-z ]*[0-9])|(?:all rights reserved))') OR lower(sentence) IN ({", ".join(f"'{x}'" for x in text.NULL_LITERALS)}))"""
PAGE_LINKS = """
page_links AS (
  SELECT doc_id, CASE WHEN sentence_idx % 9 = 0 THEN sentence_idx + 100000 ELSE sentence_idx END AS sentence_idx, least(2, length(sentence)) AS chars_start, least(9, length(sentence)) AS chars_end
  FROM sentences WHERE sentence_idx % 3 = 0
)"""


def page_links(rows: DataFrame) -> DataFrame:
    idx = F.when(F.col("sentence_idx") % 9 == 0, F.col("sentence_idx") + 100000).otherwise(F.col("sentence_idx"))
    places = [F.least(F.lit(k), F.length("sentence")).cast("long").alias(c) for k, c in ((2, "chars_start"), (9, "chars_end"))]
    return rows.where("sentence_idx % 3 = 0").select("doc_id", idx.alias("sentence_idx"), *places)


@query(f"WITH {PIECES}, {PAGE_LINKS} SELECT l.*, s.sentence FROM page_links l LEFT JOIN sentences s USING (doc_id, sentence_idx)")
def links_with_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_sentences(spark, sf_dir)
    return consistency.with_sentences(page_links(rows), rows, "doc_id").select("doc_id", "sentence_idx", "chars_start", "chars_end", "sentence")


@query(f"WITH {PIECES}, {PAGE_LINKS} SELECT l.*, substr(s.sentence, l.chars_start + 1, l.chars_end - l.chars_start) AS anchor FROM page_links l JOIN sentences s USING (doc_id, sentence_idx)")
def link_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_sentences(spark, sf_dir)
    return consistency.anchors(page_links(rows), rows, "doc_id").select("doc_id", "sentence_idx", "chars_start", "chars_end", "anchor")


@query(f"""
WITH {PIECES}, {PAGE_LINKS}, moves AS (
  SELECT doc_id, sentence_idx, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_idx) - 1 AS new_idx FROM sentences WHERE NOT {BLACKLISTED}
)
SELECT l.doc_id, new_idx AS sentence_idx, l.chars_start, l.chars_end FROM page_links l JOIN moves USING (doc_id, sentence_idx)
""")
def links_after_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_sentences(spark, sf_dir)
    _, moved = consistency.without_blacklisted(rows.select("doc_id", "sentence_idx", "sentence"), page_links(rows), "doc_id", PATTERNS)
    return moved.select("doc_id", "sentence_idx", "chars_start", "chars_end")


@query(f"WITH {PIECES} SELECT doc_id, bool_or({BLACKLISTED}) AS affected FROM sentences GROUP BY doc_id")
def blacklist_affected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.affected_pages(document_sentences(spark, sf_dir), "doc_id", PATTERNS)


@query(rf"""
WITH {PIECES}, cleaned AS (SELECT doc_id, sentence_idx, regexp_replace(regexp_replace(sentence, '[\p{{Cc}}\p{{Cf}}]', '', 'g'), '\p{{Z}}+', ' ', 'g') AS s FROM sentences)
SELECT doc_id, sentence_idx, length(sentence) AS n_before, length(s) AS n_after FROM sentences JOIN cleaned USING (doc_id, sentence_idx) WHERE length(sentence) <> length(s)
""")
def sentence_length_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_sentences(spark, sf_dir)
    return consistency.length_changes(rows, rows.withColumn("sentence", text.clean(F.col("sentence"))), "doc_id")


KEPT = "kept AS (SELECT doc_id FROM documents WHERE n_chars >= 500)"


@query(f"WITH {PIECES}, {PAGE_LINKS}, {KEPT} SELECT * FROM page_links WHERE doc_id IN (SELECT doc_id FROM kept)")
def links_of_kept_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "documents").where("n_chars >= 500")
    return consistency.of_pages(page_links(document_sentences(spark, sf_dir)), kept, "doc_id")


@query(f"WITH {KEPT}, clustered AS (SELECT doc_id * 2 AS doc_id, doc_id % 7 AS cluster FROM documents) SELECT c.doc_id, cluster, lang, n_chars FROM clustered c LEFT JOIN documents USING (doc_id) WHERE c.doc_id NOT IN (SELECT doc_id FROM kept)")
def removed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a clustering names but that were not kept; half of the names are unknown."""
    docs = table(spark, sf_dir, "documents")
    clustered = docs.select((F.col("doc_id") * 2).alias("doc_id"), (F.col("doc_id") % 7).alias("cluster"))
    return consistency.removed_pages(clustered, docs.where("n_chars >= 500"), docs.select("doc_id", "lang", "n_chars"), "doc_id")


@query("SELECT doc_id, left(text, 200) AS text FROM (SELECT doc_id, nullif(text, '') AS text FROM documents) WHERE text IS NOT NULL")
def pages_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.nullif("text", F.lit("")).alias("text"))
    return consistency.with_text(rows).withColumn("text", text.truncated(F.col("text"), 200))


@query(f"""
WITH {TOKENS}, longer AS (SELECT DISTINCT doc_id, sentence_idx FROM tokens WHERE length(token) > 1),
broken AS (SELECT DISTINCT doc_id FROM sentences LEFT JOIN longer l USING (doc_id, sentence_idx) WHERE l.doc_id IS NULL)
SELECT doc_id, sentence_idx FROM sentences WHERE doc_id NOT IN (SELECT doc_id FROM broken)
""")
def whole_tokenizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a tokenizer that knows no single characters, so that it fails on some pages."""
    tokens = document_tokens(spark, sf_dir).where(F.length("token") > 1)
    return consistency.whole_tokenizations(document_sentences(spark, sf_dir), tokens, "doc_id").select("doc_id", "sentence_idx")


SEGMENTED = "segments AS (SELECT doc_id, sentence_idx, sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY sentence_idx) // 300 AS segment FROM sentences)"


@query(f"""
WITH {PIECES}, {SEGMENTED}, mentions AS (SELECT doc_id, sentence_idx AS first_sentence, sentence_idx + sentence_idx % 2 AS last_sentence FROM sentences)
SELECT m.*, CAST(a.segment AS BIGINT) AS segment, a.segment <> b.segment AS is_split FROM mentions m
JOIN segments a ON a.doc_id = m.doc_id AND a.sentence_idx = first_sentence JOIN segments b ON b.doc_id = m.doc_id AND b.sentence_idx = last_sentence
""")
def mention_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = document_sentences(spark, sf_dir)
    run = F.sum(F.length("sentence")).over(Window.partitionBy("doc_id").orderBy("sentence_idx").rowsBetween(Window.unboundedPreceding, 0))
    segments = rows.select("doc_id", "sentence_idx", F.floor(run / 300).alias("segment"))
    mentions = rows.select("doc_id", F.col("sentence_idx").alias("first_sentence"), (F.col("sentence_idx") + F.col("sentence_idx") % 2).alias("last_sentence"))
    return consistency.with_segments(mentions, segments, "doc_id", "first_sentence", "last_sentence").select("doc_id", "first_sentence", "last_sentence", "segment", "is_split")


@query("""
WITH spans AS (SELECT l_orderkey AS doc, l_partkey % 50 AS start, l_partkey % 50 + l_linenumber AS stop FROM lineitem),
gold AS (SELECT o_orderkey AS doc, o_custkey % 50 AS start, o_custkey % 50 + 1 + o_orderkey % 4 AS stop, max(1 + o_custkey % 9) AS label FROM orders GROUP BY ALL)
SELECT s.doc, s.start, s.stop, coalesce(label, 0) AS label FROM spans s LEFT JOIN gold g ON s.doc = g.doc AND s.start = g.start AND s.stop = g.stop
""")
def span_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as candidate spans of their order, orders as one gold span each."""
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + F.col("l_linenumber")).alias("stop"))
    start = F.col("o_custkey") % 50
    gold = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), start.alias("start"), (start + 1 + F.col("o_orderkey") % 4).alias("stop"), (1 + F.col("o_custkey") % 9).alias("label"))
    return consistency.labelled_spans(spans, gold, ["doc", "start", "stop"])


@query("""
WITH tokens AS (SELECT l_orderkey AS doc_id, l_linenumber AS sentence_idx, l_returnflag = 'R' AS is_validated FROM lineitem)
SELECT o_orderkey AS doc_id, o_custkey % 7 + 1 AS sentence_idx, o_custkey AS mention FROM orders o
WHERE EXISTS (SELECT 1 FROM tokens t WHERE t.doc_id = o.o_orderkey AND t.sentence_idx = o.o_custkey % 7 + 1 AND is_validated)
""")
def validated_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("sentence_idx"), (F.col("l_returnflag") == "R").alias("is_validated"))
    mentions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 7 + 1).alias("sentence_idx"), F.col("o_custkey").alias("mention"))
    return consistency.of_validated_sentences(mentions, tokens, "doc_id", "sentence_idx", "is_validated")


@query("SELECT o_custkey AS cluster, o_orderkey AS mention FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def singletons_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("mention"))
    return consistency.without_singletons(mentions, ["cluster"])


@query("""
SELECT l_orderkey AS mention, min(l_linenumber) AS first_token, max(l_linenumber) AS last_token FROM lineitem WHERE l_linenumber <> 2 GROUP BY l_orderkey
""")
def mention_token_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "lineitem").where("l_linenumber <> 2").groupBy(F.col("l_orderkey").alias("mention")).agg(F.collect_list("l_linenumber").alias("tokens_ids"))
    return ids.select("mention", F.array_min("tokens_ids").alias("first_token"), F.array_max("tokens_ids").alias("last_token"))


@query("""
SELECT doc_id, parts[1] AS topic, CASE WHEN len(parts) > 1 AND ends_with(parts[2], 'plus') THEN parts[1] || '_plus' ELSE parts[1] || '_0' END AS subtopic
FROM (SELECT doc_id, string_split(doc_id, '_') AS parts FROM (SELECT (o_custkey % 40) || '_' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN 'plus' WHEN o_orderkey % 3 = 1 THEN 'ecb' ELSE '' END AS doc_id FROM orders))
""")
def doc_id_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("o_orderkey") % 3 == 0, "plus").when(F.col("o_orderkey") % 3 == 1, "ecb").otherwise("")
    rows = table(spark, sf_dir, "orders").select(F.concat_ws("_", (F.col("o_custkey") % 40).cast("string"), F.concat(F.col("o_orderkey").cast("string"), suffix)).alias("doc_id"))
    topic, subtopic = text.doc_topic(F.col("doc_id"))
    return rows.select("doc_id", topic.alias("topic"), subtopic.alias("subtopic"))


@query("SELECT o_orderkey AS page, strftime(o_orderdate, '%Y-%m-%d') || ': ' || o_orderpriority || ' ------- ' || o_orderstatus AS headline FROM orders")
def page_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("page"), text.page_headline(F.col("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("headline"))


DRAW = "CAST('0x' || substr(md5('{seed}:' || draw || ':{salt}'), 1, 8) AS BIGINT)"


def draw(salt: str) -> str:
    return DRAW.format(seed=5, salt=salt)


@query(f"""
WITH mentions AS (SELECT o_orderkey AS mention, o_custkey AS cluster FROM orders),
placed AS (SELECT *, row_number() OVER (ORDER BY cluster, mention) - 1 AS place FROM mentions),
clusters AS (SELECT cluster, min(place) AS start, count(*) AS n, row_number() OVER (ORDER BY cluster) - 1 AS number FROM placed GROUP BY cluster),
draws AS (SELECT CAST(range AS BIGINT) AS draw FROM range(4000)),
picked AS (SELECT draw, {draw("a")} % (SELECT count(*) FROM clusters) AS ca, {draw("b")} % (SELECT count(*) FROM clusters) AS cb FROM draws),
pairs AS (
  SELECT p.draw, a.start + {draw("c").replace("draw", "p.draw")} % a.n AS pa, b.start + {draw("d").replace("draw", "p.draw")} % b.n AS pb
  FROM picked p JOIN clusters a ON a.number = ca JOIN clusters b ON b.number = cb WHERE ca <> cb
)
SELECT DISTINCT least(x.mention, y.mention) AS a, greatest(x.mention, y.mention) AS b FROM pairs JOIN placed x ON x.place = pa JOIN placed y ON y.place = pb
""")
def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of mentions of different clusters: two clusters by lot, then one mention of each."""
    mentions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mention"), F.col("o_custkey").alias("cluster"))
    return sampling.negative_pairs(mentions, "mention", "cluster", 4000, seed=5)


@query("SELECT row_number() OVER (ORDER BY md5('3:' || c_custkey), c_custkey) - 1 AS place, c_custkey FROM customer")
def full_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shuffled(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", seed=3)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST('0x' || substr(md5('9:' || l_orderkey || '-' || l_linenumber), 1, 8) AS BIGINT) < CAST(4294967296 * 0.1 AS BIGINT)")
def bernoulli_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate pair with twenty times the share of positives among all pairs (here 0.005)."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return sampling.bernoulli(rows, F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), 20 * 0.005, seed=9)
