"""Queries on span assignment, annotated clusters, segments, encoder shapes and running sums.

Orders stand in for documents and their line numbers for sentences, tokens or mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators import coref, dedup, ecb, matching, metrics, parses, sampling, sentences, vectors
from linkloom.plans.registry import query, table
from linkloom.plans.sentence_queries import TOKENS, document_tokens

LINES = """
lines AS (
  SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS line, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_returnflag) AS flag
  FROM lineitem GROUP BY ALL
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("line"))
    return rows.agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.min("l_returnflag").alias("flag"))


# The best total over pairs in order of place: a pair excludes those before it that share one of its spans.
MATCHING = f"""
{LINES},
a AS (SELECT doc, line AS id, line * 10 + part % 4 AS s, line * 10 + part % 4 + 3 + supp % 5 AS e FROM lines),
b AS (SELECT doc, line AS id, line * 7 + supp % 3 AS s, line * 7 + supp % 3 + 2 + part % 4 AS e FROM lines),
pairs AS (SELECT doc, a.id AS a, b.id AS b, least(a.e, b.e) - greatest(a.s, b.s) AS w, row_number() OVER (PARTITION BY doc ORDER BY a.id, b.id) AS k FROM a JOIN b USING (doc) WHERE least(a.e, b.e) > greatest(a.s, b.s)),
free AS (SELECT p.doc, p.k, p.w, count(q.k) AS prev FROM pairs p LEFT JOIN pairs q ON q.doc = p.doc AND q.k < p.k AND q.a <> p.a AND q.b <> p.b GROUP BY ALL),
best AS (
  SELECT doc, CAST(0 AS BIGINT) AS k, [CAST(0 AS BIGINT)] AS totals, [CAST([] AS BIGINT[])] AS chosen FROM (SELECT DISTINCT doc FROM pairs)
  UNION ALL
  SELECT f.doc, f.k, CASE WHEN f.w + totals[prev + 1] > totals[f.k] THEN list_append(totals, f.w + totals[prev + 1]) ELSE list_append(totals, totals[f.k]) END,
    CASE WHEN f.w + totals[prev + 1] > totals[f.k] THEN list_append(chosen, list_append(chosen[prev + 1], f.k)) ELSE list_append(chosen, chosen[f.k]) END
  FROM best t JOIN free f ON f.doc = t.doc AND f.k = t.k + 1
),
picked AS (SELECT doc, unnest(chosen[k + 1]) AS k FROM best QUALIFY row_number() OVER (PARTITION BY doc ORDER BY best.k DESC) = 1),
matched AS (SELECT doc, a, b FROM pairs JOIN picked USING (doc, k))"""


def spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = lines(spark, sf_dir)
    a, b = F.col("line") * 10 + F.col("part") % 4, F.col("line") * 7 + F.col("supp") % 3
    left = rows.select("doc", F.col("line").alias("id"), a.alias("start"), (a + 3 + F.col("supp") % 5).alias("end"))
    return left, rows.select("doc", F.col("line").alias("id"), b.alias("start"), (b + 2 + F.col("part") % 4).alias("end"))


@query(f"WITH RECURSIVE {MATCHING} SELECT * FROM matched")
def span_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matched_spans(*spans(spark, sf_dir), ["doc"])


@query(f"WITH RECURSIVE {MATCHING} SELECT a.doc, a.id AS a, m.b FROM a LEFT JOIN matched m ON m.doc = a.doc AND m.a = a.id")
def span_matching_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the spans of the first side that nothing is assigned to."""
    return matching.matched_spans(*spans(spark, sf_dir), ["doc"], keep_a=True)


@query("""
WITH RECURSIVE texts AS (SELECT p_partkey, replace(p_name, ' ', '') AS original, '"' || replace(p_name, ' ', ' , ') || '.' AS longer FROM part),
walk AS (
  SELECT p_partkey, CAST(0 AS INTEGER) AS place, CAST(0 AS INTEGER) AS used, CAST(NULL AS INTEGER) AS aligned FROM texts
  UNION ALL
  SELECT w.p_partkey, w.place + 1, CASE WHEN w.used < length(original) AND substr(longer, w.place + 1, 1) = substr(original, w.used + 1, 1) THEN w.used + 1 ELSE w.used END,
    CASE WHEN w.used < length(original) AND substr(longer, w.place + 1, 1) = substr(original, w.used + 1, 1) THEN w.used END
  FROM walk w JOIN texts USING (p_partkey) WHERE w.place < length(longer)
)
SELECT p_partkey, place - 1 AS place, aligned FROM walk WHERE place > 0
""")
def character_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without spaces against names with marks put in."""
    longer = F.concat(F.lit('"'), F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit("."))
    rows = table(spark, sf_dir, "part").select("p_partkey", matching.aligned(F.replace("p_name", F.lit(" "), F.lit("")), longer).alias("places"))
    return rows.select("p_partkey", F.posexplode("places").alias("place", "aligned"))


@query(f"""
WITH {LINES}, mentions AS (SELECT doc, line AS m_id, flag = 'R' AS is_event FROM lines),
relations AS (SELECT doc, line AS source, part AS r_id, CASE WHEN supp % 2 = 0 THEN 'INTRA_DOC_COREF' ELSE 'CROSS_DOC_COREF' END AS tag, 100 + line AS target FROM lines WHERE line IN (2, 3)),
targets AS (SELECT doc, 100 + line AS m_id, 'ACT' || part AS instance, 'part ' || part AS descriptor FROM lines WHERE line = 2),
alone AS (SELECT *, row_number() OVER (PARTITION BY is_event ORDER BY doc, m_id) - 1 AS k FROM mentions m WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.doc = m.doc AND r.source = m.m_id))
SELECT m.doc, m.m_id, is_event, CASE WHEN starts_with(tag, 'INTRA') THEN CAST(r_id || CASE WHEN is_event THEN '1' ELSE '0' END AS BIGINT) ELSE CAST(substr(instance, 4) AS BIGINT) END AS cluster_id, coalesce(descriptor, '') AS cluster_desc
FROM mentions m JOIN relations r ON r.doc = m.doc AND r.source = m.m_id LEFT JOIN targets t ON t.doc = m.doc AND t.m_id = r.target
UNION ALL SELECT doc, m_id, is_event, k + CASE WHEN is_event THEN 100000000 ELSE 200000000 END, '' FROM alone
""")
def ecb_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    mentions = rows.select("doc", F.col("line").alias("m_id"), (F.col("flag") == "R").alias("is_event"))
    related = rows.where("line IN (2, 3)")
    tag = F.when(F.col("supp") % 2 == 0, "INTRA_DOC_COREF").otherwise("CROSS_DOC_COREF")
    relations = related.select("doc", F.col("line").alias("source"), F.col("part").alias("r_id"), tag.alias("tag"), (F.col("line") + 100).alias("target"))
    part = F.col("part").cast("string")
    targets = related.where("line = 2").select("doc", (F.col("line") + 100).alias("m_id"), F.concat(F.lit("ACT"), part).alias("instance"), F.concat(F.lit("part "), part).alias("descriptor"))
    return ecb.with_clusters(mentions, relations, targets)


@query(f"WITH {LINES} SELECT doc, line, part FROM lines JOIN (SELECT DISTINCT o_orderkey AS doc, o_custkey % 7 + 1 AS line FROM orders) USING (doc, line)")
def listed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 7 + 1).alias("line"))
    return ecb.of_listed_sentences(lines(spark, sf_dir), listed, "doc", "line").select("doc", "line", "part")


# One word after the other: a new segment begins where the sentence doesn't fit whole any more, unless it
# began the segment; then where the word doesn't fit.
@query(f"""
WITH RECURSIVE {TOKENS}, words AS (
  SELECT doc_id, sentence_idx, token_idx, 1 + length(token) // 4 AS n, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_idx, token_idx) AS k,
    sum(1 + length(token) // 4) OVER (PARTITION BY doc_id ORDER BY sentence_idx, token_idx) AS upto FROM tokens),
sizes AS (SELECT *, upto - n AS before, first_value(k) OVER (PARTITION BY doc_id, sentence_idx ORDER BY token_idx) AS opens FROM words),
starts AS (
  SELECT doc_id, CAST(1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS segment FROM (SELECT DISTINCT doc_id FROM words)
  UNION ALL
  SELECT s.doc_id, CASE WHEN min_by(w.opens, w.k) > any_value(s.k) THEN min_by(w.opens, w.k) ELSE greatest(min(w.k), any_value(s.k) + 1) END, any_value(s.segment) + 1
  FROM starts s JOIN sizes f ON f.doc_id = s.doc_id AND f.k = s.k JOIN sizes w ON w.doc_id = s.doc_id AND w.k >= s.k AND w.upto > f.before + 62 GROUP BY s.doc_id
)
SELECT w.doc_id, sentence_idx, token_idx, max(segment) AS segment FROM sizes w JOIN starts s ON s.doc_id = w.doc_id AND s.k <= w.k GROUP BY ALL
""")
def segments_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of at most 62 word pieces, a piece for every four characters of a token."""
    words = document_tokens(spark, sf_dir).withColumn("n", 1 + F.floor(F.length("token") / 4))
    return sentences.segmented_words(words, "doc_id", "sentence_idx", "token_idx", "n", 64)


@query("""
WITH edges AS (SELECT l_partkey AS dst, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey)
SELECT dst, CAST(sum(n) OVER (ORDER BY dst) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY dst) AS BIGINT) AS "end" FROM edges
""")
def hyperedge_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return coref.hyperedge_offsets(links, "src", "dst")


@query(f"""
WITH {LINES}, tokens AS (SELECT doc || '_' || CASE WHEN doc % 2 = 0 THEN 'ecbplus' ELSE 'ecb' END AS doc_id, doc, line, flag FROM lines)
SELECT doc_id, line AS token_id, CAST(doc AS VARCHAR) AS topic, doc || CASE WHEN doc % 2 = 0 THEN '_1' ELSE '_0' END AS subtopic, doc_id AS gold_subtopic, CASE WHEN line % 3 = 0 THEN '(' || line || ')' ELSE '-' END AS coref
FROM tokens WHERE flag <> 'N'
""")
def conll_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated tokens with their topics and mentions of one token each."""
    doc_id = F.concat(F.col("doc").cast("string"), F.when(F.col("doc") % 2 == 0, "_ecbplus").otherwise("_ecb"))
    tokens = lines(spark, sf_dir).select(doc_id.alias("doc_id"), F.col("line").alias("token_id"), (F.col("flag") != "N").alias("is_validated"))
    mentions = tokens.where("token_id % 3 = 0").select("doc_id", F.col("token_id").alias("start"), F.col("token_id").alias("end"), F.col("token_id").alias("cluster"))
    rows = coref.conll_rows(tokens, mentions, "doc_id", "token_id", "is_validated").withColumn("gold_subtopic", text.gold_subtopic(F.col("doc_id")))
    return rows.select("doc_id", "token_id", "topic", "subtopic", "gold_subtopic", "coref")


@query("""
WITH scores AS (SELECT l_linestatus AS corpus, l_returnflag AS topics, l_discount AS value FROM lineitem),
every AS (SELECT * FROM scores UNION ALL SELECT corpus, 'closure', value FROM scores WHERE corpus = 'F' AND topics = 'A')
SELECT corpus, topics, printf('%.2f', round(avg(value) * 100, 2)) || '+-' || printf('%.2f', round(coalesce(stddev_samp(value), 0) * 100, 2)) AS shown FROM every GROUP BY corpus, topics
""")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations of all scores in per cent, with one corpus's rows repeated under another name."""
    scores = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("corpus"), F.col("l_returnflag").alias("topics"), F.col("l_discount").alias("value"))
    every = metrics.with_copies(scores, (F.col("corpus") == "F") & (F.col("topics") == "A"), "topics", "closure")
    stats = every.groupBy("corpus", "topics").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("d"))
    return stats.select("corpus", "topics", text.with_deviation(F.col("m") * 100, F.col("d") * 100, 2).alias("shown"))


@query("""
SELECT o_orderkey, substr(md5('{"k":"customer","v":"' || o_custkey || '","n":false}' || chr(10) || '{"k":"status","v":"' || CASE WHEN o_orderkey % 3 = 0 THEN '","n":true}' ELSE o_orderstatus || '","n":false}' END), 1, 8) AS hash FROM orders
""")
def settings_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of settings; their keys come in two orders."""
    status, customer = (F.lit("status"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))), (F.lit("customer"), F.col("o_custkey").cast("string"))
    settings = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(*status, *customer)).otherwise(F.create_map(*customer, *status))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.map_hash(settings).alias("hash"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + 12 * 3600 + CASE WHEN o_orderkey % 3 = 0 THEN -7200 ELSE 5 * 3600 END END AS seconds FROM orders")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noon of each order's day as ISO 8601 two hours east, as in mail headers five hours west, or unreadable."""
    day = lambda pattern: F.date_format("o_orderdate", pattern)
    kind = F.col("o_orderkey") % 3
    written = F.when(kind == 0, F.concat(day("yyyy-MM-dd"), F.lit("T12:00:00+02:00"))).when(kind == 1, F.concat(day("E, d MMM yyyy"), F.lit(" 12:00:00 -0500"))).otherwise("some day")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(text.moment(written)).alias("seconds"))


@query("""
WITH words AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2 AND w NOT IN (STOPS)) AS w FROM documents),
grams AS (SELECT doc_id, gram, count(*) AS tf FROM (SELECT doc_id, unnest(list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2])) AS gram FROM words WHERE len(w) >= 2) GROUP BY doc_id, gram),
model AS (SELECT gram, count(*) AS df, ln((1.0 + (SELECT count(*) FROM documents WHERE doc_id % 2 = 0)) / (1 + count(*))) + 1 AS idf FROM grams WHERE doc_id % 2 = 0 GROUP BY gram)
SELECT doc_id, gram, df, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)), 6) AS weight FROM grams JOIN model USING (gram) WHERE doc_id % 2 = 1
""".replace("STOPS", ", ".join(f"'{w}'" for w in dedup.STOP_WORDS)))
def tfidf_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of odd ids weighted by a model of those with even ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = docs.where("doc_id % 2 = 0")
    model = dedup.fitted(dedup.word_grams(known, "doc_id", "text", 2), known.count())
    rows = dedup.transformed(dedup.word_grams(docs.where("doc_id % 2 = 1"), "doc_id", "text", 2), model, "doc_id")
    return rows.select("doc_id", "gram", "df", F.round("weight", 6).alias("weight"))


SPAN = """
tokens AS (SELECT vec_id // 6 AS span, vec_id, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 7 <> 3),
scored AS (SELECT *, 1.5 * greatest(2 * v[1] - v[2] + 0.1, 0) - 0.5 * greatest(v[3] + 3 * v[4], 0) + 0.2 AS s FROM tokens)"""
HIDDEN = [([2.0, -1.0, 0.0, 0.0], 0.1), ([0.0, 0.0, 1.0, 3.0], 0.0)]
OUT = ([1.5, -0.5], 0.2)
WIDTHS = [[float(w), float(w * w)] for w in range(vectors.WIDEST + 1)]


def span_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """span, v: the first four dimensions of vectors that follow each other, as a span's tokens."""
    v = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 7 != 3").groupBy(F.expr("vec_id div 6").alias("span"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("vec_id", v.alias("v")))).alias("t")).select("span", F.col("t.v").alias("v"))


@query(f"""
WITH {SPAN}, weighted AS (SELECT *, exp(s - max(s) OVER (PARTITION BY span)) / sum(exp(s)) OVER (PARTITION BY span) * exp(max(s) OVER (PARTITION BY span)) AS p FROM scored),
whole AS (
  SELECT span, arg_min(v, vec_id) AS f, arg_max(v, vec_id) AS l, [sum(p * v[1]), sum(p * v[2]), sum(p * v[3]), sum(p * v[4])] AS m, least(count(*) - 1, 4) AS w
  FROM weighted GROUP BY span
)
SELECT span, k - 1 AS dim, round((f || l || m || [CAST(w AS DOUBLE), CAST(w * w AS DOUBLE)])[k], 6) AS x FROM whole, (SELECT unnest(range(1, 15)) AS k)
""")
def span_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, end, attention-weighted sum and width row of each span, one row a dimension."""
    rows = span_tokens(spark, sf_dir).withColumn("p", vectors.attention(F.col("v"), HIDDEN, OUT))
    full = vectors.span_vectors(rows, "v", "p", WIDTHS, 4)
    return full.select("span", F.posexplode("embedding").alias("dim", "x")).select("span", "dim", F.round("x", 6).alias("x"))


@query(f"""
WITH {SPAN}, spans AS (SELECT span, list(v[1] ORDER BY vec_id) AS v FROM tokens GROUP BY span)
SELECT span, k - 1 AS place, CASE WHEN k <= len(v) THEN v[k] ELSE 0 END AS x, CAST(k <= len(v) AS INTEGER) AS mask FROM spans, (SELECT unnest(range(1, 6)) AS k)
""")
def padded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = span_tokens(spark, sf_dir).withColumn("v", F.transform("v", lambda v: F.get(v, F.lit(0))))
    pieces, mask = vectors.padded(F.col("v"), 5, F.lit(0.0))
    return firsts.select("span", F.posexplode(F.arrays_zip(pieces.alias("x"), mask.alias("mask"))).alias("place", "p")).select("span", "place", "p.x", "p.mask")


@query("""
WITH pairs AS (SELECT o_custkey % 30 AS a, o_orderkey % 20 AS b, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders)
SELECT DISTINCT place // 64 AS batch, segment FROM (SELECT place, unnest([a, b]) AS segment FROM pairs)
""")
def batch_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sampling.placed(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 30).alias("a"), (F.col("o_orderkey") % 20).alias("b")), "o_orderkey")
    return vectors.batch_segments(pairs, "place", 64, ["a", "b"])


# Four tokens a mention and three shapes of parse; the oracle names what each shape leaves.
PARSED = f"""
{LINES}, shapes AS (SELECT doc, line, part % 3 AS shape, list_transform(range(4), lambda i: 'w' || chr(CAST(97 + (part + i) % 26 AS INTEGER))) AS w FROM lines),
least_spans AS (
  SELECT doc, line, CASE shape WHEN 2 THEN 'VP' ELSE 'NP' END AS root,
    CASE shape WHEN 0 THEN [w[1] || ' ' || w[2] || '@' || (line * 4 + 1)] WHEN 1 THEN [array_to_string(w, ' ') || '@' || (line * 4 + 3)] ELSE [w[1] || '@' || (line * 4 + 1), w[4] || '@' || (line * 4 + 3)] END AS spans
  FROM shapes
)"""
SHAPES = [["(NP(NP*", "*)", "(PP*", "(NP*)))"], ["(NP*", "*", "*", "*)"], ["(VP*", "(NP*", "*)", "*)"]]


def parsed_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    bits = F.array(*[F.array(*map(F.lit, shape)) for shape in SHAPES])
    tokens = rows.select("doc", "line", "part", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select(
        "doc", (F.col("line") * 4 + F.col("i")).alias("token"), F.concat(F.lit("w"), F.char(97 + (F.col("part") + F.col("i")) % 26)).alias("word"),
        F.when(F.col("i") == 2, "IN").otherwise("NN").alias("pos"), F.get(F.get(bits, (F.col("part") % 3).cast("int")), F.col("i")).alias("parse"),
    )
    mentions = rows.select("doc", "line", (F.col("line") * 4).alias("start"), (F.col("line") * 4 + 3).alias("end"))
    return parses.with_minimum_spans(mentions, tokens, "doc", "token", "line")


@query(f"WITH {PARSED} SELECT doc, line, root, array_to_string(spans, ';') AS spans FROM least_spans")
def minimum_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.transform("spans", lambda s: F.concat(s["words"], F.lit("@"), s["at"].cast("string")))
    return parsed_mentions(spark, sf_dir).select("doc", "line", "root", F.array_join(shown, ";").alias("spans"))


@query(f"WITH {PARSED}, chains AS (SELECT *, line % 2 AS chain FROM least_spans) SELECT doc, chain, line FROM chains c WHERE root = 'NP' AND (NOT EXISTS (SELECT 1 FROM chains v WHERE v.doc = c.doc AND v.chain = c.chain AND v.root = 'VP') OR (SELECT count(*) FROM chains n WHERE n.doc = c.doc AND n.chain = c.chain AND n.root = 'NP') > 1)")
def verb_phrases_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed_mentions(spark, sf_dir).withColumn("chain", F.col("line") % 2)
    return parses.without_verb_phrases(rows, ["doc", "chain"]).select("doc", "chain", "line")
