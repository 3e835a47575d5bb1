"""Queries over pages, links and link graphs.

The generator's pages hold plain anchors only, and no link graph with fan-in; ``lineitem`` with
orders as sources and parts as targets stands in for one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text, urls
from linkloom.operators import links, pages, subgraphs
from linkloom.operators.materialize import checkpoint_dir, file_system
from linkloom.plans.registry import query, table
from linkloom.sources import tables

# The same URL rules in the oracle's dialect.
PARTS = r"""
  lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme,
  regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1) AS netloc,
  regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path
"""
NORMALIZED = r"regexp_replace(netloc, '^www[^.]*\.', '') || path"
LINKS = rf"""
split AS (SELECT page_id, url, html, {PARTS} FROM pages),
raw AS (
  SELECT page_id, url, scheme, netloc, path, unnest(range(len(regexp_extract_all(html, '{links.ANCHOR}')))) AS link_idx,
    unnest(regexp_extract_all(html, '{links.ANCHOR}', 1)) AS href, unnest(regexp_extract_all(html, '{links.ANCHOR}', 2)) AS anchor
  FROM split
), resolved AS (
  SELECT page_id, url AS page_url, {NORMALIZED} AS url_normalized, link_idx, href, anchor,
    CASE WHEN trim(href) = '' THEN NULL WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN scheme || ':' || href
      WHEN starts_with(href, '/') THEN scheme || '://' || netloc || href WHEN starts_with(href, '?') THEN scheme || '://' || netloc || path || href
      WHEN starts_with(href, '#') THEN regexp_replace(url, '#.*$', '') || href
      ELSE scheme || '://' || netloc || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END AS url
  FROM raw
), links AS (
  SELECT page_id, page_url, link_idx, href, anchor, url AS to_url, url_normalized, scheme, netloc, {NORMALIZED} AS to_url_normalized
  FROM (SELECT *, {PARTS} FROM resolved)
)"""
GRAPH = "edges AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)"


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.extract_links(table(spark, sf_dir, "pages"))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


@query(rf"""
WITH {LINKS}, keyed AS (SELECT page_id, length(html) AS content_chars, {NORMALIZED} AS url_normalized FROM split WHERE netloc <> ''),
best AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY url_normalized ORDER BY content_chars DESC, page_id) = 1),
received AS (SELECT to_url_normalized AS url_normalized, count(*) AS n FROM links WHERE scheme <> '' AND netloc <> '' AND url_normalized <> to_url_normalized GROUP BY ALL),
sent AS (SELECT url_normalized, count(*) AS n FROM links WHERE scheme <> '' AND netloc <> '' AND url_normalized <> to_url_normalized GROUP BY ALL)
SELECT page_id, url_normalized, content_chars, coalesce(received.n, 0) AS in_degree, coalesce(sent.n, 0) AS out_degree
FROM best LEFT JOIN received USING (url_normalized) LEFT JOIN sent USING (url_normalized)
""")
def page_rank_by_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page index end to end: keys, longest capture of each page, and its degrees."""
    index = pages.with_normalized(table(spark, sf_dir, "pages").withColumn("content_chars", F.length("html").cast("long")))
    best = pages.longest_pages(index.select("page_id", "url_normalized", "content_chars"), "url_normalized", "content_chars", "page_id")
    valid = page_links(spark, sf_dir).where(links.is_valid(F.col("to_url"), F.col("url_normalized"), F.col("to_url_normalized")))
    degree = links.degrees(valid, "url_normalized", "to_url_normalized").withColumnRenamed("node", "url_normalized")
    return best.join(degree, "url_normalized", "left").select("page_id", "url_normalized", "content_chars", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"))


@query(rf"SELECT page_id, {PARTS}, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(url, '^[^#]*#(.*)', 1) AS fragment FROM pages")
def url_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.scheme(u).alias("scheme"), urls.netloc(u).alias("netloc"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.fragment(u).alias("fragment"))


@query(rf"SELECT page_id, {NORMALIZED} AS url_normalized FROM (SELECT page_id, {PARTS} FROM pages)")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalized(F.col("url")).alias("url_normalized"))


@query(rf"""
SELECT page_id, scheme || '://' || CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END
  || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(url, '^[^?#]*([?#].*)$', 1) AS canonical_url
FROM (SELECT page_id, url, {PARTS}, regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), ':$', '') AS host FROM pages)
""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical_url"))


def settled_sql(part: str) -> str:
    """SQL for percent-encoding that is settled."""
    return rf"""array_to_string(list_transform(regexp_extract_all({part}, '(?s)%[0-9A-Fa-f]{{2}}|.'), lambda x: CASE WHEN length(x) = 3
    THEN CASE WHEN regexp_matches(upper(x), '{urls.NEEDLESS}') THEN chr(CAST('0x' || substr(x, 2) AS INTEGER)) ELSE upper(x) END
    WHEN regexp_matches(x, '{urls.PLAIN.replace("'", "''")}') THEN x ELSE url_encode(x) END), '')"""


@query(rf"""
WITH {LINKS}, canonical AS (
  SELECT page_id, link_idx, scheme, CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END AS host,
    CASE WHEN way = '' THEN '/' ELSE way END AS path, regexp_extract(to_url, '^[^?#]*\?([^#]*)', 1) AS asked, regexp_extract(to_url, '^[^#]*#(.*)', 1) AS frag, regexp_extract(to_url, '^[^?#]*([?#].*)$', 1) AS tail
  FROM (SELECT *, regexp_extract(to_url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS way, regexp_replace(lower(netloc), ':$', '') AS host FROM links WHERE netloc <> '' AND scheme <> '')
)
SELECT page_id, link_idx, scheme || '://' || host || {settled_sql("path")} || CASE WHEN starts_with(tail, '?') THEN '?' || {settled_sql("asked")} ELSE '' END || CASE WHEN contains(tail, '#') THEN '#' || {settled_sql("frag")} ELSE '' END AS url
FROM canonical
""")
def url_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets with settled percent-encoding."""
    found = page_links(spark, sf_dir).select("page_id", "link_idx", urls.normal_form(F.col("to_url")).alias("url"))
    return found.where("url IS NOT NULL")


GENERALIZED = r"""
generalized AS (
  SELECT page_id, array_to_string(list_concat(
    [labels[-1], coalesce(labels[-2], '')],
    CASE WHEN len(labels) > 2 THEN list_reverse(labels[1:len(labels) - 2]) ELSE ['S'] END,
    list_transform(list_filter(string_split(path, '/'), lambda p: p <> ''), lambda p: CASE WHEN regexp_matches(p, '^\p{Nd}+$') THEN '#' WHEN length(p) <= 10 THEN trim(lower(p)) ELSE 'A' END)
  ), '/') AS generalized_url
  FROM (SELECT page_id, path, string_split(netloc, '.') AS labels FROM (SELECT page_id, """ + PARTS + r""" FROM pages))
)"""


def generalized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.generalized(urls.netloc(u), urls.path(u)).alias("generalized_url"))


@query(f"WITH {GENERALIZED} SELECT * FROM generalized")
def url_generalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generalized_pages(spark, sf_dir)


@query(r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}.]', '_', 'g') AS filename FROM pages")
def url_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.filename_safe(F.col("url")).alias("filename"))


@query("""
SELECT user_id, event_type, event_id, ts AS first_ts FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
""")
def page_index_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captures: the oldest of each user and type."""
    first = pages.oldest_captures(table(spark, sf_dir, "events"), F.struct("user_id", "event_type"), "ts", "event_id")
    return first.select("user_id", "event_type", "event_id", F.col("ts").alias("first_ts"))


@query(rf"""
SELECT regexp_replace(netloc, '^www[^.]*\.', '') AS host, page_id, content_chars FROM (SELECT page_id, length(html) AS content_chars, {PARTS} FROM pages) WHERE netloc <> ''
QUALIFY row_number() OVER (PARTITION BY regexp_replace(netloc, '^www[^.]*\.', '') ORDER BY content_chars DESC, page_id) = 1
""")
def page_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest page of each host."""
    rows = table(spark, sf_dir, "pages").where(urls.netloc(F.col("url")) != "")
    rows = rows.select(urls.without_www(urls.netloc(F.col("url"))).alias("host"), "page_id", F.length("html").cast("long").alias("content_chars"))
    return pages.longest_pages(rows, "host", "content_chars", "page_id")


@query("SELECT page_id, url FROM pages WHERE NOT (starts_with(url, 'http://m.') OR starts_with(url, 'https://m.') OR starts_with(url, 'http://blog.'))")
def index_prefix_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.without_prefixes(table(spark, sf_dir, "pages").select("page_id", "url"), F.col("url"), ["http://m.", "https://m.", "http://blog."])


@query("SELECT page_id, url FROM pages WHERE NOT ((contains(url, '/de/') OR contains(url, '/fr/') OR contains(url, 'utm_')) AND NOT contains(url, 'example.org'))")
def index_substring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.substring_filter(table(spark, sf_dir, "pages").select("page_id", "url"), F.col("url"), ["/de/", "/fr/", "utm_"], ["example.org"])


@query("SELECT page_id, url FROM pages WHERE contains(url, 'example.org')")
def index_whitelist_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.substring_filter(table(spark, sf_dir, "pages").select("page_id", "url"), F.col("url"), whitelist=["example.org"])


@query("SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN 'https://' || substr(url, 8) ELSE url END AS filename FROM pages")
def warc_prefix_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.rewrite_prefix(F.col("url"), "http://", "https://").alias("filename"))


LINK_COLUMNS = ["page_id", "link_idx", "href", "anchor", "to_url", "url_normalized", "to_url_normalized"]
SELECT_LINKS = "SELECT page_id, link_idx, href, anchor, to_url, url_normalized, to_url_normalized FROM links"


@query(f"WITH {LINKS} {SELECT_LINKS}")
def links_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).select(*LINK_COLUMNS)


@query(f"WITH {LINKS} {SELECT_LINKS} WHERE scheme <> '' AND netloc <> '' AND url_normalized <> to_url_normalized")
def links_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).where(links.is_valid(F.col("to_url"), F.col("url_normalized"), F.col("to_url_normalized"))).select(*LINK_COLUMNS)


@query(f"WITH {LINKS} SELECT netloc, count(*) AS n FROM links GROUP BY netloc")
def link_netloc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).groupBy(urls.netloc(F.col("to_url")).alias("netloc")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "netloc")


@query(f"WITH {LINKS} {SELECT_LINKS} WHERE NOT (ends_with(netloc, 'example.net') OR starts_with(to_url_normalized, 'm.') OR scheme NOT IN ('http', 'https') OR contains(netloc, '@'))")
def link_scheme_netloc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = links.netloc_filter(F.col("to_url"), F.col("to_url_normalized"), ["example.net"], ["m."])
    return page_links(spark, sf_dir).where(keep).select(*LINK_COLUMNS)


@query(f"WITH {LINKS} {SELECT_LINKS} WHERE ends_with(netloc, 'example.org') AND scheme IN ('http', 'https') AND NOT contains(netloc, '@')")
def link_netloc_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = links.netloc_filter(F.col("to_url"), F.col("to_url_normalized"), ["example.org"], ["m."], ["example.org"])
    return page_links(spark, sf_dir).where(keep).select(*LINK_COLUMNS)


@query(f"WITH {LINKS} {SELECT_LINKS} WHERE NOT (ends_with(to_url_normalized, ',') OR ends_with(to_url_normalized, '.') OR contains(to_url_normalized, '/the') OR contains(to_url_normalized, '/Le'))")
def link_suffix_substring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = links.url_part_filter(F.col("to_url_normalized"), [",", "."], ["/the", "/Le"])
    return page_links(spark, sf_dir).where(keep).select(*LINK_COLUMNS)


HEADLINES = r"""
counted AS (
  SELECT *, len(regexp_extract_all(anchor, '[A-Z][\p{L}\p{N}_]+')) AS titled, len(regexp_extract_all(anchor, '[^\s]+')) AS words FROM titles
)"""


@query(rf"""
WITH titles AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS anchor FROM pages), {HEADLINES}
SELECT page_id, anchor, regexp_matches(anchor, '^\p{{Lu}}') AND words >= 7 AND titled > 3 AND titled / greatest(words, 1) > 0.6 AS is_headline FROM counted
""")
def anchor_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page titles as anchor texts."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("anchor"))
    return rows.withColumn("is_headline", text.is_headline(F.col("anchor")))


#: The kind of patterns that the anchor filter takes; they match at the start, ignoring case.
ANCHOR_PATTERNS = [r"the$", r"(and|or)$", r"le[s]?$", r".*,$"]


@query(f"WITH {LINKS} {SELECT_LINKS} WHERE NOT regexp_matches(anchor, '(?i)^(?:" + "|".join(f"(?:{p})" for p in ANCHOR_PATTERNS) + ")')")
def anchor_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).where(~text.starts_with_any(F.col("anchor"), ANCHOR_PATTERNS)).select(*LINK_COLUMNS)


@query(f"WITH {LINKS} {SELECT_LINKS} WHERE trim(anchor) <> '' QUALIFY count(*) OVER (PARTITION BY url_normalized, anchor) = 1")
def anchor_same_page_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.without_page_repeats(page_links(spark, sf_dir), "url_normalized", "anchor").select(*LINK_COLUMNS)


@query(f"WITH {LINKS} {SELECT_LINKS} QUALIFY count(*) OVER (PARTITION BY anchor, to_url_normalized) < 2")
def anchor_target_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.without_frequent_pairs(page_links(spark, sf_dir), "anchor", "to_url_normalized", 2).select(*LINK_COLUMNS)


@query(f"WITH {LINKS} SELECT anchor, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM links GROUP BY anchor")
def anchors_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).groupBy("anchor").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages")).orderBy("anchor")


@query("""
SELECT coalesce(node_in, node_out) AS node, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree
FROM (SELECT l_partkey AS node_in, count(*) AS i FROM lineitem GROUP BY 1) FULL JOIN (SELECT l_orderkey AS node_out, count(*) AS o FROM lineitem GROUP BY 1) ON node_in = node_out
""")
def degree_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = links.degrees(graph(spark, sf_dir), "src", "dst")
    return d.select("node", F.col("in_degree").cast("long").alias("in_degree"), F.col("out_degree").cast("long").alias("out_degree"))


DEGREES = f"""
{GRAPH}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
degree AS (
  SELECT node, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM nodes
  LEFT JOIN (SELECT dst AS node, count(*) AS i FROM edges GROUP BY 1) USING (node) LEFT JOIN (SELECT src AS node, count(*) AS o FROM edges GROUP BY 1) USING (node)
), histogram AS (
  SELECT 'in' AS direction, i AS degree, count(*) AS n_pages FROM degree GROUP BY i UNION ALL SELECT 'out', o, count(*) FROM degree GROUP BY o
)"""


@query(f"WITH {DEGREES} SELECT * FROM histogram")
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.degree_histogram(graph(spark, sf_dir), "src", "dst").select("direction", F.col("degree").cast("long").alias("degree"), "n_pages")


@query(f"""
WITH {DEGREES}, shares AS (
  SELECT direction, degree, sum(n_pages) OVER (PARTITION BY direction ORDER BY degree) / sum(n_pages) OVER (PARTITION BY direction) AS share FROM histogram
), cut AS (SELECT direction, max(degree) AS cutoff FROM shares WHERE share < CASE direction WHEN 'in' THEN 0.98 ELSE 0.95 END GROUP BY direction)
SELECT src, dst, count(*) AS n FROM (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem)
WHERE dst NOT IN (SELECT node FROM degree, cut WHERE direction = 'in' AND i > cutoff) AND src NOT IN (SELECT node FROM degree, cut WHERE direction = 'out' AND o > cutoff)
GROUP BY src, dst
""")
def degree_cutoff_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = links.without_high_degrees(graph(spark, sf_dir), "src", "dst", 0.98, 0.95)
    return kept.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {DEGREES} SELECT count(*) FILTER (i > 0 AND o = 0) AS n_head, count(*) FILTER (i = 0 AND o > 0) AS n_tail, count(*) FILTER (i > 0 AND o > 0) AS n_middle FROM degree")
def head_tail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, o = F.col("in_degree"), F.col("out_degree")
    return links.degrees(graph(spark, sf_dir), "src", "dst", distinct=True).agg(F.count_if((i > 0) & (o == 0)).alias("n_head"), F.count_if((i == 0) & (o > 0)).alias("n_tail"), F.count_if((i > 0) & (o > 0)).alias("n_middle"))


PREFIXES = f"""
{GENERALIZED}, steps AS (
  SELECT unnest(list_transform(range(1, len(string_split(generalized_url, '/')) + 1), lambda i: array_to_string(string_split(generalized_url, '/')[1:i], '/'))) AS prefix,
    unnest(range(1, len(string_split(generalized_url, '/')) + 1)) AS depth, len(string_split(generalized_url, '/')) AS deepest
  FROM generalized
), counts AS (SELECT prefix, depth, count(*) AS n, count(*) FILTER (depth = deepest) AS n_own FROM steps GROUP BY prefix, depth)"""


@query(f"WITH {PREFIXES} SELECT * FROM counts")
def trie_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.prefix_counts(generalized_pages(spark, sf_dir), "generalized_url").select("prefix", F.col("depth").cast("long").alias("depth"), "n", "n_own")


SELECTED = f"""
{PREFIXES}, total AS (SELECT count(*) AS total FROM generalized),
top AS (SELECT * FROM (SELECT * FROM counts UNION ALL SELECT '', 0, total, 0 FROM total), total WHERE n >= total * 0.55 ORDER BY depth DESC, n DESC LIMIT 1),
entries AS (
  SELECT c.prefix, c.n, total FROM counts c, top t WHERE c.depth = t.depth + 1 AND (t.prefix = '' OR starts_with(c.prefix, t.prefix || '/'))
  UNION ALL SELECT prefix, n_own, total FROM top WHERE n_own > 0
), running AS (SELECT prefix, n, total, sum(n) OVER (ORDER BY n DESC, prefix ROWS UNBOUNDED PRECEDING) AS cum FROM entries),
selected AS (SELECT prefix, n, CAST(cum AS BIGINT) AS cum FROM running WHERE cum <= (SELECT cum FROM running ORDER BY abs(cum - total * 0.55), cum LIMIT 1))"""


@query(f"WITH {SELECTED} SELECT * FROM selected")
def trie_selected_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.selected_prefixes(generalized_pages(spark, sf_dir), "generalized_url", 0.55)


@query(f"WITH {SELECTED} SELECT page_id, generalized_url FROM generalized WHERE EXISTS (SELECT 1 FROM selected WHERE starts_with(generalized_url, prefix))")
def trie_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generalized_pages(spark, sf_dir)
    return links.with_selected_prefix(rows, "generalized_url", links.selected_prefixes(rows, "generalized_url", 0.55))


@query(r"""
WITH bare AS (SELECT page_id, regexp_replace(lower(url), '#.*$', '') AS u FROM pages),
parts AS (SELECT page_id, regexp_extract(u, '://([^/?]*)', 1) AS host, regexp_extract(u, '://[^/?]*(.*)$', 1) AS rest FROM bare)
SELECT page_id, array_to_string(list_reverse(string_split(regexp_replace(host, '^www[0-9]*\.', ''), '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS key
FROM parts WHERE (host = 'example.net' OR ends_with(host, '.example.net')) AND page_id % 5 <> 0 AND page_id % 7 <> 0 AND page_id % 3 <> 0
""")
def capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures of several states, types and languages, stored in the order of their keys: the English
    pages of a host and its subdomains that were there."""
    of = lambda n, value, other: F.when(F.col("page_id") % n == 0, other).otherwise(value)
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds("page_id").alias("timestamp"), F.lit("warc/0").alias("filename"), of(5, 200, 404).alias("status"), of(7, "text/html", "image/png").alias("mime_detected"), of(3, "eng", "deu").alias("languages"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/captures-{uuid.uuid4().hex}"
    tables.write_index(captures, path)
    system, at = file_system(spark, path)
    system.deleteOnExit(at)
    return tables.query_index(spark.read.parquet(path), "*.example.net").select("page_id", "key")


@query(f"""
WITH {LINKS}, tos AS (SELECT to_url_normalized AS target, page_id, link_idx, href, anchor FROM links WHERE to_url_normalized IS NOT NULL AND to_url_normalized <> ''),
chosen AS (SELECT target FROM tos GROUP BY target HAVING count(*) BETWEEN 3 AND 5),
known AS (SELECT netloc_key AS target, min(page_id) AS page_id FROM (SELECT page_id, {NORMALIZED} AS netloc_key FROM split) GROUP BY netloc_key)
SELECT t.target, 'anchor-context' AS kind, page_id AS doc, CAST(link_idx AS BIGINT) AS place, anchor_text AS text
FROM (SELECT target, page_id, link_idx, coalesce(lag('[' || anchor || ']') OVER w || ' ', '') || '>>>[' || anchor || ']<<<' || coalesce(' ' || lead('[' || anchor || ']') OVER w, '') AS anchor_text
  FROM (SELECT to_url_normalized AS target, page_id, link_idx, anchor FROM links) WINDOW w AS (PARTITION BY page_id ORDER BY link_idx)) t JOIN chosen USING (target)
UNION ALL
SELECT target, 'target', page_id, -1, 'page ' || page_id FROM chosen JOIN known USING (target)
""")
def subgraph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of three to five links, with a text of their own where they are pages, and every link's context:
    the anchors beside it stand in for the sentences around it."""
    found = page_links(spark, sf_dir)
    sentences = found.select("page_id", F.col("link_idx").cast("long").alias("sentence_idx"), F.concat(F.lit("["), "anchor", F.lit("]")).alias("sentence"))
    spans = found.select("page_id", F.col("to_url_normalized").alias("target"), F.col("link_idx").cast("long").alias("sentence_idx"), F.lit(0).alias("chars_start"), (F.length("anchor") + 2).alias("chars_end")).where("target != ''")
    keyed = pages.with_normalized(table(spark, sf_dir, "pages")).groupBy(F.col("url_normalized").alias("target")).agg(F.min("page_id").alias("page_id"))
    texts = keyed.select("target", F.col("page_id").alias("doc"), F.concat(F.lit("page "), "page_id").alias("text"))
    return subgraphs.export(spans, sentences, texts, "page_id", "target", low=3, high=5)
