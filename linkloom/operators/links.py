"""Hyperlink operators: extraction by pattern, validity, URL, anchor and degree filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import text, urls
from linkloom.operators.sampling import running_sum

ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'


def extract_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per plain anchor in the markup, with its target as an absolute URL.

    A pattern scan of whole pages, without shuffle; `linkloom.sources.html` has the structural parse."""
    hrefs, anchors = (F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(i)) for i in (1, 2))
    rows = pages.select(key, url, F.posexplode(F.arrays_zip(hrefs.alias("href"), anchors.alias("anchor"))).alias("pos", "a"))
    rows = rows.withColumn("link_idx", F.col("pos").cast("long"))
    to_url = urls.resolved(F.col(url), F.col("a.href"))
    return rows.select(
        key, url, "link_idx", F.col("a.href").alias("href"), F.col("a.anchor").alias("anchor"), to_url.alias("to_url"),
        urls.normalized(F.col(url)).alias("url_normalized"), urls.normalized(to_url).alias("to_url_normalized"),
    )


def is_valid(to_url: Column, source: Column, target: Column) -> Column:
    """The target has scheme and host and is another page than the source."""
    return (urls.scheme(to_url) != "") & (urls.netloc(to_url) != "") & (source != target)


def netloc_filter(to_url: Column, target: Column, netloc_blacklist: Sequence[str] = (), prefix_blacklist: Sequence[str] = (), netloc_whitelist: Sequence[str] = ()) -> Column:
    """Whether a link stays: a whitelist of host suffixes overrides both blacklists; other schemes than
    http and https, and hosts with ``@``, always go."""
    host = urls.netloc(to_url)
    ends = lambda suffixes: text.any_of([F.endswith(host, F.lit(s)) for s in suffixes])
    drop = ~ends(netloc_whitelist) if netloc_whitelist else ends(netloc_blacklist) | text.any_of([F.startswith(target, F.lit(p)) for p in prefix_blacklist])
    return ~(drop | ~urls.scheme(to_url).isin("http", "https") | F.contains(host, F.lit("@")))


def url_part_filter(target: Column, suffixes: Sequence[str] = (), substrings: Sequence[str] = ()) -> Column:
    """Whether a link stays; entries are literal, even those that look like patterns."""
    return ~(text.any_of([F.endswith(target, F.lit(s)) for s in suffixes]) | text.any_of([F.contains(target, F.lit(s)) for s in substrings]))


def without_page_repeats(links: DataFrame, page: str, anchor: str) -> DataFrame:
    """Drops every link whose anchor text occurs more than once on its page, and blank anchors."""
    repeated = links.groupBy(page, anchor).agg(F.count("*").alias("__n")).where("__n > 1").select(page, anchor)
    return links.where(text.stripped(F.col(anchor)) != "").join(repeated, [page, anchor], "left_anti").select(*links.columns)


def without_frequent_pairs(links: DataFrame, anchor: str, target: str, limit: int = 7) -> DataFrame:
    """Drops all links of an anchor and target pair that occurs limit times or more (twice at least).

    Frequent pairs are counted first (pre-aggregated) and anti-joined, so no pair is gathered anywhere."""
    frequent = links.groupBy(anchor, target).count().where(F.col("count") >= max(2, limit)).select(anchor, target)
    return links.join(frequent, [anchor, target], "left_anti")


def degrees(edges: DataFrame, src: str, dst: str, distinct: bool = False) -> DataFrame:
    """node, in_degree, out_degree of every node of an edge; parallel edges count unless distinct."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    if distinct:
        e = e.distinct()
    ends = e.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def degree_histogram(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """direction, degree, n_pages over distinct edges, degree 0 included."""
    d = degrees(edges, src, dst, distinct=True)
    both = d.select(F.inline(F.array(F.struct(F.lit("in").alias("direction"), F.col("in_degree").alias("degree")), F.struct(F.lit("out").alias("direction"), F.col("out_degree").alias("degree")))))
    return both.groupBy("direction", "degree").agg(F.count("*").alias("n_pages"))


def degree_cutoffs(edges: DataFrame, src: str, dst: str, in_share: float, out_share: float) -> DataFrame:
    """direction, cutoff: the largest degree up to which less than the share of all pages lies.

    A share of 1 means no cutoff, as does a smallest degree that already holds the share."""
    h = degree_histogram(edges, src, dst)
    run = F.sum("n_pages").over(Window.partitionBy("direction").orderBy("degree").rowsBetween(Window.unboundedPreceding, 0))
    share = run / F.sum("n_pages").over(Window.partitionBy("direction"))
    wanted = F.when(F.col("direction") == "in", in_share).otherwise(out_share)
    return h.withColumn("share", share).where((F.col("share") < wanted) & (wanted < 1.0)).groupBy("direction").agg(F.max("degree").alias("cutoff"))


def without_high_degrees(edges: DataFrame, src: str, dst: str, in_share: float = 0.9995, out_share: float = 0.9999) -> DataFrame:
    """Drops edges to pages of high in-degree and from pages of high out-degree."""
    d = degrees(edges, src, dst, distinct=True)
    cuts = degree_cutoffs(edges, src, dst, in_share, out_share)
    high_in = d.join(F.broadcast(cuts.where("direction = 'in'")), F.col("in_degree") > F.col("cutoff")).select(F.col("node").alias(dst))
    high_out = d.join(F.broadcast(cuts.where("direction = 'out'")), F.col("out_degree") > F.col("cutoff")).select(F.col("node").alias(src))
    return edges.join(high_in, dst, "left_anti").join(high_out, src, "left_anti")


def tail_pages(links: DataFrame, pages: DataFrame, src: str, dst: str, key: str) -> DataFrame:
    """key of the scraped pages that links lead to but that have none themselves."""
    targets = links.select(F.col(dst).alias(key)).distinct()
    return targets.join(links.select(F.col(src).alias(key)), key, "left_anti").join(pages.select(key), key, "left_semi")


def prefix_counts(generalized: DataFrame, column: str) -> DataFrame:
    """prefix, depth, n (URLs below or at it), n_own (URLs that are exactly it) of generalized URLs."""
    parts = F.split(column, "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("prefix"), i.alias("depth"), (i == F.size(parts)).cast("long").alias("own")))
    counted = generalized.groupBy(column).agg(F.count("*").alias("__n"))
    rows = counted.select("__n", F.inline(steps))
    return rows.groupBy("prefix", "depth").agg(F.sum("__n").alias("n"), F.sum(F.col("__n") * F.col("own")).alias("n_own"))


def selected_prefixes(generalized: DataFrame, column: str, mass: float = 0.9) -> DataFrame:
    """prefix, n, cum of the URL patterns that together come nearest to ``mass`` of all URLs.

    The deepest prefix that holds the mass is opened: its children and its own exact URLs, most
    frequent first (ties by prefix), up to the one whose running sum is nearest. Counts are compared,
    never float shares. Totals are one row; children are ranked in range partitions, not in one task."""
    counts = prefix_counts(generalized, column)
    # The root above all first parts is a prefix too: the empty one, at depth 0.
    total = generalized.agg(F.count("*").alias("total"))
    root = total.select(F.lit("").alias("prefix"), F.lit(0).alias("depth"), F.col("total").alias("n"), F.lit(0).cast("long").alias("n_own")).where("n > 0")
    heavy = counts.unionByName(root).crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("total") * mass)
    top = heavy.agg(F.max_by(F.struct("prefix", "depth", "n_own", "total"), F.struct("depth", "n")).alias("t")).select("t.*").where("prefix IS NOT NULL")
    top = F.broadcast(top.select(F.col("prefix").alias("top"), F.col("depth").alias("top_depth"), F.col("n_own").alias("top_own"), "total"))
    children = counts.join(top, (F.col("depth") == F.col("top_depth") + 1) & ((F.col("top") == "") | F.startswith("prefix", F.concat("top", F.lit("/"))))).select("prefix", "n", "total")
    own = top.where("top_own > 0").select(F.col("top").alias("prefix"), F.col("top_own").alias("n"), "total")
    ranked = running_sum(children.unionByName(own).withColumn("__first", -F.col("n")), "n", "__first", "prefix").withColumn("cum", F.col("before") + F.col("n"))
    stop = ranked.agg(F.min_by("cum", F.struct(F.abs(F.col("cum") - F.col("total") * mass), "cum")).alias("stop"))
    return ranked.join(F.broadcast(stop), F.col("cum") <= F.col("stop")).select("prefix", "n", "cum")


def with_selected_prefix(links: DataFrame, column: str, prefixes: DataFrame) -> DataFrame:
    """Links whose generalized URL starts with a selected prefix, as strings.

    Each different URL is cut to the lengths that prefixes have (one row, no more numbers than a URL has
    characters), so that any number of prefixes meets any number of URLs by an equi-join."""
    lengths = prefixes.agg(F.collect_set(F.length("prefix")).alias("__lengths"))
    urls = links.select(F.col(column).alias("__url")).distinct().crossJoin(F.broadcast(lengths))
    cut = urls.select("__url", F.explode(F.filter("__lengths", lambda n: n <= F.length("__url"))).alias("__n")).withColumn("prefix", F.left("__url", F.col("__n")))
    found = cut.join(prefixes.select("prefix"), "prefix", "left_semi").select(F.col("__url").alias(column)).distinct()
    return links.join(found, column, "left_semi")
