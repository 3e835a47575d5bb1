"""Readers and writers of the tables, corpora, configurations and score files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.operators.materialize import file_system

PAGE_INDEX = "url string, timestamp timestamp, filename string, offset bigint, length bigint"
SENTENCES = "url_normalized string, sentence_idx int, sentence string"
TOKENS = "url_normalized string, sentence_idx int, token_idx int, token string"
SCORES = "seed int, measure string, metric string, value double"
CORPUS_TOKEN = "array<struct<sent_id:int,token_id:int,token:string,is_validated:boolean>>"


def read_page_index(spark: SparkSession, path: str) -> DataFrame:
    """A CSV page index; timestamps are ``yyyyMMddHHmmss``, unreadable ones null."""
    raw = spark.read.schema(PAGE_INDEX.replace("timestamp timestamp", "timestamp string")).csv(path, header=True)
    return raw.withColumn("timestamp", capture_time(F.col("timestamp")))


def capture_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))


def render_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def search_key(url: Column) -> Column:
    """A URL's place in an index: its host's labels from last to first, joined by commas, ``)`` and the rest, all
    in lower case, without scheme, user, port, ``www`` and fragment. URLs below a prefix follow each other."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), r"^.*@", ""), r":[0-9]*$|\.$", "")
    labels = F.split(F.regexp_replace(host, r"^www[0-9]*\.(?=.)", ""), r"\.")
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(labels), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def write_index(captures: DataFrame, path: str) -> None:
    """A capture index as Parquet, range-partitioned and sorted by ``key`` (`search_key` of url) and time, so that
    the captures below a prefix lie in few files and row groups."""
    rows = captures.withColumn("key", search_key(F.col("url")))
    rows.repartitionByRange("key", "timestamp").sortWithinPartitions("key", "timestamp").write.mode("overwrite").parquet(path)


def below(spark: SparkSession, url: str, wildcard: bool) -> Column:
    """The condition on ``key`` for a URL, for all below it (wildcard), or for a host and all its subdomains
    (``*.host``). It is a range of keys, which reaches the scan: row groups outside it are skipped."""
    if url.startswith("*."):
        host = ",".join(reversed(url[2:].lower().split(".")))
        return (F.col("key") >= f"{host})") & (F.col("key") < f"{host}-")  # ")" ends a host, "," goes on with it
    prefix = url.rstrip("*")
    if wildcard and "/" not in prefix.split("://")[-1]:
        prefix += "/"
    key = spark.range(1).select(search_key(F.lit(prefix)).alias("k")).first().k
    # The first string that no longer starts with the key.
    end = key[:-1] + chr(ord(key[-1]) + 1)
    return (F.col("key") >= key) & (F.col("key") < end) if wildcard else F.col("key") == key


def query_index(index: DataFrame, url: str, wildcard: bool = True, start: Column | None = None, end: Column | None = None, status: int | None = 200, mime: str | None = "text/html", languages: str | None = "eng", limit: int | None = None) -> DataFrame:
    """Captures of a URL, or below it, between two times and of a status, detected type and languages (None: any;
    ``languages`` is the detected list, joined by commas); robots files are no pages. With a limit, the
    first ones by key and time."""
    asked = {"status": status, "mime_detected": mime, "languages": languages}
    rows = index.where(below(index.sparkSession, url, wildcard) & ~F.contains("filename", F.lit("robotstxt")))
    for column, value in asked.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if start is not None:
        rows = rows.where(F.col("timestamp") >= start)
    if end is not None:
        rows = rows.where(F.col("timestamp") <= end)
    return rows if limit is None else rows.orderBy("key", "timestamp", "filename", "offset").limit(limit)


def kept_query(spark: SparkSession, folder: str, query: Mapping, run: Callable[[], DataFrame]) -> DataFrame:
    """The result of a query, kept below the folder under a digest of what was asked (sorted JSON), and read from
    there when it is asked again. A run that was broken off is done again."""
    path = f"{folder.rstrip('/')}/{hashlib.sha256(json.dumps(query, sort_keys=True, default=str).encode()).hexdigest()[:32]}"
    system, at = file_system(spark, f"{path}/_SUCCESS")
    if not system.exists(at):
        run().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Snappy Parquet, in one folder per value of ``by`` if given (for splits)."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, sent_id, token_id, token, is_validated of a JSON object from document ids to token lists."""
    raw = spark.read.text(path, wholetext=True)
    docs = raw.select(F.explode(F.from_json("value", "map<string, array<array<string>>>")).alias("doc_id", "tokens"))
    t = docs.select("doc_id", F.explode("tokens").alias("t"))
    return t.select("doc_id", F.col("t")[0].cast("int").alias("sent_id"), F.col("t")[1].cast("int").alias("token_id"), F.col("t")[2].alias("token"), (F.lower(F.col("t")[3]) == "true").alias("is_validated"))


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """document, sentence, token_id (of the document, from 0), columns (array) of CoNLL text: documents between
    ``#begin document`` and ``#end document``, blank lines between sentences, other lines with ``#`` left out,
    as are lines outside documents.

    Lines are read in splits. A line's place in its split gives its numbers there; what it needs from
    before is composed from one row for each split: the sentences and tokens so far, the open document with
    the numbers at its start, and the kind of the last line. So a file, or a document, may have any size."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    starts = F.startswith("text", F.lit("#begin document"))
    kind = F.when(starts, "begin").when(F.startswith("text", F.lit("#end document")), "end").when(F.trim("text") == "", "blank").when(~F.startswith("text", F.lit("#")), "token")
    lines = lines.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("name", F.when(F.col("kind") == "begin", F.trim(F.expr("substr(text, 16)"))))
    split = Window.partitionBy("file", "block").orderBy("id")
    upto = split.rowsBetween(Window.unboundedPreceding, 0)
    token = F.col("kind") == "token"
    # The first line of a split opens a sentence, unless it turns out to go on with one.
    opens = token & (F.lag("kind").over(split).isNull() | (F.lag("kind").over(split) != "token"))
    rows = lines.withColumn("opens", opens.cast("long")).withColumns({"s": F.sum("opens").over(upto), "t": F.sum(token.cast("long")).over(upto), "first": F.first("kind").over(upto)})
    mark = F.when(F.col("kind").isin("begin", "end"), F.struct("id", "name", "s", "t"))
    ends = rows.groupBy("file", "block").agg(F.max("s").alias("all_s"), F.max("t").alias("all_t"), F.min_by("kind", "id").alias("head"), F.max_by("kind", "id").alias("tail"), F.max(mark).alias("mark"))
    # One row for each split of a file.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    goes_on = (F.col("head") == "token") & (F.last("tail").over(before) == "token")
    ends = ends.withColumn("less", F.coalesce(goes_on.cast("long"), F.lit(0)))
    ends = ends.withColumns({"ps": F.coalesce(F.sum(F.col("all_s") - F.col("less")).over(before), F.lit(0)), "pt": F.coalesce(F.sum("all_t").over(before), F.lit(0))})
    own = F.when(F.col("mark").isNotNull(), F.struct(F.col("mark.name").alias("name"), (F.col("ps") + F.col("mark.s") - F.col("less")).alias("s"), (F.col("pt") + F.col("mark.t")).alias("t")))
    ends = ends.withColumn("own", own).select("file", "block", "less", "ps", "pt", F.last("own", True).over(before).alias("open"))
    rows = rows.join(ends, ["file", "block"]).withColumns({"s": F.col("ps") + F.col("s") - F.col("less"), "t": F.col("pt") + F.col("t")})
    here = F.last(F.when(F.col("kind").isin("begin", "end"), F.struct("name", "s", "t")), True).over(upto)
    rows = rows.withColumn("of", F.coalesce(here, F.col("open"))).where(token & F.col("of.name").isNotNull())
    return rows.select(F.col("of.name").alias("document"), (F.col("s") - F.col("of.s") - 1).alias("sentence"), (F.col("t") - F.col("of.t") - 1).alias("token_id"), F.split("text", r"\t").alias("columns"))


def write_conll(tokens: DataFrame, path: str, name: str, order: list[str], columns: list[str], topic: str | None = None) -> None:
    """One document of all tokens, or one of each topic, as CoNLL text.

    Lines are range-partitioned and sorted, markers standing before and after a document's tokens, so
    nothing gathers. With a topic each document lies whole in one file; without, it is the files in the
    order of their names."""
    part = F.col(topic).cast("string") if topic else F.lit("")
    rows = tokens.select(part.alias("part"), F.lit(1).alias("kind"), *order, F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("line"))
    parts = rows.select("part").distinct() if topic else rows.sparkSession.createDataFrame([("",)], "part string")
    title = F.concat(F.lit(f"#begin document ({name}"), F.concat(F.lit("_"), F.col("part")) if topic else F.lit(""), F.lit("); part 000"))
    marks = [parts.select("part", F.lit(k).alias("kind"), line.alias("line")) for k, line in ((0, title), (2, F.lit("#end document")))]
    every = rows.unionByName(marks[0], True).unionByName(marks[1], True)
    keys = ["part", "kind", *order]
    every.repartitionByRange(*(keys[:1] if topic else keys)).sortWithinPartitions(*keys).select("line").write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str, *order: Column) -> None:
    """The column ``line`` as text in a global order: the files in the order of their names."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def write_report(counts: DataFrame, path: str, *columns: str) -> None:
    """Counted things as aligned text, most frequent first (column ``n``), ties by name."""
    line = F.concat_ws("  ", *[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 40, " ") for c in columns], F.lpad(F.col("n").cast("string"), 12, " "))
    write_lines(counts.withColumn("line", line), path, F.desc("n"), *map(F.col, columns))


def write_prefix_tree(counts: DataFrame, path: str) -> None:
    """A tree of prefixes as JSON lines, one node (prefix, its counts) a line; parents are prefixes of
    their children, so no task holds the tree."""
    counts.select(F.to_json(F.struct(*counts.columns)).alias("value")).write.mode("overwrite").text(path)


def write_each(texts: DataFrame, path: str, place: str, body: str) -> None:
    """One folder ``file=<six digits>_<hash>`` with one text file for each row, for reading a sample."""
    name = F.concat(F.lpad(F.col(place).cast("string"), 6, "0"), F.lit("_"), F.substring(F.md5(body), 1, 8))
    texts.select(name.alias("file"), F.col(body).alias("value")).write.mode("overwrite").partitionBy("file").option("lineSep", "\n").text(path)


def write_score_tables(scores: DataFrame, path: str, name: str, columns: list[str]) -> None:
    """Scores as CSV below ``csv`` and as lines of a LaTeX table below ``latex``, ordered by name."""
    write_csv(scores, f"{path}/csv")
    cells = F.concat_ws(" & ", *[F.coalesce(F.col(c).cast("string"), F.lit("--")) for c in (name, *columns)])
    write_lines(scores.withColumn("line", F.concat(cells, F.lit(r" \\"))), f"{path}/latex", F.col(name))


def read_validated_sentences(spark: SparkSession, path: str) -> DataFrame:
    """doc, sent_id of a CSV of topic, file and sentence number; documents are named ``topic_file.xml``."""
    rows = spark.read.schema("topic string, file string, sentence int").csv(path, header=True)
    return rows.select(F.concat("topic", F.lit("_"), "file", F.lit(".xml")).alias("doc"), F.col("sentence").alias("sent_id")).distinct()


def read_ecb(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tokens (doc, sent_id, token_id, token) and mentions (doc, m_id, tag, tokens_ids, related) of ECB+ XML."""
    schema = T.StructType.fromDDL("_doc_name string, token array<struct<_VALUE:string,_t_id:int,_sentence:int,_number:int>>")
    docs = spark.read.format("xml").option("rowTag", "Document").schema(schema).load(path)
    tokens = docs.select(F.col("_doc_name").alias("doc"), F.inline("token")).select("doc", F.col("_sentence").alias("sent_id"), F.col("_t_id").alias("token_id"), F.col("_VALUE").alias("token"))
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r'doc_name="([^"]*)"', 1).alias("doc"), F.regexp_extract("value", r"(?s)<Markables>(.*?)</Markables>", 1).alias("m"))
    each = raw.select("doc", F.explode(F.regexp_extract_all("m", F.lit(r"(?s)<[A-Z_]+ m_id=[^>]*?(?:/>|>.*?</[A-Z_]+>)"), F.lit(0))).alias("x"))
    ids = F.transform(F.regexp_extract_all("x", F.lit(r't_id="(\d+)"'), F.lit(1)), lambda v: v.cast("int"))
    mentions = each.select("doc", F.regexp_extract("x", r'm_id="(\d+)"', 1).cast("int").alias("m_id"), F.regexp_extract("x", r"^<([A-Z_]+)", 1).alias("tag"), ids.alias("tokens_ids"), F.contains("x", F.lit("RELATED_TO")).alias("related"))
    return tokens, mentions.where(~F.col("related")).withColumn("is_event", F.col("tag").rlike("^(ACT|NEG)"))


def read_ecb_relations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Relations (doc, r_id, tag, source, target) and their targets (doc, m_id, instance, descriptor) of
    ECB+ XML, for ``ecb.with_clusters``."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r'doc_name="([^"]*)"', 1).alias("doc"), "value")
    each = lambda pattern, group: F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(group))).alias("x")
    field = lambda name: F.regexp_extract("x", rf'\b{name}="([^"]*)"', 1)
    found = raw.select("doc", each(r"(?s)<([A-Z_]+) r_id=.*?</\1>", 0))
    ids = lambda tag: F.transform(F.regexp_extract_all("x", F.lit(rf'<{tag} m_id="(\d+)"'), F.lit(1)), lambda v: v.cast("int"))
    relations = found.select("doc", field("r_id").cast("long").alias("r_id"), F.regexp_extract("x", r"^<([A-Z_]+)", 1).alias("tag"), F.explode(ids("source")).alias("source"), F.get(ids("target"), F.lit(0)).alias("target"))
    named = raw.select("doc", each(r"<[A-Z_]+ m_id=[^>]*RELATED_TO=[^>]*>", 0))
    return relations, named.select("doc", field("m_id").cast("int").alias("m_id"), field("instance_id").alias("instance"), field("TAG_DESCRIPTOR").alias("descriptor"))


def read_scores(spark: SparkSession, path: str, columns: str = SCORES) -> DataFrame:
    """All CSV score tables (of these columns) below a folder, with what their paths say:
    ``scenario/experiment/<any>/<dev corpus>_<test corpus>/topics/<file>``. Parts that a path lacks are null."""
    raw = spark.read.schema(columns).option("recursiveFileLookup", "true").option("header", "true").csv(path)
    return with_path_keys(raw.withColumn("path", F.col("_metadata.file_path")), path)


def with_path_keys(scores: DataFrame, root: str) -> DataFrame:
    """Adds scenario, experiment, dev_corpus, test_corpus and topics by the column ``path``, below the root folder.
    The scenario ``ss`` names its corpus in the experiment; the experiment ``lemma`` has no dev corpus."""
    folder = root.rstrip("/").split("://")[-1].lstrip("/")
    parts = F.split(F.regexp_replace(F.substring_index("path", folder, -1), "^/+", ""), "/")
    part = lambda k: F.when(F.size(parts) > k + 1, F.get(parts, F.lit(k)))
    corpora = F.split(part(3), "_")
    dev = F.when(part(1) == "lemma", "n/a").when(part(0) == "ss", F.substring(part(1), 10, 3)).otherwise(F.get(corpora, F.lit(0)))
    named = {"scenario": part(0), "experiment": part(1), "dev_corpus": dev, "test_corpus": F.element_at(corpora, -1), "topics": part(4)}
    return scores.withColumns(named)


def merged(*configs: Mapping) -> dict:
    """Nested settings, later ones winning key by key; lists are replaced as a whole."""
    out: dict = {}
    for config in configs:
        for k, v in config.items():
            out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else (merged(v) if isinstance(v, Mapping) else v)
    return out


def load_configs(*paths: str) -> dict:
    """Merged settings of JSON or YAML files, the right-most winning."""
    read = []
    for p in paths:
        with open(p) as f:
            if p.endswith((".yaml", ".yml")):
                import yaml

                read.append(yaml.safe_load(f) or {})
            else:
                read.append(json.load(f))
    return merged(*read)
