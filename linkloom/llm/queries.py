"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import decontamination, language_id, license_scan, line_dedup, manifest, mixing, near_dedup, quality_cnn, quality_rules, token_counts, toxicity, url_filter, whitening

QUERIES: dict = {}
ORACLES: dict = {}

TOKENIZER = "piece_bpe_32k.model"


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


#: The rules of the registered query: (verdict, host, path).
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op6_url_filter"] = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule_verdict, rule_host, rule_path) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
judged AS (
  SELECT u.*, r.rule_host || r.rule_path AS rule, r.rule_verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST, length(r.rule_host) DESC, r.rule_verdict DESC) AS best
  FROM urls u LEFT JOIN rules r
    ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM judged WHERE best = 1
"""


def fold(of: int, held: int) -> Column:
    """Whether crc32 of the doc_id's text leaves the remainder that marks held-out rows."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of)) == held, F.lit(False))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = language_id.train(docs, ~fold(4, 2))
    return language_id.identify(docs, filters).select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score")


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("places")


def _license_oracle() -> str:
    t = license_scan
    templates = ", ".join(f"({k}, '{x.label}', {x.base}, '{x.words}', '{x.key}', {x.key_at})" for k, x in enumerate(t.TEMPLATES))
    return rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{t.UPPER}', '{t.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), file_words AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM texts
), templates(t, label, base, words, key, key_at) AS (VALUES {templates}),
template_words AS (
  SELECT t, unnest(string_split(words, ' ')) AS word, unnest(range(len(string_split(words, ' ')))) AS pos FROM templates
), frequency AS (
  SELECT word, count(DISTINCT doc_id) AS df FROM file_words WHERE word IN (SELECT word FROM template_words) GROUP BY word
), ranked AS (
  SELECT t, word, min(pos) AS pos, row_number() OVER (PARTITION BY t ORDER BY coalesce(any_value(df), 0), word) AS rarity
  FROM template_words LEFT JOIN frequency USING (word) GROUP BY t, word
), postings AS (SELECT t, word, pos, least({t.AGREE}, count(*) OVER (PARTITION BY t)) AS need FROM ranked WHERE rarity <= {t.INDEXED}),
candidates AS (
  SELECT doc_id, p.t, f.pos - p.pos AS start FROM file_words f JOIN postings p USING (word)
  GROUP BY doc_id, p.t, f.pos - p.pos HAVING count(*) >= any_value(need)
), found AS (
  SELECT doc_id, t, label, base, start, string_split(m.words, ' ') AS template, x.words
  FROM candidates JOIN templates m USING (t) JOIN texts x USING (doc_id)
  WHERE start + key_at >= 0 AND list_slice(x.words, start + key_at + 1, start + key_at + len(string_split(key, ' '))) = string_split(key, ' ')
), scored AS (
  SELECT *, len(list_filter(range(len(template)), lambda j: start + j >= 0 AND words[start + j + 1] = template[j + 1])) / len(template) AS share FROM found
), summed AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
  FROM scored GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM texts LEFT JOIN summed USING (doc_id)
"""


ORACLES["op3_license_scan"] = _license_oracle()


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_lines(table(spark, sf_dir, "documents"))


def _quality_oracle() -> str:
    q = quality_rules
    white, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
    any_of = lambda chars: "[" + "".join(f"\\{c}" if c in "\"')]}.?" else c for c in chars) + "]"
    closers = any_of(q.CLOSERS).replace("'", "''")
    stock = " OR ".join(f"contains(low, '{p}')" for p in q.STOCK_PHRASES)
    symbols = "[#*$%&|<>]"
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS words FROM documents),
windows AS (
  SELECT doc_id, unnest(range(len(words) - {q.WINDOW - 1})) AS pos, unnest(list_transform(range(len(words) - {q.WINDOW - 1}), lambda i: array_to_string(words[i + 1 : i + {q.WINDOW}], ' '))) AS w
  FROM texts WHERE len(words) >= {q.WINDOW}
), twice AS (SELECT doc_id, pos FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
repeats AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, pos + d AS pos FROM twice, range({q.WINDOW}) t(d)) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM texts),
filled AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '{word}')) AS words, length(regexp_replace(line, '{white}', '', 'g')) AS chars,
    len(regexp_extract_all(line, '{symbols}')) AS symbols, len(regexp_extract_all(line, '!')) AS shouts,
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup
  FROM lines WHERE regexp_matches(line, '{word}')
), failing AS (
  SELECT *, NOT (regexp_matches(line, '[.!?]{white}') OR regexp_matches(line, '(?:{"|".join(any_of(e) for e in q.ENDS)}){closers}*{white}*$')) OR (shouts >= 3 AND 10 * shouts > 3 * words)
    OR (symbols >= 3 AND 4 * symbols > words) OR dup OR (({stock}) AND words <= {q.STOCK_WORDS}) AS fails
  FROM filled
), by_text AS (
  SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(chars) FILTER (fails), 0) AS lost, coalesce(sum(words) FILTER (NOT fails), 0) AS left_words FROM failing GROUP BY doc_id
), counted AS (
  SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{white}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '{symbols}')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lost, left_words
  FROM texts t LEFT JOIN by_text USING (doc_id) LEFT JOIN repeats USING (doc_id)
), judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(lost, 0) <= 0.5 * word_chars AND coalesce(left_words, 0) >= 10 AS kept
FROM judged
"""


ORACLES["op4_quality_rules"] = _quality_oracle()


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), ~fold(3, 1))
    return toxicity.score_toxicity(docs, machine).select("doc_id", fold(3, 1).alias("held_out"), "score", "predicted")


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = quality_cnn.train(docs, table(spark, sf_dir, "labels"), ~fold(4, 2))
    return quality_cnn.score_quality(docs, network).select("doc_id", fold(4, 2).alias("held_out"), "score", "predicted")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op5_decontamination"] = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS words FROM documents),
items AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS words FROM benchmark),
sized AS (SELECT *, least({decontamination.WIDTH}, len(words)) AS width FROM items WHERE len(words) > 0),
item_shingles AS (
  SELECT DISTINCT item_id, width, unnest(list_transform(range(len(words) - width + 1), lambda i: array_to_string(words[i + 1 : i + width], ' '))) AS s FROM sized
), doc_shingles AS (
  SELECT DISTINCT doc_id, width, unnest(list_transform(range(len(words) - width + 1), lambda i: array_to_string(words[i + 1 : i + width], ' '))) AS s
  FROM docs, (SELECT DISTINCT width FROM sized) WHERE len(words) >= width
), totals AS (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM doc_shingles JOIN item_shingles USING (width, s) JOIN totals USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= {decontamination.THRESHOLD} * n_item - 1e-9
"""


#: The registered mix: sources fall into four domains by a checksum of their name.
MIX_WEIGHTS = {
    "domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0},
    "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0},
}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 3, 17


def mix_levels() -> dict[str, Column]:
    domain = F.concat(F.lit("d"), F.pmod(F.conv(F.substring(F.md5("source"), 1, 8), 16, 10).cast("long"), F.lit(4)).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix_sources(docs, mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def mix_oracle(docs: str) -> str:
    """SQL for the mix of a table (or common table expression) of documents."""

    def weight(level: str) -> str:
        given = " ".join(f"WHEN '{k}' THEN {w}" for k, w in MIX_WEIGHTS.get(level, {}).items())
        return f"CASE {level} {given} ELSE 1.0 END" if given else "CAST(1.0 AS DOUBLE)"

    def spread(name: str, nodes: str, by: str, level: str) -> str:
        part = f"PARTITION BY {by} " if by else ""
        window = f"{part}ORDER BY capacity / weight, {level} ROWS BETWEEN"
        return f"""
{name}_level AS (
  SELECT *, sum(capacity) OVER ({window} UNBOUNDED PRECEDING AND CURRENT ROW)
    + capacity / weight * coalesce(sum(weight) OVER ({window} 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) <= parent_budget + 1e-6 AS filled
  FROM {nodes}
), {name} AS (
  SELECT *, CASE WHEN filled THEN capacity ELSE (parent_budget - coalesce(sum(capacity) FILTER (filled) OVER ({part}), 0))
    / sum(weight) FILTER (NOT filled) OVER ({part}) * weight END AS budget
  FROM {name}_level
)"""

    return rf"""
WITH mix_rows AS (
  SELECT * FROM (
    SELECT doc_id, 'd' || (CAST('0x' || substr(md5(source), 1, 8) AS BIGINT) % 4) AS domain, lang, source,
      CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM {docs}
  ) WHERE n_tokens > 0
), mix_leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, CAST(sum(n_tokens) * {MIX_EPOCHS} AS DOUBLE) AS capacity FROM mix_rows GROUP BY ALL),
mix_top AS (SELECT least(sum(tokens) * CAST({MIX_SHARE} AS DOUBLE), sum(capacity)) AS parent_budget FROM mix_leaves),
mix_n1 AS (SELECT domain, sum(capacity) AS capacity, CAST({weight("domain")} AS DOUBLE) AS weight, any_value(parent_budget) AS parent_budget FROM mix_leaves, mix_top GROUP BY domain),
{spread("mix_b1", "mix_n1", "", "domain")},
mix_n2 AS (SELECT l.domain, lang, sum(l.capacity) AS capacity, CAST({weight("lang")} AS DOUBLE) AS weight, any_value(b.budget) AS parent_budget FROM mix_leaves l JOIN mix_b1 b ON l.domain = b.domain GROUP BY l.domain, lang),
{spread("mix_b2", "mix_n2", "domain", "lang")},
mix_n3 AS (SELECT l.domain, l.lang, source, tokens, l.capacity, CAST(1.0 AS DOUBLE) AS weight, b.budget AS parent_budget FROM mix_leaves l JOIN mix_b2 b ON l.domain = b.domain AND l.lang = b.lang),
{spread("mix_b3", "mix_n3", "domain, lang", "source")},
mix_plan AS (SELECT domain, lang, source, tokens, CAST(floor(round(budget, 3)) AS BIGINT) AS leaf_budget FROM mix_b3),
mix_order AS (
  SELECT r.*, leaf_budget, leaf_budget // tokens AS whole, leaf_budget % tokens AS rest, md5('{MIX_SEED}:' || (leaf_budget // tokens) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM mix_rows r JOIN mix_plan p ON r.domain = p.domain AND r.lang = p.lang AND r.source = p.source
), mix_times AS (
  SELECT *, whole + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS times FROM mix_order
)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(CAST(times AS BIGINT))) AS epoch, leaf_budget FROM mix_times
"""


ORACLES["op7_mixing"] = mix_oracle("documents")


@query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op11_line_dedup"] = rf"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT key, doc_id FROM keyed WHERE length(key) >= {line_dedup.MIN_CHARS}) GROUP BY key HAVING count(*) >= {line_dedup.MIN_DOCS}
), judged AS (
  SELECT doc_id, line, pos, keeper IS NOT NULL AND keeper <> doc_id AS dropped FROM keyed LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    fit = whitening.train(vectors)
    rows = whitening.whiten(vectors, fit).select("vec_id", "deviation", F.posexplode("whitened").alias("component", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(e) / fit.total) for e in fit.values]) if fit.total else F.array(F.lit(0.0)), F.col("component") + 1)
    return rows.select(
        "vec_id", (F.col("component") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened",
        explained.alias("explained"), F.lit(fit.identity_error).alias("identity_error"),
    )


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    leaf = lambda text: manifest.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    claim = F.when(fold(3, 0), leaf(F.translate("text", upper, lower))).otherwise(leaf(F.col("text")))
    found = manifest.manifest(docs, leaf(F.col("text")), claim)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def _manifest_oracle(levels: int = 7) -> str:
    """SQL for up to 8 ** levels documents of a language, and 64 languages."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "list_reduce(list_prepend(xor(crc, code), [CAST(0 AS BIGINT) FOR _ IN range(8)]), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda crc, code: {byte}), 4294967295)"

    def tree(name: str, by: str, leaves: str, height: int) -> list[str]:
        """Levels of the trees by that column: pos, d; a tree of one node goes up unchanged."""
        out = [f"{name}0 AS MATERIALIZED ({leaves})"]
        for k in range(height):
            n = f"count(*) OVER (PARTITION BY {by})"
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {by}, pos // 8 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM (SELECT *, {n} AS n FROM {name}{k}) GROUP BY {by}, pos // 8)")
        return out

    def beside(name: str, by: str, height: int) -> list[str]:
        """The siblings of every node: those left and those right of it."""
        out = []
        for k in range(height):
            run = f"PARTITION BY {by}, pos // 8 ORDER BY pos ROWS BETWEEN"
            out.append(f"{name}s{k} AS MATERIALIZED (SELECT {by}, pos, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, count(*) OVER (PARTITION BY {by}) > 1 AS up FROM {name}{k})")
        return out

    steps = [f"x{k}" for k in range(levels)] + ["y0", "y1"]
    joins = " ".join(f"JOIN ls{k} x{k} ON x{k}.lang IS NOT DISTINCT FROM b.lang AND x{k}.pos = b.pos // {8**k}" for k in range(levels))
    joins += " JOIN l{0} u ON u.lang IS NOT DISTINCT FROM b.lang JOIN t0 t ON t.lang IS NOT DISTINCT FROM b.lang".format(levels)
    joins += " JOIN ts0 y0 ON y0.pos = t.pos JOIN ts1 y1 ON y1.pos = t.pos // 8, t2 top"
    fold_steps = []
    for k, s in enumerate(steps):
        fold_steps.append(f"f{k} AS MATERIALIZED (SELECT * EXCLUDE (node), CASE WHEN {s}_up THEN sha256({s}_l || node || {s}_r) ELSE node END AS node FROM {'joined' if k == 0 else f'f{k - 1}'})")
    wide = ", ".join(f"{s}.l AS {s}_l, {s}.r AS {s}_r, {s}.up AS {s}_up" for s in steps)
    proof = " || ".join(f"{s}_l || {s}_r" for s in steps)
    parts = [
        f"b AS MATERIALIZED (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS claim FROM documents)",
        *tree("l", "lang", "SELECT lang, pos, leaf AS d FROM b", levels),
        *tree("t", "one", f"SELECT 1 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, d FROM l{levels}", 2),
        *beside("l", "lang", levels),
        *beside("t", "one", 2),
        f"joined AS MATERIALIZED (SELECT doc_id, leaf, u.d AS subroot, top.d AS root, claim AS node, {wide} FROM b {joins})",
        *fold_steps,
    ]
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, node AS folded_root, node = root AS verified FROM f{len(steps) - 1}"


ORACLES["op13_manifest"] = _manifest_oracle()
