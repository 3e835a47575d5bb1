"""Minimum spans and phrase filters of mentions by the parse column of CoNLL text."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.operators.sentences import CHUNK

#: Phrases that a noun's or a verb's minimum span is looked for in, and what begins them.
NOUN_PHRASES = ("NP", "NM", "QP", "NX")
NOUN_ROOTS = ("NP", "NM")
VERB_PHRASES = ("VP",)
#: Words and parts of speech that are no minimum span.
BRACKETS = ("-LRB-", "-RRB-")
FUNCTION_WORDS = ("CC", "DT", "IN")
PIECE = re.compile(r"\(([^()*]*)|[*)]")
#: A word and part of speech for each kind of words: all letters or digits (1 more) or not, counting (2 more) or not.
KINDS = ((".", "NN"), ("a", "DT"), ("%", "NN"), ("a", "NN"))
RESULT = T.StructType().add("root", "string").add("spans", T.ArrayType(T.StructType().add("words", "string").add("at", "integer")))


class Phrase:
    """A phrase with its parts, or a run of neighbouring words (``parts`` is None) that ends ``at`` a token."""

    def __init__(self, tag: str, parts: list[Phrase] | None = None, words: Sequence[tuple[str, str, int]] = (), at: int = 0):
        self.tag, self.parts, self.words, self.at = tag[:2], parts, words, at
        self.name = tag

    def counts(self) -> bool:
        return any(word_counts(w) and p not in FUNCTION_WORDS for w, p, _ in self.words)


def word_counts(word: str) -> bool:
    return (word == "%" or any(c.isalnum() for c in word)) and word not in BRACKETS


def plain(word: str) -> bool:
    return word.isalpha() or word.isdigit()


def tree(words: Sequence[str], pos: Sequence[str], parse: Sequence[str], first: int) -> Phrase | None:
    """The phrase of a mention, several of them under an NP. Phrases that the mention's end cuts off are
    closed there. A run before a phrase is left out unless a word of it is all letters or all digits."""
    roots: list[Phrase] = []
    opened: list[Phrase] = []
    run: list[tuple[str, str, int]] = []

    def add(part: Phrase) -> None:
        (opened[-1].parts if opened else roots).append(part)

    def close_run(at: int) -> None:
        if run:
            add(Phrase("", None, list(run), at))
            run.clear()

    for i, bits in enumerate(parse):
        for m in PIECE.finditer(bits):
            if m[0] == "*":
                run.append((words[i], pos[i], i))
            elif m[0] == ")":
                close_run(first + i)
                if opened:
                    opened.pop()
            else:
                if not any(plain(w) for w, *_ in run):
                    run.clear()
                close_run(first + i)
                phrase = Phrase("".join(filter(str.isalpha, m[1])), [])
                add(phrase)
                opened.append(phrase)
    close_run(first + len(parse) - 1)
    return Phrase("NP", roots) if len(roots) > 1 else roots[0] if roots else None


def shallowest(root: Phrase, tags: Sequence[str] | None) -> Iterator[Phrase]:
    """The uppermost runs of words that count, reached through phrases of the tags only. Without tags the
    first noun or verb phrase on the way fixes them."""
    queue, depth_found = deque([(root, 0)]), None
    while queue:
        phrase, depth = queue.popleft()
        if depth_found is not None and depth > depth_found:
            return
        if tags is None:
            tags = NOUN_PHRASES if phrase.tag in NOUN_ROOTS else VERB_PHRASES if phrase.tag in VERB_PHRASES else None
        if phrase.parts is None:
            if phrase.counts():
                depth_found = depth
                yield phrase
        elif depth_found != depth and (depth == 0 or tags is None or phrase.tag in tags):
            inside = tags is not None and phrase.tag in tags
            queue.extend((p, depth + 1) for p in phrase.parts if inside or p.parts is not None)


def minimum(root: Phrase | None) -> list[Phrase]:
    """Runs of words right below the root that count; else the uppermost ones of each of its phrases of
    the fitting kind, so that conjunctions keep all their heads; else those of the whole."""
    if root is None:
        return []
    if root.parts is None:
        return [root] if root.counts() else []
    below = {p.tag for p in root.parts}
    verb = root.tag in VERB_PHRASES or (root.tag not in NOUN_ROOTS and not below & set(NOUN_ROOTS) and "VP" in below)
    tags = VERB_PHRASES if verb else NOUN_PHRASES
    found = [p for p in root.parts if p.parts is None and p.counts()]
    if found:
        return found
    phrases = [p for p in root.parts if p.parts and p.tag in tags]
    return [r for p in phrases for r in shallowest(p, tags)] if phrases else list(shallowest(root, None))


@lru_cache(maxsize=100_000)
def shape(kinds: tuple[int, ...], parse: tuple[str, ...]) -> tuple[str | None, tuple[tuple[tuple[int, ...], int], ...], bool, bool]:
    """Tag and minimum spans (the places of their words, and where their phrases close) of all mentions of one parse
    whose words are of the same `KINDS`, in order of the latter; whether there are any, or all words stand for them; and
    whether several close at one place."""
    root = tree([KINDS[k][0] for k in kinds], [KINDS[k][1] for k in kinds], parse, 0)
    runs = tuple(sorted(((tuple(i for *_, i in r.words), r.at) for r in minimum(root)), key=lambda r: r[1]))
    return (root.name if root else None, runs or tuple(((i,), i) for i in range(len(kinds))), bool(runs), len({at for _, at in runs}) < len(runs))


def kinds(words: pa.Array, pos: pa.Array) -> np.ndarray:
    """The kind of each word; different words are looked at once."""
    coded = words.dictionary_encode()
    known, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    alone, counting = (np.array([f(w) for w in known], bool)[of] for f in (plain, word_counts))
    return (alone + 2 * (counting & ~pc.is_in(pos, pa.array(FUNCTION_WORDS)).to_numpy(zero_copy_only=False))).astype(np.int8)


def analysed(words: Sequence[str], pos: Sequence[str], parse: Sequence[str], first: int) -> dict:
    rows = pa.array([[{"word": w, "pos": p, "parse": b} for w, p, b in zip(words, pos, parse)]], pa.list_(pa.struct([(n, pa.string()) for n in ("word", "pos", "parse")])))
    got = analyses(rows, [first])[0].as_py()
    return got | {"spans": got["spans"] or []}


def analyses(rows: pa.Array, first: Sequence[int]) -> pa.Array:
    """root and spans of each list of tokens, the first of which has the given number. Mentions of one `shape` are
    analysed once, whatever their words are."""
    flat, ends = rows.flatten(), np.concatenate([[0], np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    text, parse = flat.field("word").to_pylist(), flat.field("parse").dictionary_encode()
    kind, bits, code = kinds(flat.field("word"), flat.field("pos")), parse.dictionary.to_pylist(), parse.indices.to_numpy(zero_copy_only=False)
    seen, roots, words, places, sizes = {}, [], [], [], [0]
    for a, b, f in zip(ends[:-1].tolist(), ends[1:].tolist(), first):
        if b == a:
            roots.append(None)
            sizes.append(len(words))
            continue
        key = kind[a:b].tobytes(), code[a:b].tobytes()
        if key not in seen:
            seen[key] = shape(tuple(kind[a:b].tolist()), tuple(bits[c] for c in code[a:b].tolist()))
        root, runs, moved, tied = seen[key]
        roots.append(root)
        spans = [(text[a + of[0]] if len(of) == 1 else " ".join([text[a + i] for i in of]), at) for of, at in runs]
        for w, at in sorted(set(spans), key=lambda s: (s[1], s[0])) if tied else spans:
            words.append(w)
            places.append(at + f if moved else at)
        sizes.append(len(words))
    none = pa.array([a == b for a, b in zip(sizes[:-1], sizes[1:])], pa.bool_())
    parts = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(places, pa.int32())], names=["words", "at"])
    return pa.StructArray.from_arrays([pa.array(roots, pa.string()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), parts, mask=none)], names=["root", "spans"])


def token_runs(tokens: DataFrame, doc: str, token: str) -> DataFrame:
    """doc, chunk, words (token, word, pos, parse): the tokens of `CHUNK` neighbouring numbers as one row, so that mentions
    meet chunks and are no rows of tokens."""
    word = F.struct(F.col(token).cast("long").alias("token"), "word", "pos", "parse")
    return tokens.groupBy(doc, F.floor(F.col(token) / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(word)).alias("words"))


def with_minimum_spans(mentions: DataFrame, tokens: DataFrame, doc: str, token: str, key: str) -> DataFrame:
    """mentions (doc, start, end inclusive, key) with ``root``, the tag of the phrase they are, and
    ``spans``, the runs of words (with the token where their phrase closes) that make up their minimum
    span: all words, numbered from 0, if none counts. Null where there are no tokens.

    tokens: doc, token, word, pos, parse, or their runs (`token_runs`). A mention meets the runs that it lies in by an
    equi-join; only mentions that lie in several are gathered. No document is."""
    runs = tokens if "words" in tokens.columns else token_runs(tokens, doc, token)
    chunk = lambda c: F.floor(F.col(c) / CHUNK)
    # Where a run has all tokens from its first to its last, a mention's are a slice of it.
    edge = lambda k: F.get("words", k)["token"]
    runs = runs.withColumn("__lo", edge(F.lit(0))).withColumn("__whole", F.col("words.token") == F.sequence(F.col("__lo"), edge(F.size("words") - 1)))
    skipped = F.greatest(F.col("start") - F.col("__lo"), F.lit(0))
    part = F.slice("words", (skipped + 1).cast("int"), F.greatest(F.col("end") - F.col("__lo") - skipped + 1, F.lit(0)).cast("int"))
    found = F.filter("words", lambda w: (w["token"] >= F.col("start")) & (w["token"] <= F.col("end")))
    inside = F.when(F.col("__whole"), part).otherwise(found).alias("__t")
    rows = mentions.withColumns({"__first": chunk("start"), "__last": chunk("end")})
    # Mentions of a chunk are few, runs are long rows: those stream past a hash table of these, instead of being sorted.
    meet = lambda df: df.hint("shuffle_hash").join(runs.withColumnRenamed("chunk", "__chunk"), [doc, "__chunk"], "left")
    near = meet(rows.where(~F.coalesce(F.col("__first") < F.col("__last"), F.lit(False))).withColumn("__chunk", F.col("__first"))).select(*mentions.columns, inside)
    wide = rows.where("__first < __last")
    parts = meet(wide.select(doc, key, "start", "end", F.explode(F.sequence("__first", "__last")).alias("__chunk"))).select(doc, key, "start", "end", inside)
    each = parts.groupBy(doc, key, "start", "end").agg(F.array_sort(F.flatten(F.collect_list("__t"))).alias("__t")).drop("start", "end")
    far = wide.select(*mentions.columns).join(each, [doc, key], "left").select(*mentions.columns, "__t")
    schema = T.StructType([*mentions.schema.fields, *RESULT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            result = analyses(batch.column("__t"), batch.column("start").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *result.flatten()], names=schema.names)

    # A pass over rows: a function of two columns would queue all others on disk meanwhile.
    return near.unionByName(far).mapInArrow(run, schema)


def without_verb_phrases(mentions: DataFrame, keys: Sequence[str], partial: bool = True) -> DataFrame:
    """Mentions that are no verb phrase (``root``); a chain that lost one goes as a whole if only one
    mention is left, or in any case without ``partial``."""
    verb = F.coalesce(F.col("root") == "VP", F.lit(False))
    chains = mentions.groupBy(*keys).agg(F.count_if(verb).alias("__verbs"), F.count_if(~verb).alias("__left"))
    kept = chains.where((F.col("__verbs") == 0) | (F.lit(partial) & (F.col("__left") > 1))).select(*keys)
    return mentions.where(~verb).join(kept, list(keys), "left_semi")


def documents_with_parses(tokens: DataFrame, doc: str, token: str) -> DataFrame:
    """doc, parsed: whether a document's first token has a parse."""
    return tokens.groupBy(doc).agg(F.coalesce(F.min_by("parse", token).rlike(r"[*(]"), F.lit(False)).alias("parsed"))
