"""Language identification with bit-sliced Bloom filters of character n-grams.

Every language has a Bloom filter of its frequent n-grams; the filters are stored sliced by bit, one
machine word per slot with one bit per language. Looking an n-gram up is the AND of its slots'
words: a mask of all languages that (may) hold it. A text's hits per language are the popcounts of
its n-grams' masks bit by bit; each is corrected by the rate at which that language's filter answers
yes by chance (fill ** probes), and the largest corrected share decides.

n-grams are 2 to 4 characters of lower-cased words, the edges of a word counting as characters. A
language's set is every n-gram that makes up at least `MIN_SHARE` of its n-grams in the training
sample, unless some other language uses it more than `RATIO` times as much (relative to size).

Training learns from a bounded sample of labelled rows: at most about `docs_per_language` rows of
each language, taken by a hash of the text. The texts are read once for it. The driver gets the
n-grams that reach `MIN_SHARE`, so at most 1 / MIN_SHARE of them per language however large the
corpus is.

Texts that are null or have no letter get `und` with score 0, as does everything when there is
nothing to learn from. Texts whose n-grams are all unknown get the commonest language, score 0.
Ties go to the alphabetically first language. Rows come back one for one, repeated rows with equal
results, and an empty table gives an empty result. Of very long texts all n-grams count; they cost
time and memory in proportion to their length. Extra columns pass through `filter_languages`
untouched and are not read by `identify`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow_text import mix, slices, small_batches
from linkloom.operators.materialize import Scratch

ORDERS = (2, 3, 4)
MIN_SHARE = 1e-5
RATIO = 20.0
SLOT_BITS = 22
PROBES = 3
#: The score is the decided language's part of all corrected shares, each raised to this power.
SHARPEN = 8
UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint32)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha() or 0x300 <= p < 0x370:
            table[p] = p
    return table


_letters: list[np.ndarray] = []


def word_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts with 0 for all but letters and 0 before each text, and
    where each text ends."""
    if not _letters:
        _letters.append(_letter_table())
    low = [t.lower() for t in texts]
    whole = "\0" + "\0".join(low) + "\0"
    points = _letters[0][np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
    return points, ends


def gram_hashes(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the starts of its n-grams and their hashes. An n-gram may begin or end at a
    word's edge but never spans one."""
    space = points == 0
    values = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        good = np.ones(m, bool)
        for j in range(1, n - 1):
            good &= ~space[j : j + m]
        good &= ~(space[:m] & space[n - 1 : n - 1 + m])
        at = np.flatnonzero(good)
        with np.errstate(over="ignore"):
            h = np.full(len(at), n, np.uint64)
            for j in range(n):
                h = (h ^ values[at + j]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(31)
            yield at, mix(h)


@dataclass
class Filters:
    """Bit-sliced Bloom filters: ``slots[word, slot]`` has bit l set if language 64 * word + l set the slot."""

    languages: list[str]
    slots: np.ndarray
    chance: np.ndarray
    commonest: str

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        step = (h >> np.uint64(40)) | np.uint64(1)
        size = np.uint64(self.slots.shape[1] - 1)
        with np.errstate(over="ignore"):
            return [((h + np.uint64(k) * step) & size).astype(np.int64) for k in range(PROBES)]

    def masks(self, h: np.ndarray, word: int) -> np.ndarray:
        """The languages that hold each n-gram, as bits."""
        row = self.slots[word]
        out = None
        for at in self.places(h):
            got = row[at]
            out = got if out is None else out & got
        return out

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the number of n-grams, and of those in each language's filter."""
        points, ends = word_points(texts)
        begins = np.concatenate(([0], ends[:-1]))
        total = np.zeros(len(texts), np.int64)
        held = np.zeros((len(texts), len(self.languages)), np.int64)
        for at, h in gram_hashes(points):
            # An n-gram belongs to the text it begins in; its leading edge belongs to that text too.
            lo, hi = np.searchsorted(at, begins), np.searchsorted(at, ends)
            total += hi - lo
            for word in range(self.slots.shape[0]):
                masks = self.masks(h, word)
                for bit in range(min(64, len(self.languages) - 64 * word)):
                    seen = (masks >> self.slots.dtype.type(bit)) & self.slots.dtype.type(1)
                    upto = np.concatenate(([0], np.cumsum(seen, dtype=np.int64)))
                    held[:, 64 * word + bit] += upto[hi] - upto[lo]
        return total, held

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, held = self.hits([t or "" for t in texts])
        share = held / np.maximum(total, 1)[:, None]
        fair = np.clip((share - self.chance) / np.maximum(1e-9, 1 - self.chance), 0, 1)
        best = fair.argmax(axis=1)
        top = fair[np.arange(len(texts)), best]
        odds = (fair / np.where(top > 0, top, 1)[:, None]) ** SHARPEN
        score = np.where(top > 0, 1 / np.maximum(1, odds.sum(axis=1)), 0.0)
        names = []
        for t, b, x in zip(texts, best.tolist(), top.tolist()):
            if t is None or not any(c.isalpha() for c in t):
                names.append(UNKNOWN)
            else:
                names.append(self.languages[b] if x > 0 else self.commonest)
        return names, np.where(np.array([n == UNKNOWN for n in names], bool), 0.0, score)


def sample(docs: DataFrame, usable: Column, text: str, lang: str, docs_per_language: int) -> tuple[DataFrame, dict[str, int]]:
    """About docs_per_language usable rows of each language with a text, by a hash of the text, and the
    counts of all usable rows by language, for which the texts are not read."""
    rows = docs.where(usable & F.col(lang).isNotNull())
    counts = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")), counts
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, docs_per_language / n) * 2**32))])
    draw = F.pmod(F.xxhash64(F.col(text)), F.lit(2**32))
    return rows.where(F.col(text).isNotNull() & (draw < F.element_at(bound, F.col(lang)))).select(F.col(text).alias("text"), F.col(lang).alias("lang")), counts


def train(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", docs_per_language: int = 1500) -> Filters:
    """Filters of every language among the usable rows.

    Each task folds its part of the sample into counts of hashed n-grams; the partial counts are
    added up by key before the driver sees one array of fixed size per language."""
    picked, by_language = sample(docs, usable, text, lang, docs_per_language)
    languages = sorted(by_language)
    if not languages:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0), UNKNOWN)
    order = {name: k for k, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                langs = np.array([order[x] for x in part.column("lang").to_pylist()])
                texts = np.array(part.column("text").to_pylist(), object)
                for k in np.unique(langs):
                    points, _ = word_points(texts[langs == k].tolist())
                    for _, h in gram_hashes(points):
                        grams, n = np.unique(h, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), k, np.int32)), pa.array(grams.view(np.int64)), pa.array(n)], names=["k", "gram", "n"])

    scratch = Scratch(docs.sparkSession)
    summed = scratch.keep(small_batches(picked).mapInArrow(count, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")))
    totals = {r["k"]: r["n"] for r in summed.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        scratch.clear()
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0), UNKNOWN)
    total = F.element_at(F.create_map(*[F.lit(x) for pair in totals.items() for x in pair]), F.col("k"))
    share = summed.select("k", "gram", (F.col("n") / total).alias("share")).where(F.col("share") >= MIN_SHARE)
    most = share.groupBy("gram").agg(F.max("share").alias("most"))
    kept = share.join(most, "gram").where(F.col("share") * RATIO >= F.col("most")).select("k", "gram")
    # At most 1 / MIN_SHARE n-grams of each language have that share: a bound that no corpus exceeds.
    grams = kept.toArrow()
    scratch.clear()
    words = -(-len(languages) // 64)
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    slots = np.zeros((words, 1 << SLOT_BITS), kind)
    out = Filters(languages, slots, np.zeros(len(languages)), max(languages, key=lambda x: (by_language[x], x)))
    ks = grams.column("k").to_numpy()
    hs = grams.column("gram").to_numpy().view(np.uint64)
    for k in range(len(languages)):
        for at in out.places(hs[ks == k]):
            slots[k // 64, np.unique(at)] |= kind(1 << (k % 64))
        fill = np.count_nonzero(slots[k // 64] & kind(1 << (k % 64))) / slots.shape[1]
        out.chance[k] = fill**PROBES
    return out


def identify(docs: DataFrame, filters: Filters, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, lang_pred and score of every row. The filters are broadcast: 4 MB up to
    eight languages, 32 MB for each 64 beyond (fixed by SLOT_BITS)."""
    schema = docs.select(*keys).schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                names, score = shared.value.decide(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    return small_batches(docs.select(*dict.fromkeys((*keys, text)))).mapInArrow(run, schema)


def filter_languages(docs: DataFrame, filters: Filters, wanted: tuple[str, ...], min_score: float, text: str = "text", declared: str | None = None) -> DataFrame:
    """The rows, with all their columns, whose language is among wanted with at least min_score.

    With declared, a column of the languages that the sources state, rows whose statement differs from
    what is found go too; rows without a statement are judged by wanted and min_score alone."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                names, score = shared.value.decide(part.column(text).to_pylist())
                stated = part.column(declared).to_pylist() if declared else [None] * len(names)
                keep = [n in wanted and s >= min_score and d in (n, None) for n, s, d in zip(names, score.tolist(), stated)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
