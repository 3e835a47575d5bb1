"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words (runs of ASCII letters and digits and of all
non-ASCII characters), hashed into ``2 ** DIM_BITS`` features. The machine scores
``b + sum w_i + sum_{i<j} <v_i, v_j>`` over them, the pairs by the usual square-of-sum identity, so
that an insult next to a group's name can weigh more than both apart. Terms have weight and factors
only if the training sample speaks for them: at least `MIN_TEXTS` of its texts hold the term and its
counts by class differ by a log-likelihood ratio of `MIN_RATIO` or more (`telling`), or it belongs to
a pair of which the class rate differs by `PAIR_RATIO` or more from what both terms' own rates add up
to (`telling_pairs`), so that terms which are neutral by themselves can interact. Near copies within
the sample count once, since the words they share would otherwise look like many independent cases.

It is fitted by AdaGrad on a bounded sample of labelled rows (``rows`` of at most ``max_bytes``
bytes each), classes weighted towards balance, then one slope and intercept are fitted so that the
probabilities match the sample's own rates.

Null and empty texts have no terms and get the intercept's score; with nothing to learn from, or
one class only, all scores are that class's rate (0 without labels). Rows come back one for one,
repeated rows with equal scores, and an empty table gives an empty result; a score at the threshold
counts as toxic. Of very long texts every term counts. Extra columns are not read, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from linkloom.llm.arrow_text import joined, mix, range_hashes, slices, small_batches
from linkloom.llm.labelled import labelled_sample

DIM_BITS = 18
FACTORS = 4
MIN_TEXTS = 3
#: About the chi-square quantile that one term in 10,000 passes by chance.
MIN_RATIO = 15.0
#: Pairs are tested among so many of the sample's commonest terms; about one pair in 10 million passes
#: this ratio by chance.
PAIR_TERMS, PAIR_TEXTS, PAIR_RATIO = 3000, 10, 30.0
#: Steps of the fit, at least: small samples are gone through more often.
STEPS = 1500
#: Texts of the sample that share this many of their min-hashes with an earlier one are left out.
SIGNATURE, SHARED = 16, 5

_is_word = np.zeros(256, bool)
_is_word[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every distinct term of each row, by row."""
    data, starts, _ = joined(pc.utf8_lower(column))
    edge = np.diff(np.concatenate(([False], _is_word[data], [False])).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    feature = (range_hashes(data, begin, end) >> np.uint64(64 - DIM_BITS)).astype(np.int64)
    row = np.searchsorted(starts, begin, side="right") - 1
    both = np.unique(row << DIM_BITS | feature)
    return both >> DIM_BITS, both & ((1 << DIM_BITS) - 1)


def sample_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """`terms` of a list of texts, a bounded slice of them at a time."""
    found, done = [], 0
    for part in slices(pa.record_batch([pa.array(texts, pa.large_string())], names=["text"]), "text"):
        row, feature = terms(part.column(0))
        found.append((row + done, feature))
        done += part.num_rows
    rows, features = zip(*found)
    return np.concatenate(rows), np.concatenate(features)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias) + np.bincount(row, weights=self.weight[feature], minlength=n)
        for f in range(self.factor.shape[1]):
            v = self.factor[feature, f]
            out += 0.5 * (np.bincount(row, weights=v, minlength=n) ** 2 - np.bincount(row, weights=v * v, minlength=n))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        row, feature = terms(column)
        return sigmoid(self.slope * self.margins(row, feature, len(column)) + self.shift)


def first_of_kind(texts: list[str]) -> list[int]:
    """The positions of texts that are no near copies of earlier ones, by min-hashes of word pairs."""
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    salts = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64))
    for i, text in enumerate(texts):
        words = text.lower().split()
        pairs = np.array([zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:])] or [zlib.crc32(text.encode())], np.uint64)
        marks = [(k, int(mix(pairs ^ salt).min())) for k, salt in enumerate(salts)]
        met = Counter(j for m in marks for j in seen.get(m, ()))
        if met and met.most_common(1)[0][1] >= SHARED:
            continue
        kept.append(i)
        for m in marks:
            seen.setdefault(m, []).append(i)
    return kept


def telling(row: np.ndarray, feature: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which features' presence goes with the class beyond chance (G-test of the 2 x 2 table)."""
    size, pos = 1 << DIM_BITS, y.sum()
    neg = len(y) - pos
    in_pos = np.bincount(feature, weights=y[row], minlength=size)
    df = np.bincount(feature, minlength=size)
    ratio = np.zeros(size)
    for seen, of in ((in_pos, pos), (df - in_pos, neg)):
        for cell, expect in ((seen, of * df / len(y)), (of - seen, of * (1 - df / len(y)))):
            ratio += 2 * cell * np.log(np.maximum(cell, 1e-9) / np.maximum(expect, 1e-9))
    return (df >= MIN_TEXTS) & (ratio >= MIN_RATIO)


def telling_pairs(row: np.ndarray, feature: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The features of pairs whose joint presence goes with the class otherwise than both apart.

    Where both are present, the class should follow the log-odds that their own rates add up to; the
    ratio is that of the observed counts against this expectation."""
    df = np.bincount(feature, minlength=1 << DIM_BITS)
    common = np.flatnonzero((df >= PAIR_TEXTS) & (df < len(y)))
    common = np.sort(common[np.argsort(-df[common], kind="stable")][:PAIR_TERMS])
    place = np.full(1 << DIM_BITS, -1)
    place[common] = np.arange(len(common))
    row, at = row[place[feature] >= 0], place[feature][place[feature] >= 0]
    m = len(common)
    both, both_pos = np.zeros((m, m), np.float32), np.zeros((m, m), np.float32)
    for start in range(0, len(y), 1024):
        inside = (row >= start) & (row < start + 1024)
        x = np.zeros((min(1024, len(y) - start), m), np.float32)
        x[row[inside] - start, at[inside]] = 1
        both += x.T @ x
        x = x[y[start : start + 1024] == 1]
        both_pos += x.T @ x
    # Rates with half a case of each class added.
    odds = np.log((np.diag(both_pos) + 0.5) / (np.diag(both) - np.diag(both_pos) + 0.5))
    base = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    found = np.zeros(m, bool)
    for start in range(0, m, 256):
        n, pos = both[start : start + 256], both_pos[start : start + 256]
        p = sigmoid(odds[start : start + 256, None] + odds[None, :] - base)
        ratio = np.zeros(n.shape)
        for cell, share in ((pos, p), (n - pos, 1 - p)):
            ratio += 2 * cell * np.log(np.maximum(cell, 1e-9) / np.maximum(n * share, 1e-9))
        ratio[n < PAIR_TEXTS] = 0
        ratio[np.arange(len(n)), start + np.arange(len(n))] = 0
        found |= (ratio >= PAIR_RATIO).any(axis=0)
    return common[found]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[str], labels: list[int], epochs: int = 12, batch: int = 64, rate: float = 0.08, penalty: float = 2e-4, seed: int = 7) -> Machine:
    size = 1 << DIM_BITS
    y = np.array(labels, float)
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32))
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0, 1e-6, 1 - 1e-6))
        m.slope, m.shift = 0.0, float(np.log(p / (1 - p))) if len(y) else -40.0
        return m
    kept = first_of_kind(texts)
    texts, y = [texts[i] for i in kept], y[kept]
    row, feature = sample_terms(texts)
    often = telling(row, feature, y)
    often[telling_pairs(row, feature, y)] = True
    row, feature = row[often[feature]], feature[often[feature]]
    m.factor[often] = rng.normal(0, 0.01, (int(often.sum()), FACTORS)).astype(np.float32)
    first = np.searchsorted(row, np.arange(len(y) + 1))
    seen_w, seen_v, seen_b = np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32), 1e-6
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    for _ in range(max(epochs, STEPS * batch // len(y))):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            ids = order[k : k + batch]
            counts = first[ids + 1] - first[ids]
            at = np.repeat(first[ids] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            x, r = feature[at], np.repeat(np.arange(len(ids)), counts)
            v = m.factor[x]
            sums = np.stack([np.bincount(r, weights=v[:, f], minlength=len(ids)) for f in range(FACTORS)], axis=1)
            z = m.bias + np.bincount(r, weights=m.weight[x], minlength=len(ids)) + 0.5 * ((sums**2).sum(1) - np.bincount(r, weights=(v * v).sum(1), minlength=len(ids)))
            g = (sigmoid(z) - y[ids]) * share[ids] / len(ids)
            uniq, inv = np.unique(x, return_inverse=True)
            gw = np.bincount(inv, weights=g[r]) + penalty * m.weight[uniq]
            gv_each = g[r][:, None] * (sums[r] - v)
            gv = np.stack([np.bincount(inv, weights=gv_each[:, f]) for f in range(FACTORS)], axis=1) + penalty * m.factor[uniq]
            seen_w[uniq] += gw**2
            seen_v[uniq] += gv**2
            seen_b += g.sum() ** 2
            m.weight[uniq] -= rate * gw / np.sqrt(seen_w[uniq])
            m.factor[uniq] -= 0.2 * rate * gv / np.sqrt(seen_v[uniq])
            m.bias -= rate * g.sum() / np.sqrt(seen_b)
    calibrate(m, m.margins(row, feature, len(y)), y)
    return m


def calibrate(m: Machine, z: np.ndarray, y: np.ndarray) -> None:
    """Platt's slope and intercept by Newton steps, with a weak pull of the slope towards 1."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - y) * z).sum() + (a - 1), (p - y).sum() + 1e-3 * b])
        hess = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -1, 1)
    m.slope, m.shift = float(max(a, 1e-3)), float(b)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", rows: int = 8000, max_bytes: int = 65_536) -> Machine:
    return fit(*labelled_sample(docs, labels, label, usable, rows, max_bytes))


def score_toxicity(docs: DataFrame, machine: Machine, keys: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = 0.7) -> DataFrame:
    """keys, score (0 to 1) and predicted (1 if score >= threshold) of every row. The machine (5 MB,
    fixed by DIM_BITS and FACTORS) is broadcast."""
    schema = docs.select(*keys).schema.add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                score = shared.value.scores(part.column(text))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return small_batches(docs.select(*dict.fromkeys((*keys, text)))).mapInArrow(run, schema)
