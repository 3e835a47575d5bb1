"""Quality classification by a byte-level convolutional network in numpy.

Bytes are embedded, `FILTERS` learned filters of `WIDTH` bytes slide over the whole text two bytes
at a time, and rectified responses are max-pooled over chunks of 512 bytes that overlap by half. A
text's features are the mean and the maximum of its chunks' pooled responses; a logistic unit over
them gives one probability. Scoring sums table lookups: a filter's response to a pair of bytes is
tabulated for each of its four pair positions, so a window costs four gathers.

Training back-propagates through the pooled positions only and uses Adam on a bounded sample of
labelled rows (``rows`` of at most ``max_bytes`` bytes each). Near copies in the sample count once.

Empty and null texts are one all-zero chunk and score what the network gives for it; without
labels, or with one class only, every score is that class's rate (0 without labels). Rows come back
one for one; ties and repeats get equal scores; extra columns aren't read (`keep_quality` passes
them through). An empty table gives an empty result. A very long text is pooled some blocks at a time, in
memory of a few times its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from linkloom.llm.arrow_text import slices, small_batches, utf8
from linkloom.llm.labelled import labelled_sample
from linkloom.llm.toxicity import first_of_kind, sigmoid

WIDTH, STRIDE, FILTERS, EMBEDDED = 8, 2, 24, 8
#: Pooling blocks, in windows; a chunk is two neighbouring blocks.
BLOCK = 128
BLOCK_BYTES = BLOCK * STRIDE
#: Blocks whose responses are held at once.
PART_BLOCKS = 256


@dataclass
class Blocks:
    """Texts laid out in whole blocks of zero-padded bytes."""

    data: np.ndarray
    first: np.ndarray
    count: np.ndarray
    valid: np.ndarray


def lay_out(column: pa.Array) -> Blocks:
    raw, offsets = utf8(column)
    sizes = np.diff(offsets)
    # The last window of a text ends in zeros of its own, not in the next text.
    count = -(-(sizes + WIDTH - STRIDE) // BLOCK_BYTES)
    first = np.cumsum(count) - count
    data = np.zeros(int(count.sum()) * BLOCK_BYTES + WIDTH, np.uint8)
    for start, low, high in zip((first * BLOCK_BYTES).tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        data[start : start + high - low] = raw[low:high]
    position = np.arange(BLOCK) * STRIDE
    left = np.repeat(np.maximum(sizes, 1), count) - (np.arange(int(count.sum())) - np.repeat(first, count)) * BLOCK_BYTES
    return Blocks(data, first, count, position[None, :] < left[:, None])


def tabulated(filters: np.ndarray) -> list[np.ndarray]:
    """For each of a window's pair positions, the responses of filters[WIDTH, 256, FILTERS] to all pairs of bytes."""
    return [(filters[j][:, None, :] + filters[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]


def responses(data: np.ndarray, pairs: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Responses (block, window, filter)."""
    codes = data[: len(data) // 2 * 2].reshape(-1, 2)
    codes = codes[:, 0].astype(np.int64) << 8 | codes[:, 1]
    n = (len(data) - WIDTH) // STRIDE
    out = np.take(pairs[0], codes[:n], axis=0)
    for j in range(1, WIDTH // 2):
        out += np.take(pairs[j], codes[j : n + j], axis=0)
    out += bias
    return out.reshape(-1, BLOCK, FILTERS)


@dataclass
class Network:
    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    constant: float | None = None
    #: Filled by `scores` for a fitted network, which no longer changes.
    pairs: list[np.ndarray] | None = None

    def filters(self) -> np.ndarray:
        return np.einsum("be,jef->jbf", self.embed, self.kernel).astype(np.float32)

    def pooled(self, b: Blocks) -> tuple[np.ndarray, np.ndarray]:
        """Each block's best rectified response by filter, and the window it stands at."""
        pairs, bias, m = self.pairs or tabulated(self.filters()), self.bias.astype(np.float32), len(b.valid)
        best, at = np.zeros((m, FILTERS), np.float32), np.zeros((m, FILTERS), np.int16)
        # Only maxima stay, so responses exist for some blocks at a time.
        for k in range(0, m, PART_BLOCKS):
            end = min(m, k + PART_BLOCKS)
            r = responses(b.data[k * BLOCK_BYTES : end * BLOCK_BYTES + WIDTH], pairs, bias)
            # A text that isn't a whole number of blocks must not see what follows it.
            r[~b.valid[k:end]] = 0
            at[k:end] = r.argmax(axis=1)
            best[k:end] = np.maximum(np.take_along_axis(r, at[k:end, None, :].astype(np.intp), axis=1)[:, 0, :], 0)
        return best, at

    def features(self, b: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        best, at = self.pooled(b)
        # Chunks: a block with the next one of the same text, or alone at the end of a text of one.
        last = np.zeros(len(best), bool)
        last[b.first + b.count - 1] = True
        other = np.where(last, np.arange(len(best)), np.arange(len(best)) + 1)
        pick = np.where((best[other] > best), other[:, None], np.arange(len(best))[:, None])
        chunk = np.take_along_axis(best, pick, axis=0)
        used = ~last | (np.repeat(b.count, b.count) == 1)
        weight = used.astype(np.float64)
        n_chunks = np.maximum(1, b.count - 1)
        mean = np.add.reduceat(chunk * weight[:, None], b.first, axis=0) / n_chunks[:, None]
        peak = np.maximum.reduceat(best, b.first, axis=0)
        return np.hstack((mean, peak, np.ones((len(mean), 1)))), best, at, pick

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        if self.pairs is None:
            self.pairs = tabulated(self.filters())
        return sigmoid(self.features(lay_out(column))[0] @ self.head)


def fit(texts: list[str], labels: list[int], batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (256, EMBEDDED)), rng.normal(0, 1 / np.sqrt(WIDTH * EMBEDDED) * 2, (WIDTH, EMBEDDED, FILTERS)), np.zeros(FILTERS), np.zeros(2 * FILTERS + 1)
    )
    net.embed[0] = 0
    y_all = np.array(labels, float)
    if len(y_all) == 0 or y_all.min() == y_all.max():
        net.constant = float(y_all.mean()) if len(y_all) else 0.0
        return net
    kept = first_of_kind(texts)
    texts, y_all = [texts[i] for i in kept], y_all[kept]
    net.head[:-1] = rng.normal(0, 0.1, 2 * FILTERS)
    columns = pa.array(texts, pa.large_string())
    parameters = {"embed": net.embed, "kernel": net.kernel, "bias": net.bias, "head": net.head}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in parameters.items()}
    step = 0
    epochs = int(np.clip(24_000 / len(texts), 8, 40))
    share = np.where(y_all == 1, 0.5 / y_all.mean(), 0.5 / max(1e-9, 1 - y_all.mean())) ** 0.5
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(texts), batch):
            ids = order[k : k + batch]
            b = lay_out(columns.take(pa.array(ids)))
            x, best, at, pick = net.features(b)
            g = (sigmoid(x @ net.head) - y_all[ids]) * share[ids] / len(ids)
            grad = {"head": x.T @ g + 1e-4 * net.head}
            # Back to the blocks: a mean's gradient goes to each chunk's winning block, a maximum's to the best one.
            d = np.zeros_like(best, dtype=np.float64)
            row = np.repeat(np.arange(len(ids)), b.count)
            last = np.zeros(len(best), bool)
            last[b.first + b.count - 1] = True
            used = ~last | (b.count[row] == 1)
            each = (g[:, None] * net.head[None, :FILTERS] / np.maximum(1, b.count - 1)[:, None])[row]
            cols = np.broadcast_to(np.arange(FILTERS), pick.shape)
            np.add.at(d, (pick[used], cols[used]), each[used])
            peak = np.maximum.reduceat(best, b.first, axis=0)
            is_peak = (best == peak[row]) & (best > 0)
            ties = np.maximum(1, np.add.reduceat(is_peak, b.first, axis=0))
            d += is_peak * (g[:, None] * net.head[None, FILTERS:-1] / ties)[row]
            d[best <= 0] = 0
            blk, fil = np.nonzero(d)
            dv = d[blk, fil]
            begin = blk * BLOCK_BYTES + at[blk, fil] * STRIDE
            dk, de = np.zeros_like(net.kernel), np.zeros_like(net.embed)
            for j in range(WIDTH):
                byte = b.data[begin + j]
                ef = np.zeros((256, FILTERS))
                np.add.at(ef, (byte, fil), dv)
                dk[j] = net.embed.T @ ef
                de += ef @ net.kernel[j].T
            de[0] = 0
            grad |= {"kernel": dk + 1e-5 * net.kernel, "embed": de, "bias": np.bincount(fil, weights=dv, minlength=FILTERS)}
            step += 1
            for name, p in parameters.items():
                m, v = moments[name]
                m += 0.1 * (grad[name] - m)
                v += 0.001 * (grad[name] ** 2 - v)
                p -= rate * (1 - epoch / epochs / 1.2) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", rows: int = 3000, max_bytes: int = 16_384) -> Network:
    return fit(*labelled_sample(docs, labels, label, usable, rows, max_bytes))


def score_quality(docs: DataFrame, network: Network, keys: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = 0.7) -> DataFrame:
    """keys, score (0 to 1) and predicted (1 if score >= threshold) of every row."""
    schema = docs.select(*keys).schema.add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                score = shared.value.scores(part.column(text))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return small_batches(docs.select(*dict.fromkeys((*keys, text)))).mapInArrow(run, schema)


def keep_quality(docs: DataFrame, network: Network, threshold: float, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that score at least threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(shared.value.scores(part.column(text)) >= threshold))

    return small_batches(docs).mapInArrow(run, docs.schema)
