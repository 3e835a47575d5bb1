"""Shapes that encoders take and give, on array columns: padding, batches and span vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the greatest width that has a feature row of its own.
WIDEST = 4
#: Fixed value: the attention score of a token that scores nothing.
UNSEEN = -9e9


def padded(pieces: Column, length: int, filler: Column) -> tuple[Column, Column]:
    """Pieces cut or filled up to a length, and a mask of 1 for pieces and 0 for filler."""
    kept = F.slice(pieces, 1, length)
    lack = F.lit(length) - F.size(kept)
    return F.concat(kept, F.array_repeat(filler, lack)), F.concat(F.array_repeat(F.lit(1), F.size(kept)), F.array_repeat(F.lit(0), lack))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def attention(vectors: Column, hidden: Sequence[tuple[Sequence[float], float]], out: tuple[Sequence[float], float]) -> Column:
    """Softmax of the tokens' scores by one hidden layer of rectified units (weights, bias each)."""
    unit = lambda v, w, b: F.greatest(dot(v, F.array(*map(F.lit, w))) + F.lit(b), F.lit(0.0))
    raw = lambda v: sum((F.lit(float(o)) * unit(v, *h) for o, h in zip(out[0], hidden)), F.lit(float(out[1])))
    scores = F.transform(vectors, lambda v: F.when(raw(v) == 0, UNSEEN).otherwise(raw(v)))
    powers = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(powers, F.lit(0.0), lambda s, p: s + p)
    return F.transform(powers, lambda p: p / total)


def span_vectors(spans: DataFrame, vectors: str, shares: str, widths: Sequence[Sequence[float]], dims: int) -> DataFrame:
    """Adds ``embedding``: the vectors of a span's first and last token, the sum of all weighted by
    ``shares``, and the feature row of its width (in tokens less one, at most ``WIDEST``)."""
    weighted = F.zip_with(vectors, shares, lambda v, p: F.transform(v, lambda x: x * p))
    total = F.aggregate(weighted, F.array_repeat(F.lit(0.0), dims), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    width = F.get(F.array(*[F.array(*map(F.lit, row)) for row in widths]), F.least(F.size(vectors) - 1, F.lit(WIDEST)))
    return spans.withColumn("embedding", F.concat(F.get(vectors, F.lit(0)), F.element_at(vectors, -1), total, width))


def batch_segments(pairs: DataFrame, place: str, size: int, segments: Sequence[str]) -> DataFrame:
    """batch, segment: the segments that the pairs of each batch of ``size`` need, each once."""
    named = pairs.select(F.floor(F.col(place) / size).alias("batch"), F.explode(F.array(*segments)).alias("segment"))
    return named.distinct()
