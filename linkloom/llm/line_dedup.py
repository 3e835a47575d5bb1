"""Lines that many documents repeat, dropped everywhere but in one, by a sharded minimal perfect hash.

A line's key is the line without white space (space, tab to carriage return) at both ends and with A-Z
lower-cased; keys of fewer than `MIN_CHARS` code points are left alone. A key is known by its 128-bit
hash. The hashes of all keys that reach `min_docs` documents go into shards. Each shard is one row: the
bit levels of a minimal perfect hash, and arrays of fingerprints, document counts and keeping documents
in the order of its slots. The other half of a key's hash is its fingerprint, so a line that is in no
shard passes for one that is with a probability of 2 ** -64.

Documents lie in blocks of about `BLOCK_BYTES` of text. A block probes each shard once for each different
key that it holds, however many of its documents do, and only hits come back to it; lines and texts are
never joined. So a line that stands in a third of all documents is one probe a block. Shards are as many
as keep their probes near `SHARD_PROBES`, blocks as many as their bytes ask for; nothing is broadcast.

Cases: a document is a row, so repeated rows count as often as they come. The keeping document is the
largest id that holds the key; every row of that id keeps its lines, repeated ones included. Null ids
count as documents and keep a line only where no row with an id has it (then all of them do). Null and
empty texts are one empty line. An empty table gives an empty result. Very long texts take memory in
proportion to their length. Extra columns of any name are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow_text import mix, slices, small_batches
from linkloom.operators.materialize import Scratch, saved

MIN_CHARS, MIN_DOCS = 40, 5
#: Text of one block of documents, and probes of one shard, about.
BLOCK_BYTES, SHARD_PROBES = 1 << 22, 1 << 17
#: Slots of a level for each key that comes to it.
ROOM = 2
_WHITE = b" \t\n\x0b\x0c\r"

Hashes = tuple[np.ndarray, np.ndarray]


def key_hash(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key, None where the key is too short."""
    key = line.strip(_WHITE).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def halves(digests: list[bytes]) -> Hashes:
    pairs = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def slots(lo: np.ndarray, hi: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(lo + mix(hi ^ np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of different keys: each level is a bit map of slots that one key alone
    takes, keys that meet go on to the next, and a key's number is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ends = np.cumsum([0, *(x.sum() for x in levels)])
        self.ranks = [start + np.cumsum(bits) - 1 for start, bits in zip(ends, levels)]

    @classmethod
    def of(cls, lo: np.ndarray, hi: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(lo):
            size = max(8, ROOM * len(lo))
            at = slots(lo, hi, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            lo, hi = lo[~bits[at]], hi[~bits[at]]
        return cls(levels)

    def numbers(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The number of each key; of a key that was not there some number, or -1."""
        out, left = np.full(len(lo), -1), np.arange(len(lo))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = slots(lo[left], hi[left], level, len(bits))
            out[left[bits[at]]] = ranks[at[bits[at]]]
            left = left[~bits[at]]
        return out

    def packed(self) -> tuple[list[int], bytes]:
        return [len(x) for x in self.levels], np.packbits(np.concatenate([np.zeros(0, bool), *self.levels])).tobytes()

    @classmethod
    def unpacked(cls, sizes: list[int], bits: bytes) -> PerfectHash:
        flat = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        return cls(np.split(flat[: sum(sizes)], np.cumsum(sizes)[:-1]) if sizes else [])


SHARD = "shard long, sizes array<int>, bits binary, fingerprints binary, counts binary, keepers binary, named binary"


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def shard(keys: pa.Table) -> pa.Table:
    """One shard's row from its keys: shard, lo, hi, n, top."""
    lo, hi = column(keys, "lo").view(np.uint64), column(keys, "hi").view(np.uint64)
    hashed = PerfectHash.of(lo, hi)
    order = np.argsort(hashed.numbers(lo, hi))
    sizes, bits = hashed.packed()
    named = ~np.asarray(keys.column("top").is_null())
    keepers = keys.column("top").fill_null(0).to_numpy()
    row = [keys.column("shard")[0].as_py(), sizes, bits, hi[order].tobytes(), column(keys, "n")[order].tobytes(), keepers[order].tobytes(), named[order].tobytes()]
    kinds = [pa.int64(), pa.list_(pa.int32()), *[pa.binary()] * 5]
    return pa.table([pa.array([x], t) for x, t in zip(row, kinds)], names=["shard", "sizes", "bits", "fingerprints", "counts", "keepers", "named"])


def hits(probes: pa.Table, shards: pa.Table) -> pa.Table:
    """block, lo, hi, n and top of the probes whose key is in the shard."""
    lo, hi = column(probes, "lo").view(np.uint64), column(probes, "hi").view(np.uint64)
    at, n, top, named = np.full(len(lo), -1), np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, bool)
    if shards.num_rows:
        s = shards.to_pylist()[0]
        prints, n, top, named = (np.frombuffer(s[c], t) for c, t in (("fingerprints", np.uint64), ("counts", np.int64), ("keepers", np.int64), ("named", bool)))
        at = PerfectHash.unpacked(s["sizes"], s["bits"]).numbers(lo, hi)
        at = np.where((at >= 0) & (prints[at] == hi), at, -1)
    known = at >= 0
    found, at = probes.filter(pa.array(known)), at[known]
    return pa.table({c: found.column(c).combine_chunks() for c in ("block", "lo", "hi")} | {"n": pa.array(n[at]), "top": pa.array(top[at], mask=~named[at])})


def line_index(held: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """The shards over all keys of held (lo, hi, n, top) that reach min_docs documents."""
    keys = held.groupBy("lo", "hi").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where(F.col("n") >= min_docs)
    return keys.select(F.pmod("lo", F.lit(shards)).alias("shard"), "lo", "hi", "n", "top").groupBy("shard").applyInArrow(shard, SHARD)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """key, text without the dropped lines (null stays null), n_lines (before) and n_dropped of every row."""
    scratch = Scratch(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    block = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 + total // BLOCK_BYTES))
    rows = docs.select(block.alias("block"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def hashed(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found, at = [], []
                for i, raw in enumerate(part.column("text").cast(pa.large_binary()).to_pylist()):
                    own = {h for h in (key_hash(x, min_chars) for x in (raw or b"").split(b"\n")) if h is not None}
                    found.extend(own)
                    at.extend([i] * len(own))
                lo, hi = halves(found)
                part = part.select(["block", "id"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64))], names=["block", "id", "lo", "hi"])

    lines = small_batches(rows).mapInArrow(hashed, "block long, id long, lo long, hi long")
    held = scratch.keep(lines.groupBy("block", "lo", "hi").agg(F.count("*").alias("n"), F.max("id").alias("top")))
    shards = 1 + held.count() // SHARD_PROBES
    index = line_index(held, shards, min_docs)
    probes = held.select(F.pmod("lo", F.lit(shards)).alias("shard"), "block", "lo", "hi")
    found = probes.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(hits, "block long, lo long, hi long, n long, top long")
    found = saved(found)
    scratch.clear()

    def cleaned(texts: pa.Table, hit: pa.Table) -> pa.Table:
        raw = np.column_stack([column(hit, c) for c in ("lo", "hi")]).astype(">i8").tobytes()
        keeper = dict(zip((raw[k : k + 16] for k in range(0, len(raw), 16)), hit.column("top").to_pylist()))
        kept, n_lines, n_dropped = [], [], []
        for own, raw in zip(texts.column("id").to_pylist(), texts.column("text").cast(pa.large_binary()).to_pylist()):
            split = (raw or b"").split(b"\n")
            stay = [x for x in split if (h := key_hash(x, min_chars)) not in keeper or keeper[h] == own] if keeper else split
            kept.append(None if raw is None else b"\n".join(stay))
            n_lines.append(len(split))
            n_dropped.append(len(split) - len(stay))
        return pa.table({"id": texts.column("id"), "text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})

    out = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cleaned, "id long, text string, n_lines long, n_dropped long")
    return out.select(F.col("id").alias(key), F.col("text").alias(text), "n_lines", "n_dropped")
