"""Near-duplicate documents by order min-hashing and banded alignment.

Texts are lower-cased words (runs of ASCII letters and digits and of all non-ASCII characters).
Their k-mers are runs of five words (a text of fewer words is one k-mer), each labelled with its
occurrence number in the text. For each of `SKETCHES` random orders a text keeps its `MINIMA`
smallest k-mers *in the order in which they stand in the text*; equal ordered tuples put texts into
one bucket. Because order counts, agreement follows edit similarity rather than set overlap. For
texts that share a part j of their k-mers a sketch agrees with probability of about j ** 3: at
j = 0.8 all 32 sketches miss a pair once in 10 ** 9 or so.

Candidates are texts that share a bucket; they are linked when their word edit distance, found
inside a band, is at most ``1 - threshold`` of the longer one's words. Exact copies count once from
the start. Every pair of a bucket is decided, in an order that leaves few of them to test:

* first each member of a bucket is tested against one representative, and what is linked becomes one
  part (a connected component). Only buckets that still hold several parts go on;
* while that finds links and many pairs remain, one speaker of each part is tested against another
  representative;
* then `settled` tests every remaining pair of a bucket that lies in different parts. The texts of
  small buckets share cells of bounded size; a large bucket is dealt in blocks over many cells, and
  large buckets that hold the same texts are dealt together, so that a text travels once for each
  block it meets. Only links leave a cell. This step is the one part whose work grows with the
  square of something: the texts of a bucket that stay in different parts.

Buckets with a third of all rows are pre-aggregated minima and joins that Spark can split; no group
is ever collected.

Results: one row per document with class_id and class_size. class_id is the smallest doc_id of the class; a
class without any id, or whose smallest id names another class already (where ids repeat), is named by a
64-bit hash, so that no two classes share a name. A row with a null text is a class of its own, named by its
id, null ids included; texts without words are only ever equal to exact copies; repeated rows are copies.
Ties cannot arise:
classes are components, whatever the order of tests. An empty table gives an empty result. Very long
texts take memory in proportion to their length (`edit_distance` says how long they take). Extra
columns are not read by `near_duplicates` and pass `drop_near_duplicates` untouched, whatever their
names. A text is named by its 64-bit hash: among ten billion distinct texts about three would meet by
chance.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow_text import joined, mix, range_hashes, slices, small_batches
from linkloom.operators.components import chained, connected_components, extended
from linkloom.operators.materialize import Scratch, few, saved

K, SKETCHES, MINIMA = 5, 32, 3
THRESHOLD = 0.8
#: Bytes of text in one cell of `settled`, about (a cell of two blocks holds twice as much).
CELL_BYTES = 1 << 21
#: Rounds with speakers go on while at least one test in so many finds a link and at least so many
#: pairs a row are left.
FRUITFUL, MANY = 10, 4
#: Words of a block of `Places`.
BLOCK = 2048
#: The first band of an alignment; each further one is four times as wide.
BAND = 32
#: Sides of joins up to this many rows of a few numbers are broadcast.
BROADCAST_ROWS = 200_000

_is_word = np.zeros(256, bool)
_is_word[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
_ODD = mix(np.arange(101, 101 + max(K, MINIMA, SKETCHES), dtype=np.uint64)) | np.uint64(1)
_SALT = mix(np.arange(501, 501 + SKETCHES, dtype=np.uint64))
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def kmers(column: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per row, and row and hash of all occurrence-labelled k-mers in text order."""
    data, starts, _ = joined(pc.utf8_lower(column))
    edge = np.diff(np.concatenate(([False], _is_word[data], [False])).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    w_row = np.searchsorted(starts, begin, side="right") - 1
    n_words = np.bincount(w_row, minlength=len(starts))
    with np.errstate(over="ignore"):
        h = range_hashes(data, begin, end)
        m = max(0, len(h) - k + 1)
        sums = np.zeros(m, np.uint64)
        for j in range(k):
            sums += h[j : j + m] * _ODD[j]
        whole = np.flatnonzero(w_row[:m] == w_row[len(w_row) - m :])
        short = np.flatnonzero((n_words > 0) & (n_words < k))
        first = np.searchsorted(w_row, short)
        few = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            there = n_words[short] > j
            few[there] += h[first[there] + j] * _ODD[j]
        row = np.concatenate((w_row[whole], short))
        code = mix(np.concatenate((sums[whole], few + n_words[short].astype(np.uint64))))
        order = np.argsort(row, kind="stable")
        row, code = row[order], code[order]
        # The occurrence number of each k-mer within its row.
        by = np.lexsort((code, row))
        new = np.ones(len(by), bool)
        new[1:] = (row[by][1:] != row[by][:-1]) | (code[by][1:] != code[by][:-1])
        nth = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        occurrence = np.empty(len(by), np.uint64)
        occurrence[by] = nth
        return n_words, row, mix(code + occurrence * np.uint64(0x9E3779B97F4A7C15))


def sketch(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Words per row and, for rows with words, the hashes of the ordered minima of each sketch."""
    n_words, row, code = kmers(column)
    if not len(row):
        return n_words, [None] * len(n_words)
    rows, first, count = np.unique(row, return_index=True, return_counts=True)
    out = np.empty((len(rows), SKETCHES), np.uint64)
    with np.errstate(over="ignore"):
        for s in range(SKETCHES):
            v = (code ^ _SALT[s]) * _ODD[s]
            places = np.full((MINIMA, len(rows)), len(v))
            for j in range(MINIMA):
                least = np.minimum.reduceat(v, first)
                at = np.flatnonzero(v == np.repeat(least, count))
                at = at[np.searchsorted(at, first)]
                has = count > j
                places[j, has] = at[has]
                v[at] = _LAST
            places.sort(axis=0)
            total = np.full(len(rows), _SALT[s])
            for j in range(MINIMA):
                there = places[j] < len(v)
                total[there] += code[places[j][there]] * _ODD[j]
            out[:, s] = mix(total)
    signs: list[np.ndarray | None] = [None] * len(n_words)
    for r, x in zip(rows.tolist(), out.view(np.int64)):
        signs[r] = x
    return n_words, signs


class Places:
    """Where each word of a sequence stands, as bits by blocks of `BLOCK` places, so that memory follows
    the sequence's length whatever it holds."""

    def __init__(self, words: list):
        found: dict = {}
        for i, x in enumerate(words):
            block, at = divmod(i, BLOCK)
            blocks, bits = found.setdefault(x, ([], []))
            if blocks and blocks[-1] == block:
                bits[-1] |= 1 << at
            else:
                blocks.append(block)
                bits.append(1 << at)
        self.found = found

    def within(self, word, start: int, width: int) -> int:
        """Bit t is set where the word stands at start + t, for t below width or a little more."""
        blocks, bits = self.found.get(word, ((), ()))
        out = 0
        for k in range(bisect_left(blocks, start // BLOCK), bisect_right(blocks, (start + width - 1) // BLOCK)):
            shift = blocks[k] * BLOCK - start
            out |= bits[k] << shift if shift >= 0 else bits[k] >> -shift
        return out


def edit_distance(a: list, b: list, limit: int) -> int:
    """The edit distance of two sequences if it is at most limit, else limit + 1.

    What the ends share is cut off, then bands of growing width are tried. n words with d edits take
    about n * d / 64 machine steps: half a million words with a few hundred edits some seconds, with
    an edit in every fifth word a few minutes; memory follows n."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return limit + 1
    if not b or limit == 0:
        return len(a) if len(a) <= limit else limit + 1
    places = Places(a)
    band = min(limit, len(a), max(BAND, len(a) - len(b)))
    while (found := banded(len(a), b, places, band)) > band < min(limit, len(a)):
        band = min(limit, len(a), 4 * band)
    return min(found, limit + 1)


def banded(rows: int, b: list, places: Places, band: int) -> int:
    """The edit distance of b and a sequence of at least its length if it is at most band, else more.

    Bit-parallel over a band of diagonals: a column's vertical differences inside the band are the
    bits of two integers, and the band moves down one row with each column."""
    width = 2 * band + 1
    mask = (1 << width) - 1
    # Bit width - 1 is the band's last row; the score follows that row down to the end of the longer
    # sequence, then its last row to the end of b.
    positive, negative, score = mask >> band << band & mask, 0, band
    corner, along = 1 << (width - 1), 1 << (width - 2)
    shift = band + 1 - width
    for j, x in enumerate(b):
        met = places.within(x, shift, width) & mask
        shift += 1
        diagonal = ((((met & positive) + positive) ^ positive) | met | negative) & mask
        up = negative | ~(diagonal | positive) & mask
        down = diagonal & positive
        if j < rows - band:
            score += not diagonal & corner
        else:
            score += bool(up & along) - bool(down & along)
            along >>= 1
        positive = (down | ~((diagonal >> 1) | up)) & mask
        negative = (diagonal >> 1) & up
    return score


Words = tuple[list[str], Counter]


def words_of(text: str) -> Words:
    words = _WORD.findall(text.lower())
    return words, Counter(words)


def similar(left: Words, right: Words, threshold: float) -> bool:
    """Whether the word edit distance is at most 1 - threshold of the longer text's words."""
    (a, bag_a), (b, bag_b) = left, right
    longest = max(len(a), len(b))
    limit = int((1 - threshold) * longest + 1e-9)
    if abs(len(a) - len(b)) > limit or longest - (bag_a & bag_b).total() > limit:
        return False
    return edit_distance(a, b, limit) <= limit


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """node (the text's hash), id, bytes, words and sketch (null without words) of every row."""
    rows = docs.select(F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))).alias("node"), F.col(key).cast("long").alias("id"), F.octet_length(text).cast("long").alias("bytes"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, signs = sketch(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n_words.astype(np.int32)), pa.array(signs, pa.list_(pa.int64()))], names=["node", "id", "bytes", "words", "sketch"])

    return small_batches(rows).mapInArrow(run, "node long, id long, bytes long, words int, sketch array<long>")


class Texts:
    """The distinct texts of docs and their nodes table: node, id, bytes, words, sketch."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, key: str, text: str):
        self.docs, self.nodes, self.key, self.text = docs, nodes, key, text

    def of(self, wanted: DataFrame) -> DataFrame:
        """node, text of the wanted nodes. wanted must be cheap to count."""
        wanted = wanted.join(self.nodes.select("node", F.col("id").alias("__id")), "node")
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        rows = self.docs.select(F.xxhash64(F.col(self.text)).alias("node"), F.col(self.key).cast("long").alias("__own"), F.col(self.text).alias("text")).where(F.col("text").isNotNull())
        # A row of the smallest id, so copies stay where they are; repeated rows are one.
        return rows.join(wanted, "node").where(F.col("__own").eqNullSafe(F.col("__id"))).groupBy("node").agg(F.first("text").alias("text"))


def fits(threshold: float, *words: str) -> Column:
    return F.least(*words) >= F.lit(threshold) * F.greatest(*words) - 1e-9


def verified(pairs: DataFrame, texts: Texts, threshold: float) -> DataFrame:
    """The pairs (node, head) of which the texts are similar. pairs must be distinct and cheap to read twice."""
    found = texts.of(pairs.select("node").union(pairs.select("head")).distinct())
    left = pairs.join(found, "node").select("node", "head", F.col("text").alias("left"))
    both = left.join(found.select(F.col("node").alias("head"), F.col("text").alias("right")), "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pairs of one head mostly come together: its words are taken once.
        last, words = None, None
        for batch in batches:
            for part in slices(batch, "left"):
                ok = []
                for head, x, y in zip(part.column("head").to_pylist(), part.column("left").to_pylist(), part.column("right").to_pylist()):
                    if head != last:
                        last, words = head, words_of(y)
                    ok.append(similar(words_of(x), words, threshold))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("head")], names=["node", "head"]).filter(pa.array(ok, pa.bool_()))

    return small_batches(both.select("node", "head", "left", "right")).mapInArrow(run, "node long, head long")


class Bags:
    """The words of texts as numbers, one for each occurrence, so that what one text has in common with many others is
    counted at once. No text is without words."""

    def __init__(self, texts: list[list[str]]):
        self.size = np.array([len(t) for t in texts])
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        known: dict[str, int] = {}
        word = np.array([known.setdefault(w, len(known)) for t in texts for w in t], np.int64)
        row = np.repeat(np.arange(len(texts)), self.size)
        by = np.lexsort((word, row))
        new = np.ones(len(by), bool)
        new[1:] = (row[by][1:] != row[by][:-1]) | (word[by][1:] != word[by][:-1])
        nth = np.empty(len(by), np.int64)
        nth[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        names, self.ids = np.unique(word * (nth.max(initial=0) + 1) + nth, return_inverse=True)
        self.there = np.zeros(len(names), bool)

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """How many words text x shares with each of the others, repeated ones counted as often as both have them."""
        own = self.ids[self.start[x] : self.start[x + 1]]
        self.there[own] = True
        size = self.size[others]
        first = np.cumsum(size) - size
        hits = self.there[self.ids[np.repeat(self.start[others] - first, size) + np.arange(size.sum())]]
        self.there[own] = False
        return np.add.reduceat(hits, first, dtype=np.int64)


def links_in(cell: pa.Table, threshold: float) -> pa.Table:
    """The links of a cell that join different parts: pairs of one group that share a sketch."""
    part, place, block = (cell.column(c).to_numpy() for c in ("part", "place", "block"))
    node, group = cell.column("node").to_numpy(), cell.column("group").to_numpy()
    signs = cell.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    words = [words_of(t) for t in cell.column("text").to_pylist()]
    bags = Bags([w for w, _ in words])
    size = bags.size
    across = len(node) > 0 and bool(cell.column("i")[0].as_py() != cell.column("j")[0].as_py())
    root = {p: p for p in part.tolist()}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = p = root[root[p]]
        return p

    found: list[tuple[int, int]] = []
    order = np.lexsort((node, group))
    for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        for k, x in enumerate(at[:-1].tolist()):
            rest = at[k + 1 :]
            rest = rest[(part[rest] != part[x]) & (np.minimum(size[rest], size[x]) >= threshold * np.maximum(size[rest], size[x]) - 1e-9)]
            if across:
                rest = rest[block[rest] != block[x]]
            agree = signs[rest] == signs[x]
            # A pair of a bucket is tested under the first sketch in which it agrees.
            rest = rest[agree.any(axis=1) & ((place[x] < 0) | (agree.argmax(axis=1) == place[x]))]
            if len(rest):
                # Most pairs share too few words to be similar.
                longest = np.maximum(size[rest], size[x])
                rest = rest[longest - bags.common(x, rest) <= ((1 - threshold) * longest + 1e-9).astype(np.int64)]
            for y in rest.tolist():
                p, q = find(int(part[x])), find(int(part[y]))
                if p != q and similar(words[x], words[y], threshold):
                    root[p] = q
                    found.append((int(node[x]), int(node[y])))
    return pa.table({"node": pa.array([x for x, _ in found], pa.int64()), "head": pa.array([y for _, y in found], pa.int64())})


def settled(left: DataFrame, texts: Texts, threshold: float, scratch: Scratch) -> DataFrame:
    """node, head: links that join all parts that any similar pair of a bucket in left would join."""
    n = left.count()
    sizes = scratch.keep(few(left.groupBy("bucket").agg(F.sum("bytes").alias("held")), n))
    total = sizes.where(F.col("held") <= CELL_BYTES).agg(F.sum("held")).first()[0] or 0
    whole = left.join(sizes.where(F.col("held") <= CELL_BYTES), "bucket")
    cells = whole.select(F.pmod(F.xxhash64("bucket"), F.lit(1 + total // CELL_BYTES)).alias("cell"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("block"), F.col("bucket").alias("group"), "place", "node", "part")
    large = scratch.keep(few(left.join(sizes.where(F.col("held") > CELL_BYTES).select("bucket"), "bucket"), n))
    if not large.isEmpty():
        # Large buckets with common texts are one group. A text has at most `SKETCHES` of them, and they are far fewer than texts.
        same = connected_components(few(chained(large, "node", "bucket"), n), "a", "b", scratch).select(F.col("node").alias("bucket"), F.col("component").alias("named"))
        if same.count() <= BROADCAST_ROWS:
            same = F.broadcast(same)
        members = large.groupBy("node", "part", "bytes").agg(F.min("bucket").alias("bucket")).join(same, "bucket", "left")
        members = members.select("node", "part", "bytes", F.coalesce("named", "bucket").alias("group"))
        blocks = members.groupBy("group").agg((1 + F.floor(F.sum("bytes") / CELL_BYTES)).cast("int").alias("n"))
        members = members.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("n")).cast("int"))
        other = members.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        cells = cells.unionByName(other.select(F.col("group").alias("cell"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "group", F.lit(-1).alias("place"), "node", "part"))
    cells = scratch.keep(cells)
    found = texts.of(cells.select("node").distinct())
    full = cells.join(texts.nodes.select("node", "sketch"), "node").join(found, "node")
    return full.groupBy("cell", "i", "j").applyInArrow(lambda cell: links_in(cell, threshold), "node long, head long")


def first_parts(links: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """node, component of links of texts with at most `SKETCHES` heads each: a text is linked to its first head, and its
    heads, which many texts have in common, to each other once."""
    ends = links.groupBy("node").agg(F.min("head").alias("head")).unionByName(chained(links, "node", "head").toDF("node", "head"))
    return connected_components(few(ends, n), "node", "head", scratch)


def components(texts: Texts, threshold: float, scratch: Scratch) -> DataFrame:
    """node, component of every text that is linked to another."""
    rows = texts.nodes.where(F.col("sketch").isNotNull()).select("node", "bytes", "words", F.posexplode("sketch").alias("place", "bucket"))
    heads = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("node", "words")).alias("head")).where("n > 1").drop("n")
    # Only buckets of several texts matter.
    shared = scratch.keep(few(rows.join(heads, "bucket"), SKETCHES * texts.nodes.count()))
    n_shared = shared.count()
    pairs = shared.where((F.col("node") != F.col("head.node")) & fits(threshold, "words", "head.words")).select("node", F.col("head.node").alias("head")).distinct()
    parts, left, turn = None, shared, 0
    while True:
        pairs = scratch.keep(few(pairs, n_shared))
        new = scratch.keep(verified(pairs, texts, threshold))
        tested, n = pairs.count(), new.count()
        parts = first_parts(new, n_shared, scratch) if parts is None else extended(parts, new, "node", "head", scratch)
        rows = left.select("bucket", "place", "node", "bytes", "words").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        sums = rows.groupBy("bucket", "part").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"))
        sums = scratch.keep(few(sums.where("parts > 1"), n_shared))
        n_left, n_pairs = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("n") - F.col("within")), F.lit(0)) / 2).first()
        if n_left == 0:
            return parts
        left = scratch.keep(few(rows.join(sums.select("bucket"), "bucket"), n_left))
        if n_pairs <= MANY * n_left or n * FRUITFUL < tested:
            break
        turn += 1
        # Another speaker and representative each time: the least under a mask.
        mask = F.xxhash64(F.lit(turn))
        spoken = left.groupBy("bucket", "part").agg(F.min(F.struct(F.col("node").bitwiseXOR(mask).alias("name"), "words", "part")).alias("s"))
        heads = spoken.groupBy("bucket").agg(F.min("s").alias("h"))
        met = spoken.join(heads, "bucket").where((F.col("s.part") != F.col("h.part")) & fits(threshold, "s.words", "h.words"))
        pairs = met.select(F.col("s.name").bitwiseXOR(mask).alias("node"), F.col("h.name").bitwiseXOR(mask).alias("head")).distinct()
    last = scratch.keep(settled(left, texts, threshold, scratch))
    return extended(parts, last, "node", "head", scratch)


def text_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """node, component, class_id, class_size, least_id (of the class, null if it has none) and least_node
    (the text of that id with the least hash) of every distinct text."""
    scratch = Scratch(docs.sparkSession)
    prints = fingerprints(docs, key, text).where(F.col("node").isNotNull())
    nodes = scratch.keep(prints.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("bytes", "words", "sketch")]))
    parts = components(Texts(docs, nodes, key, text), threshold, scratch)
    small = nodes.select("node", "id", "copies").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = small.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("least"), F.sum("copies").alias("class_size"))
    n = nodes.count()
    classes = scratch.keep(few(classes.select("component", F.col("least.id").alias("least_id"), F.col("least.node").alias("least_node"), "class_size"), n))
    # Where ids repeat, classes may share their smallest one: the first by hash has it as its name.
    named = classes.where("least_id IS NOT NULL").groupBy("least_id").agg(F.min("component").alias("component")).select("component", F.col("least_id").alias("own_name"))
    named = classes.join(named, "component", "left").withColumn("class_id", F.coalesce("own_name", "component")).drop("own_name")
    out = saved(few(small.select("node", "component").join(named, "component"), n))
    scratch.clear()
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, class_id, class_size and is_kept (whether the row is its class's representative: its smallest id;
    repeated rows all are)."""
    classes = text_classes(docs, key, text, threshold)
    rows = docs.select(F.col(key).alias("own"), F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))).alias("name"))
    out = rows.join(classes, F.col("name") == F.col("node"), "left")
    alone = F.col("node").isNull()
    class_id = F.when(alone, F.col("own").cast("long")).otherwise(F.col("class_id"))
    kept = alone | ((F.col("node") == F.col("least_node")) & F.col("own").cast("long").eqNullSafe(F.col("least_id")))
    return out.select(F.col("own").alias(key), class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), kept.alias("is_kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of the smallest id (if that id has several texts, the one with the least
    hash; any one of repeated rows), with all its columns."""
    classes = text_classes(docs, key, text, threshold).where("class_size > 1").select("node", "component", "least_id", "least_node")
    if classes.count() <= BROADCAST_ROWS:
        classes = F.broadcast(classes)
    rows = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("own"), F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))).alias("name"))
    rows = rows.join(classes, F.col("name") == F.col("node"), "left")
    alone = rows.where(F.col("node").isNull())
    chosen = rows.where((F.col("node") == F.col("least_node")) & F.col("own").eqNullSafe(F.col("least_id"))).dropDuplicates(["component"])
    return alone.unionByName(chosen).select("row.*")
