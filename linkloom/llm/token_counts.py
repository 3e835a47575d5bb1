"""Token counts by a compiled finite-state tokenizer.

A byte-pair vocabulary in which a pair may merge whenever its concatenation is a piece has a local
characterisation: a segmentation is the tokenizer's output exactly if every piece is reached by
merging its own characters and every two neighbours stay apart when tokenized together. So the
last piece of the output for a prefix follows from the last pieces at the few earlier positions
from which a piece can still be completed. Those positions, their last pieces and their counts
relative to the present one are a finite state. `Transducer` interns these states on demand
(transitions are built when text first takes them, as in lazy regular-expression automata) and
annotates each transition with the tokens it emits: the change of the count, which can be negative
when a longer piece absorbs earlier ones.

Texts are cut into chunks that run in lockstep, one character of every chunk per numpy step. A chunk's
state map sends entry states to exit states, with the tokens emitted on the way. It is computed for
the states in which the chunk can be entered: at first one guess, taken from a warm-up over the
characters before it, then every exit state of the map before it, until each map's exits are entries
of the next one. Pieces forget most of what lies before them, so one or two passes do for prose. A
run of one character may remember its beginning, but its states recur: from the third pass on a
missing entry is tried in twice as many chunks each time, so passes grow with the logarithm of the
run. The maps, now total functions between small sets, are composed by a parallel
prefix scan, in a number of steps that grows with the logarithm of the number of chunks; it gives
every chunk its true entry state. A text's count is the sum of its transitions' annotations.

Null and empty texts have no tokens. Very long texts are cut like all others and cost what their
length costs. Rows come back one for one, repeated rows included, and an empty table gives an empty
result; there are no ties to break. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linkloom.llm.arrow_text import slices, small_batches, utf8

SPACE = "▁"
CHUNK = 768
WARM_UP = 48
#: Cells of the transition table beyond which it is emptied between slices (4 bytes each).
TABLE_CELLS = 28_000_000


class Transducer:
    """Deterministic transducer from characters to token counts, built as far as texts need it."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        scores = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
                scores[sp.id_to_piece(i)] = sp.get_score(i)
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: ranks[s] for p, s in scores.items()}
        self.prefixes = {p[:n] for p in self.rank for n in range(1, len(p))}
        self.inner = {p[n : n + 2] for p in self.rank for n in range(len(p) - 1)}
        self.alone: dict[str, bool] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        chars = {c for p in self.rank for c in p}
        # Class 0 separates texts; 1 to 4 are characters outside the vocabulary, by bytes.
        self.classes = np.full(0x110000, 65535, np.uint16)
        self.symbols = ["", "\x01", "\x02", "\x03", "\x04"]
        points = np.arange(0x110000)
        self.byte_class = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.uint16)
        known = np.array([ord(c) for c in chars])
        self.known = np.zeros(0x110000, bool)
        self.known[known] = True
        self.width = 128
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.table = np.full(4096 * self.width, -1, np.int32)
        self.intern(("", (("", "", 0),)))

    def intern(self, state: tuple) -> int:
        """A state: the last character and, for each position from which a piece may still be
        completed, the characters since, the last piece there and its count less the present one."""
        if (i := self.ids.get(state)) is None:
            i = self.ids[state] = len(self.states)
            self.states.append(state)
            if (i + 1) * self.width > len(self.table):
                self.table = np.concatenate((self.table, np.full(len(self.table), -1, np.int32)))
        return i

    def merged(self, text: str) -> list[str]:
        """The tokenizer's own rule: merge the pair of best rank, leftmost first, while there is one."""
        parts, rank = list(text), self.rank
        got = [rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while got and (best := min(got)) < 1 << 30:
            at = got.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del got[at]
            if at:
                got[at - 1] = rank.get(parts[at - 1] + parts[at], 1 << 30)
            if at < len(got):
                got[at] = rank.get(parts[at] + parts[at + 1], 1 << 30)
        return parts

    def is_piece(self, text: str) -> bool:
        if (known := self.alone.get(text)) is None:
            known = self.alone[text] = len(text) == 1 or text in self.rank and len(self.merged(text)) == 1
        return known

    def stay_apart(self, left: str, right: str) -> bool:
        if not left or left[-1] + right[0] not in self.inner:
            return True
        if (known := self.apart.get((left, right))) is None:
            known = self.apart[left, right] = self.merged(left + right) == [left, right]
        return known

    def step(self, state: int, kind: int) -> int:
        """Builds the transition and returns it packed: next state and emitted tokens plus 32."""
        if kind == 0:
            return 32
        char = self.symbols[kind]
        last, open_at = self.states[state]
        if last and last + char not in self.inner:  # no piece spans this place: like a text's start
            open_at = (("", "", 0),)
        if kind <= 4:
            # Each byte is a token of its own and nothing merges with it.
            return self.intern((char, (("", "", 0),))) << 6 | kind + 32
        for since, piece, ahead in open_at:
            if self.is_piece(found := since + char) and self.stay_apart(piece, found):
                emitted = ahead + (1 if found in self.rank else len(char.encode()))
                break
        else:
            raise AssertionError("no piece ends here")
        kept = tuple((since + char, piece, ahead - emitted) for since, piece, ahead in open_at if since + char in self.prefixes)
        return self.intern((char, (*kept, ("", found, 0)))) << 6 | emitted + 32

    def classify(self, points: np.ndarray) -> np.ndarray:
        kinds = self.classes[points]
        if len(kinds) and kinds.max() == 65535:
            for p in np.unique(points[kinds == 65535]):
                if self.known[p]:
                    self.classes[p] = len(self.symbols)
                    self.symbols.append(chr(p))
                else:
                    self.classes[p] = self.byte_class[p]
            if len(self.symbols) > self.width:
                while len(self.symbols) > self.width:
                    self.width *= 2
                self.clear()
            kinds = self.classes[points]
        return kinds

    def run(self, kinds: np.ndarray, state: np.ndarray, emitted: np.ndarray | None) -> np.ndarray:
        """Runs the columns of kinds in lockstep from the given states."""
        width = self.width
        for k in range(len(kinds)):
            at = state * width + kinds[k]
            packed = self.table.take(at)
            if packed.min() < 0:
                for cell in np.unique(at[packed < 0]).tolist():
                    value = self.step(*divmod(cell, width))
                    self.table[cell] = value
                packed = self.table.take(at)
            if emitted is not None:
                np.subtract(packed & 63, 32, out=emitted[k], casting="unsafe")
            state = (packed >> 6).astype(np.int64)
        return state

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        whole = "".join(f"\0{SPACE}{t}" if t else "\0" for t in texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len(t) + (2 if t else 1) for t in texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        if len(self.states) * self.width > TABLE_CELLS:
            self.clear()
        kinds = self.classify(np.where(points == 0x20, ord(SPACE), points))
        kinds[starts] = 0
        n = max(1, -(-len(points) // CHUNK))
        padded = np.zeros(n * CHUNK, np.uint16)
        padded[: len(points)] = kinds
        table = padded.reshape(n, CHUNK)
        before = np.zeros((n, WARM_UP), np.uint16)
        before[1:] = table[:-1, -WARM_UP:]
        columns = np.ascontiguousarray(table.T)
        guess = self.run(np.ascontiguousarray(before.T), np.zeros(n, np.int64), None)
        enter, leave, emitted, row = self.state_maps(columns, guess)
        entry = composed(enter, leave)
        flat = emitted[row[np.arange(n), entry]].reshape(-1)[: len(points)]
        total = np.concatenate(([0], np.cumsum(flat, dtype=np.int64)))
        return total[starts + sizes] - total[starts]

    def state_maps(self, columns: np.ndarray, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each chunk's map, closed: every exit state of a chunk is an entry state of the next one.

        ``enter[k, j]`` (-1 beyond a chunk's entries) goes to ``leave[k, j]``, and the row
        ``row[k, j]`` of the third array has the tokens that each of its characters emits."""
        n = len(guess)
        enter, leave, row = (np.full((n, 1), -1, np.int64) for _ in range(3))
        emitted = np.empty((0, len(columns)), np.int8)
        chunk, state = np.arange(n), guess
        self.passes = 0
        while len(chunk):
            self.passes += 1
            out = np.empty((len(columns), len(chunk)), np.int8)
            left = self.run(np.ascontiguousarray(columns[:, chunk]), state, out)
            # New entries follow a chunk's earlier ones.
            at = (enter >= 0).sum(axis=1)[chunk] + np.arange(len(chunk)) - np.searchsorted(chunk, chunk)
            if (wide := at.max() + 1 - enter.shape[1]) > 0:
                enter, leave, row = (np.pad(x, ((0, 0), (0, wide)), constant_values=-1) for x in (enter, leave, row))
            enter[chunk, at], leave[chunk, at], row[chunk, at] = state, left, len(emitted) + np.arange(len(chunk))
            emitted = np.concatenate((emitted, out.T))
            unknown = (leave[:-1] >= 0) & ~(leave[:-1, :, None] == enter[1:, None, :]).any(axis=2)
            k, j = np.nonzero(unknown)
            chunk, state = k + 1, leave[k, j]
            if self.passes > 2 and len(chunk):
                # What is still unknown comes from a text with a memory: its states recur further on.
                spread = np.arange(1 << min(self.passes - 2, 30))[: n - int(chunk.min())]
                chunk, state = (chunk[:, None] + spread).reshape(-1), np.repeat(state, len(spread))
                chunk, state = chunk[chunk < n], state[chunk < n]
                fresh = ~(enter[chunk] == state[:, None]).any(axis=1)
                chunk, state = chunk[fresh], state[fresh]
            chunk, state = np.unique(np.stack((chunk, state)), axis=1)
        return enter, leave, emitted, row


def composed(enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Which of its entries each chunk is entered by, if the first is entered by its first: the chunks'
    maps, as positions among the next one's entries, composed by a prefix scan."""
    step = (leave[:-1, :, None] == enter[1:, None, :]).argmax(axis=2)
    reach = 1
    while reach < len(step):
        # step[k] has gone through `reach` chunks up to k; the ones before it are put in front.
        step[reach:] = np.take_along_axis(step[reach:], step[:-reach].copy(), axis=1)
        reach *= 2
    return np.concatenate(([0], step[:, 0]))


_compiled: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """One transducer per worker process and model; it keeps its transitions between tasks."""
    key = hash(model)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(model)
    return _compiled[key]


def count_tokens(docs: DataFrame, model_path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text", limit: int = 4096) -> DataFrame:
    """keys, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs.

    The model file is read on the driver and travels with the tasks (half a megabyte)."""
    with open(model_path, "rb") as f:
        model = f.read()
    schema = docs.select(*keys).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        for batch in batches:
            for part in slices(batch, text, 1 << 21):
                _, offsets = utf8(part.column(text))
                tokens = machine.counts(["" if t is None else t for t in part.column(text).to_pylist()])
                columns = [part.column(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
                    names=[*keys, "n_bytes", "n_tokens", "over_limit"],
                )

    return small_batches(docs.select(*keys, text)).mapInArrow(run, schema)
