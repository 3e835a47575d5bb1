"""Line-first quality rules.

Every line of a text is judged by itself; lines that fail a rule go, and a text that loses more
than ``max_loss`` of its words' characters that way, or keeps fewer than ``min_words`` words, is
rejected. A line with a word fails if
- punctuation: it neither ends in a sentence's end (closing quotes and brackets aside) nor holds
  one (``.``, ``!`` or ``?`` before white space), or at least three of its characters and more than 30 % of its words' number are exclamation marks;
- navigation: it has at least three of the symbols ``#*$%&|<>`` and more than one to four words;
- boilerplate: it equals an earlier line of the text, or is short and holds a stock phrase.

Besides that verdict come base counts of the whole text: words (runs of anything but ASCII white
space), their code points, symbols, repeated lines and words inside repeated eight-word windows.
Texts of under 20 words, or with more than 30 % of words in repeated windows, fail outright.

Words, lines and windows are compared by 64-bit hashes over byte ranges in numpy, a bounded slice of
rows at a time; no shuffle. Null texts have no words and are rejected like empty ones; rows come
back one for one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linkloom.llm.arrow_text import joined, mix, range_hashes, slices, small_batches

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
ENDS = (".", "!", "?", "…", ":", ";", "。", "！", "？")
CLOSERS = "\"')]}»”’"
WHITE = " \t\n\x0b\x0c\r"
STOCK_PHRASES = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript",
    "click here", "sign up", "log in", "subscribe to", "lorem ipsum", "skip to content",
)
#: A line of more words than this is no boilerplate for holding a stock phrase.
STOCK_WORDS = 25
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_is_white = np.zeros(256, bool)
_is_white[list(WHITE.encode())] = True
_is_symbol = np.zeros(256, bool)
_is_symbol[list(SYMBOLS)] = True


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which repeat an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    later[order[1:]] = same
    return any_, later


def ends_sentence(raw: bytes, start: int, end: int) -> bool:
    """Whether the bytes end in a sentence's end, closing quotes and brackets aside."""
    tail = raw[max(start, end - 24) : end].decode("utf-8", "ignore").rstrip(CLOSERS)
    return tail.endswith(ENDS) if tail else raw[start:end].decode().rstrip(CLOSERS).endswith(ENDS)


def judge(column: pa.Array, max_loss: float, min_words: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The counts and verdicts of each row, and the lines: their row, span and whether they stay."""
    data, starts, ends = joined(column)
    n = len(starts)
    row_sum = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[np.append(starts, len(data))])
    white = _is_white[data]
    inside = ~white
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    w_start, w_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    w_row = np.searchsorted(starts, w_start, side="right") - 1
    point = (data & 0xC0) != 0x80
    symbol = _is_symbol[data]
    counts = {"n_words": np.bincount(w_row, minlength=n), "word_chars": row_sum(inside & point), "n_symbols": row_sum(symbol)}

    row_salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        # Windows of words: a sum of the hashes, each times its own odd number.
        h = range_hashes(data, w_start, w_end)
        covered = np.zeros(len(w_start) + 1, np.int64)
        if len(w_start) >= WINDOW:
            last = len(w_start) - WINDOW + 1
            odd = mix(np.arange(11, 11 + WINDOW, dtype=np.uint64)) | np.uint64(1)
            keys = row_salt[w_row[:last]].copy()
            for j in range(WINDOW):
                keys += h[j : j + last] * odd[j]
            whole = np.flatnonzero(w_row[:last] == w_row[WINDOW - 1 :])
            twice = whole[repeated(mix(keys[whole]))[0]]
            np.add.at(covered, twice, 1)
            np.add.at(covered, twice + WINDOW, -1)
        in_repeat = np.cumsum(covered)[:-1] > 0
        counts["n_repeat_words"] = np.bincount(w_row[in_repeat], minlength=n)

        # Lines. A row's separator ends its last line.
        l_end = np.flatnonzero(data == 0x0A)
        l_start = np.concatenate(([0], l_end[:-1] + 1)).astype(np.int64) if len(l_end) else l_end
        l_row = np.searchsorted(starts, l_start, side="right") - 1
        w_line = np.searchsorted(l_end, w_start)
        l_words = np.bincount(w_line, minlength=len(l_end))
        filled = np.flatnonzero(l_words)
        f_start, f_end = l_start[filled], l_end[filled]
        dup = repeated(mix(range_hashes(data, f_start, f_end) + row_salt[l_row[filled]]))[1]
    counts["n_dup_lines"] = np.bincount(l_row[filled][dup], minlength=n)

    upto = lambda flags: np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    within = lambda flags: (u := upto(flags))[f_end] - u[f_start]
    words, symbols, shouts = l_words[filled], within(symbol), within(data == 0x21)
    raw = data.tobytes()
    # Up to the end of the line's last word.
    w_upto = np.cumsum(l_words)[filled] - 1
    tails = zip(f_start.tolist(), w_end[w_upto].tolist())
    final = np.fromiter((ends_sentence(raw, s, e) for s, e in tails), bool, len(filled))
    stop = np.isin(data, np.frombuffer(b".!?", np.uint8))
    stop[:-1] &= white[1:] & (data[1:] != 0x0A)
    final |= within(stop) > 0
    stock = np.zeros(len(filled), bool)
    low = raw.lower()
    for phrase in STOCK_PHRASES:
        at = low.find(phrase.encode())
        while at >= 0:
            line = int(np.searchsorted(f_end, at))
            stock[line] = True
            at = low.find(phrase.encode(), at + 1)
    fails = ~final | (shouts >= 3) & (10 * shouts > 3 * words) | (symbols >= 3) & (4 * symbols > words) | dup | stock & (words <= STOCK_WORDS)
    chars = within(inside & point)
    rows = l_row[filled]
    lost = np.bincount(rows[fails], weights=chars[fails], minlength=n)
    left = counts["n_words"] - np.bincount(rows[fails], weights=words[fails], minlength=n)
    counts["base_failed"] = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
    counts["kept"] = ~counts["base_failed"] & (lost <= max_loss * counts["word_chars"]) & (left >= min_words)
    stays = np.ones(len(l_end), bool)
    stays[filled] = ~fails
    return counts, l_row, np.stack((l_start, l_end), axis=1), stays


def clean_lines(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", max_loss: float = 0.5, min_words: int = 10, with_text: bool = False) -> DataFrame:
    """keys, the five counts, base_failed and kept of every row; with_text adds ``cleaned``, the text
    without its failed lines (null where the text is null)."""
    schema = docs.select(*keys).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean")
    if with_text:
        schema = schema.add("cleaned", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                counts, l_row, spans, stays = judge(part.column(text), max_loss, min_words)
                columns = [part.column(k) for k in keys] + [pa.array(counts[c].astype(np.int64)) for c in COUNTS]
                columns += [pa.array(counts["base_failed"]), pa.array(counts["kept"])]
                if with_text:
                    raw = joined(part.column(text))[0].tobytes()
                    lines: list[list[bytes]] = [[] for _ in range(part.num_rows)]
                    for r, (s, e) in zip(l_row[stays].tolist(), spans[stays].tolist()):
                        lines[r].append(raw[s:e])
                    there = part.column(text).is_valid().to_pylist()
                    columns.append(pa.array([b"\n".join(x).decode() if ok else None for x, ok in zip(lines, there)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return small_batches(docs.select(*keys, text)).mapInArrow(run, schema)
