"""Sentences and hyperlinks out of page markup, by a structural parse."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from linkloom.operators.batches import slices
from linkloom.operators.sentences import sentence_spans

#: Elements whose text is no content.
SILENT = {"script", "style", "template", "noscript"}


def clean(text: str) -> str:
    """Without control and format characters, each run of separators one space."""
    kept = "".join(c for c in text.replace("\n", " ").replace("\t", " ") if unicodedata.category(c) not in ("Cc", "Cf"))
    return re.sub(r"[ \xa0  -     　]+", " ", kept)


class Paragraphs(HTMLParser):
    """Collects, for each container element, its text snippets in order; an anchor that is the
    container's direct child is one snippet with its target."""

    def __init__(self, container: str):
        super().__init__(convert_charrefs=True)
        self.container, self.found = container, []
        self.snippets: list[list] | None = None
        self.depth, self.silent, self.anchor = 0, 0, None

    def close_paragraph(self) -> None:
        if self.snippets is not None:
            self.found.append(self.snippets)
        self.snippets, self.anchor, self.depth = None, None, 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag == self.container:
            self.close_paragraph()
            self.snippets = []
        elif self.snippets is not None:
            if tag == "a" and self.depth == 0 and self.anchor is None:
                self.anchor = ["", dict(attrs).get("href") or ""]
                self.snippets.append(self.anchor)
            elif tag not in ("br", "img", "hr", "input", "wbr", "meta", "link"):
                self.depth += 1

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == self.container:
            self.close_paragraph()
        elif self.snippets is not None:
            if tag == "a" and self.anchor is not None and self.depth == 0:
                self.anchor = None
            elif tag not in ("br", "img", "hr", "input", "wbr", "meta", "link"):
                self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if self.snippets is None or self.silent:
            return
        if self.anchor is not None:
            self.anchor[0] += data
        else:
            self.snippets.append([data, None])


def clamp(start: int, end: int, spans: list[tuple[int, int]]) -> tuple[int, int, int]:
    """Sentence number and the span inside it: the first sentence that ends after start, else the last."""
    i = min(sum(e <= start for _, e in spans), len(spans) - 1)
    s, e = spans[i]
    return i, max(start - s, 0), min(end, e) - s


def parse_page(markup: str, container: str = "p", split: Callable[[str], Iterator[tuple[int, int, int]]] = sentence_spans) -> tuple[list[str], list[tuple[int, int, int, str]]]:
    """Sentences, and links as (sentence, start, end exclusive, target). Blank anchors and empty targets
    give no link; a paragraph without text gives neither."""
    parser = Paragraphs(container)
    parser.feed(markup)
    parser.close()
    parser.close_paragraph()
    sentences: list[str] = []
    links: list[tuple[int, int, int, str]] = []
    for snippets in parser.found:
        text, anchors = "", []
        for raw, href in snippets:
            piece = clean(raw)
            if text.endswith(" ") and piece.startswith(" "):
                piece = piece[1:] if href is None else piece
            if href is not None and piece.strip() and href:
                anchors.append((len(text), len(text) + len(piece), href))
            text += piece
        spans = [(s, e) for _, s, e in split(text)]
        # A sentence starts at its first visible character.
        spans = [(s + len(text[s:e]) - len(text[s:e].lstrip()), e) for s, e in spans]
        if not spans:
            continue
        for start, end, href in anchors:
            i, a, b = clamp(start, end, spans)
            links.append((len(sentences) + i, a, b, href))
        sentences += [text[s:e] for s, e in spans]
    return sentences, links


def extract(pages: DataFrame, key: str, url: str, html: str, container: str = "p") -> DataFrame:
    """key, url, sentences (array) and links (array of sentence_idx, chars_start, chars_end, to_url as
    written); explode either for rows. Null markup has none of both."""
    link = T.StructType().add("sentence_idx", "integer").add("chars_start", "integer").add("chars_end", "integer").add("to_url", "string")
    schema = pages.select(key, url).schema.add("sentences", T.ArrayType(T.StringType())).add("links", T.ArrayType(link))
    kind = pa.list_(pa.struct([("sentence_idx", pa.int32()), ("chars_start", pa.int32()), ("chars_end", pa.int32()), ("to_url", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html):
            parsed = [parse_page(m, container) if m else ([], []) for m in batch.column(html).to_pylist()]
            links = [[dict(zip(("sentence_idx", "chars_start", "chars_end", "to_url"), x)) for x in p[1]] for p in parsed]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(url), pa.array([p[0] for p in parsed], pa.list_(pa.string())), pa.array(links, kind)], names=schema.names)

    return pages.select(key, url, html).mapInArrow(run, schema)
