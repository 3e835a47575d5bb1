"""Pages out of web archives by the places that a page index names."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from email.message import Message
from email.parser import BytesHeaderParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of an archive that one task reads at least, so that large archives spread over tasks.
STRETCH = 64 << 20


def split_head(raw: bytes) -> tuple[bytes, Message, bytes]:
    """First line, headers and the rest of a message."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, _, fields = head.partition(b"\r\n")
    return first, BytesHeaderParser().parsebytes(fields + b"\r\n\r\n"), rest


def parsed(raw: bytes) -> tuple[str | None, int, str]:
    """URI, status and decoded body of the first record of compressed or plain archive bytes."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompressobj(31).decompress(raw)
    version, fields, content = split_head(raw)
    if not version.startswith(b"WARC/"):
        raise ValueError("no archive record")
    status, http, body = split_head(content[: int(fields["Content-Length"])])
    text = body.decode(http.get_content_charset() or "utf-8", "replace")
    return fields["WARC-Target-URI"], int(status.split()[1]), text


def read_records(index: DataFrame, root: str) -> DataFrame:
    """The index with uri, status and html of each capture, nulls where it can't be read.

    ``filename`` is a path below ``root``, a folder or a URI that all executors reach; ``offset`` and
    ``length`` are bytes. Captures of one stretch of an archive go to one task in the order of offsets;
    only the named ranges are read, one at a time."""
    schema = index.schema.add("uri", "string").add("status", "integer").add("html", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        name, file = None, None
        for frame in frames:
            for i in range(len(frame)):
                row = frame.iloc[i : i + 1]
                found: tuple = (None, None, None)
                try:
                    if row["filename"].iloc[0] != name:
                        name, file = row["filename"].iloc[0], None
                        file = system.open_input_file(f"{base}/{name}")
                    file.seek(int(row["offset"].iloc[0]))
                    found = parsed(file.read(int(row["length"].iloc[0])))
                except (OSError, ValueError, TypeError, AttributeError, LookupError, zlib.error):
                    pass  # a capture that can't be read is a page without text
                yield row.assign(uri=found[0], status=pd.array([found[1]], "Int32"), html=found[2])

    spread = index.repartition("filename", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("filename", "offset")
    return spread.mapInPandas(run, schema)
