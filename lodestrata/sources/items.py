"""Items of large JSON arrays in files, read as they come."""

from __future__ import annotations

import codecs
import json
import re
import warnings
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that are decoded at once; items of a batch.
CHUNK, TOGETHER = 1 << 20, 256
_SPACE = re.compile(r"[ \t\r\n﻿]*")
_DECODER = json.JSONDecoder()


def chunks(data: memoryview, packed: bool) -> Iterator[bytes]:
    """The bytes of a file, unpacked, CHUNK at most at a time. Packed files may have several members."""
    if not packed:
        yield from (bytes(data[k:k + CHUNK]) for k in range(0, len(data), CHUNK))
        return
    z = zlib.decompressobj(31)
    for k in range(0, len(data), CHUNK):
        left = bytes(data[k:k + CHUNK])
        while left:
            yield z.decompress(left, CHUNK)
            left = z.unconsumed_tail
            if z.eof:
                left = z.unused_data.lstrip(b"\0")
                z = zlib.decompressobj(31)
    yield z.flush()


class _Text:
    """Decoded text with a place in it; what lies before the place is let go."""

    def __init__(self, parts: Iterable[bytes]):
        self._decode = codecs.getincrementaldecoder("utf-8")("replace").decode
        self._parts, self._more = iter(parts), True
        self.buf, self.at = "", 0

    def fill(self, least: int = 1) -> bool:
        """At least so many more characters, unless the file ends; whether there were any."""
        got: list[str] = []
        while self._more and sum(map(len, got)) < least:
            part = next(self._parts, None)
            self._more = part is not None
            got.append(self._decode(part or b"", not self._more))
        self.buf, self.at = self.buf[self.at:] + "".join(got), 0
        return any(got)

    def peek(self) -> str:
        """The next character that is no space; empty at the end."""
        while True:
            self.at = _SPACE.match(self.buf, self.at).end()
            if self.at < len(self.buf):
                return self.buf[self.at]
            if not self.fill():
                return ""

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise ValueError(f"malformed JSON: {wanted!r} expected")
        self.at += 1

    def value(self) -> str:
        """The text of the value that begins here. A value that the buffer cuts is read again with twice as much."""
        self.peek()
        while True:
            try:
                end = _DECODER.raw_decode(self.buf, self.at)[1]
            except ValueError as e:
                if not self.fill(max(CHUNK, len(self.buf) - self.at)):
                    raise ValueError(f"malformed JSON: {e}") from None
                continue
            # a number that the buffer cuts may go on
            if self.buf[end:end + 1] not in ("", ".", "e", "E") or not self.fill():
                out, self.at = self.buf[self.at:end], end
                return out


def _elements(t: _Text) -> Iterator[str]:
    t.take("[")
    if t.peek() == "]":
        t.at += 1
        return
    while True:
        yield t.value()
        if t.peek() == "]":
            t.at += 1
            return
        t.take(",")


def items(parts: Iterable[bytes], keys: tuple[str, ...]) -> Iterator[tuple[str, int, str]]:
    """(key, place, text) of each element of the arrays of some keys of the file's object; of a file that is an array, key is empty.

    Undecodable bytes become replacement marks. What is no JSON raises ValueError when it is reached.
    """
    t = _Text(parts)
    if t.peek() == "[":
        yield from (("", k, x) for k, x in enumerate(_elements(t)))
    else:
        t.take("{")
        first = True
        while t.peek() != "}":
            if not first:
                t.take(",")
                t.peek()
            first = False
            if t.buf[t.at:t.at + 1] != '"':
                raise ValueError("malformed JSON: a name expected")
            key = json.loads(t.value())
            t.take(":")
            if key in keys and t.peek() == "[":
                yield from ((key, k, x) for k, x in enumerate(_elements(t)))
            else:
                t.value()
        t.at += 1
    if t.peek():
        raise ValueError("malformed JSON: more behind the end")


def read_items(spark: SparkSession, path: str, keys: tuple[str, ...], names: str = "{*.json,*.json.gz}") -> DataFrame:
    """file, key, place, item (its JSON text) of files (plain or .gz) that any of Spark's file systems holds.

    A task reads a file's bytes once and decodes them bit by bit: what grows with a file is its bytes only.
    A folder without such files gives a warning and no rows.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path)
    if raw.select("path").isEmpty():
        warnings.warn(f"no files {names} in {path}", stacklevel=2)
    schema = pa.schema([("file", pa.string()), ("key", pa.string()), ("place", pa.int64()), ("item", pa.string())])

    def run(batches):
        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1)):
                found = items(chunks(memoryview(data.as_buffer()), at.endswith(".gz")), keys)
                while True:
                    part = []
                    try:
                        for x in found:
                            part.append((at, *x))
                            if len(part) == TOGETHER:
                                break
                    except (ValueError, zlib.error) as e:
                        raise ValueError(f"{at}: {e}") from None
                    if not part:
                        break
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    return raw.select("path", "content").mapInArrow(run, "file string, key string, place long, item string")
