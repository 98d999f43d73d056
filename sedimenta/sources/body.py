"""Response bodies of any size: spooled to a compressed file, long lists in them read an element at a time."""

from __future__ import annotations

import codecs
import json
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice
from typing import Any

import pyarrow as pa

#: A body beyond these bytes lies on disk; characters a value may have to be decoded at
#: sight, and that are read at once.
IN_MEMORY = 8 * 1024 * 1024
WINDOW = 1024 * 1024
_DECODE = json.JSONDecoder().raw_decode
_BLANK = " \t\n\r"


class Spool:
    """The bytes of one body, compressed, in a temporary file that goes with this object."""

    def __init__(self, chunks: Iterable[bytes]):
        self._file = tempfile.NamedTemporaryFile(prefix="sedimenta-body-")
        self.size = 0
        with pa.CompressedOutputStream(pa.OSFile(self._file.name, "wb"), "zstd") as out:
            for chunk in chunks:
                out.write(chunk)
                self.size += len(chunk)

    def open(self) -> pa.NativeFile:
        return pa.CompressedInputStream(pa.OSFile(self._file.name, "rb"), "zstd")


class _Scan:
    """The JSON text of a spool, a window at a time."""

    def __init__(self, spool: Spool, place: int = 0):
        self.stream, self.text, self.at, self.dropped, self.ended = spool.open(), "", 0, 0, False
        head = self.stream.read(4)
        # as json.loads tells them apart
        self.decoder, self.held = codecs.getincrementaldecoder(json.detect_encoding(head))(), head
        while self.dropped + len(self.text) < place and not self.ended:
            self.at = len(self.text)
            self.more()
        self.at = place - self.dropped

    @property
    def place(self) -> int:
        return self.dropped + self.at

    def more(self) -> None:
        """Drops what was read; the window grows with a value that does not fit."""
        data = self.stream.read(max(WINDOW, len(self.text) - self.at))
        self.ended = not data
        new = self.decoder.decode(self.held + data, self.ended)
        self.text, self.dropped, self.at, self.held = self.text[self.at :] + new, self.dropped + self.at, 0, b""

    def peek(self) -> str:
        while True:
            text, at = self.text, self.at
            while at < len(text) and text[at] in _BLANK:
                at += 1
            self.at = at
            if at < len(text) or self.ended:
                return text[at : at + 1]
            self.more()

    def take(self, *wanted: str) -> str:
        found = self.peek()
        if found not in wanted:
            raise ValueError(f"the body is no JSON: {' or '.join(wanted)} expected at character {self.place}")
        self.at += 1
        return found

    def value(self, most: int | None = None) -> tuple[bool, Any]:
        """(True, the next value), or (False, None) before a container of more than ``most`` characters."""
        first = self.peek()
        if first not in ("{", "["):
            most = None
        while True:
            try:
                value, end = _DECODE(self.text, self.at)
                if end + 2 < len(self.text) or self.ended:  # a number cut off at "e+" reads as one without it
                    self.at = end
                    return True, value
            except json.JSONDecodeError as e:
                # what the window cuts off fails at its end, or is a string without one
                if self.ended or (e.pos < len(self.text) - 32 and not e.msg.startswith("Unterminated string")):
                    raise
            if most is not None and len(self.text) - self.at >= most:
                return False, None
            self.more()

    def values(self, most: int | None = None) -> Iterator[tuple[bool, Any]]:
        """Each element of an array, as ``value`` gives it; after (False, None) the caller reads it."""
        self.take("[")
        if self.peek() == "]":
            self.at += 1
            return
        while True:
            yield self.value(most)
            while self.text.startswith(",", self.at):  # the quick way, while elements lie in the window
                start = self.at + 2 if self.text.startswith(" ", self.at + 1) else self.at + 1
                try:
                    value, end = _DECODE(self.text, start)
                except json.JSONDecodeError:
                    break
                if end + 2 >= len(self.text):
                    break
                self.at = end
                yield True, value
            if self.take(",", "]") == "]":
                return

    def members(self) -> Iterator[str]:
        """The key of each member of an object, whose value the caller reads."""
        self.take("{")
        if self.peek() == "}":
            self.at += 1
            return
        while True:
            if self.peek() != '"':
                raise ValueError(f"the body is no JSON: a key expected at character {self.place}")
            key = self.value()[1]
            self.take(":")
            yield key
            if self.take(",", "}") == "}":
                return


class LongList(Sequence):
    """An array of a spooled body: its length is known, its elements are decoded as they are asked for."""

    long_list = True  # for paths.read_path

    def __init__(self, spool: Spool, place: int, length: int, objects: bool, each: Callable[[Any], Any] | None = None):
        self.spool, self.place, self.length, self.objects, self.each = spool, place, length, objects, each

    def __len__(self) -> int:
        return self.length

    def __iter__(self) -> Iterator[Any]:
        scan = _Scan(self.spool, self.place)
        for _, value in scan.values():
            yield self.each(value) if self.each else value

    def __getitem__(self, index):
        if isinstance(index, slice):
            start, stop, step = index.indices(self.length)
            return list(islice(self, start, stop, step)) if step > 0 else list(self)[index]
        index = index + self.length if index < 0 else index
        if not 0 <= index < self.length:
            raise IndexError("list index out of range")
        return next(islice(self, index, None))

    def map(self, each: Callable[[Any], Any]) -> LongList:
        return LongList(self.spool, self.place, self.length, self.objects, each)


def _long(scan: _Scan, spool: Spool) -> Any:
    short, value = scan.value(WINDOW)
    if short:
        return value
    if scan.peek() == "{":
        return {key: _long(scan, spool) for key in scan.members()}
    place, length, objects = scan.place, 0, True
    for short, value in scan.values(WINDOW):
        objects = type(value if short else _long(scan, spool)) is dict and objects
        length += 1
    return LongList(spool, place, length, objects)


def decode(body: bytes | Spool) -> Any:
    """The value of a body as ``json.loads`` gives it, but for long lists of a spooled one. All of it is
    read here, so a body that breaks off gives an error and no records."""
    if not isinstance(body, Spool):
        return json.loads(body)
    scan = _Scan(body)
    value = _long(scan, body)
    if scan.peek():
        raise ValueError(f"the body is no JSON: more after its end at character {scan.place}")
    return value


def is_list(value: Any) -> bool:
    return isinstance(value, (list, LongList))
