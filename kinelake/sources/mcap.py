"""MCAP recordings: spans from message indexes, messages with protobuf or JSON payloads.

Only what the readers need of the format is read: the summary's channels,
schemas and chunk indexes, message indexes for a topic's span, and whole chunks
for messages. Chunks are plain or zstd; other
compressions need a library of their own.
"""

from __future__ import annotations

import importlib
import json
import struct
from collections.abc import Iterable, Iterator

# Fixed values of the format: its magic bytes and record kinds.
MAGIC = b"\x89MCAP0\r\n"
FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX = 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x08


class Cursor:
    """Little-endian fields of a record, one after the other."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def number(self, kind: str) -> int:
        (value,) = struct.unpack_from("<" + kind, self.raw, self.at)
        self.at += struct.calcsize(kind)
        return value

    def blob(self, kind: str = "I") -> bytes:
        size = self.number(kind)
        self.at += size
        return self.raw[self.at - size : self.at]

    def text(self) -> str:
        return self.blob().decode()

    def pairs(self, first: str, second: str) -> list[tuple[int, int]]:
        """A map or list of pairs, told by its bytes."""
        end = self.number("I") + self.at
        out = []
        while self.at < end:
            out.append((self.number(first), self.number(second)))
        return out

    def rest(self) -> bytes:
        return self.raw[self.at :]


def records(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(kind, content) of records that follow each other; a cut last one ends them."""
    at = 0
    while at + 9 <= len(raw):
        kind, size = struct.unpack_from("<BQ", raw, at)
        if at + 9 + size > len(raw):
            return
        yield kind, raw[at + 9 : at + 9 + size]
        at += 9 + size


def unpacked(compression: str, raw: bytes, size: int) -> bytes:
    if compression == "":
        return raw
    if compression == "zstd":
        return importlib.import_module("zstandard").ZstdDecompressor().decompress(raw, max_output_size=size)
    try:
        return importlib.import_module("lz4.frame").decompress(raw)
    except ImportError as e:
        raise ImportError(f"chunks are compressed by {compression!r}, which is not installed") from e


class Recording:
    """An indexed MCAP file: ``channels`` by id are (topic, encoding, schema name, schema data)."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as file:
            file.seek(0, 2)
            end = file.tell()
            if end < len(MAGIC) * 2 + 29:
                raise ValueError(f"{path} is no MCAP file")
            file.seek(end - len(MAGIC) - 29)
            foot = file.read()
            if not foot.endswith(MAGIC) or foot[0] != FOOTER:
                raise ValueError(f"{path} is no finished MCAP file")
            begin = struct.unpack_from("<Q", foot, 9)[0]
            if not begin:
                raise ValueError(f"{path} has no summary")
            file.seek(begin)
            summary = file.read(end - len(MAGIC) - 29 - begin)
        schemas: dict[int, tuple[str, bytes]] = {}
        self.channels: dict[int, tuple[str, str, str, bytes]] = {}
        self.chunks: list[dict] = []
        for kind, raw in records(summary):
            c = Cursor(raw)
            if kind == SCHEMA:
                number, name, _ = c.number("H"), c.text(), c.text()
                schemas[number] = (name, c.blob())
            elif kind == CHANNEL:
                number, schema, topic, encoding = c.number("H"), c.number("H"), c.text(), c.text()
                self.channels[number] = (topic, encoding, *schemas.get(schema, ("", b"")))
            elif kind == CHUNK_INDEX:
                keys = ("first", "last", "at", "size")
                told = dict(zip(keys, (c.number("Q") for _ in keys)))
                told["indexes"] = dict(c.pairs("H", "Q"))
                told["index_size"] = c.number("Q")
                self.chunks.append(told)

    def topics(self, wanted: Iterable[str]) -> dict[int, str]:
        wanted = set(wanted)
        return {n: c[0] for n, c in self.channels.items() if c[0] in wanted}

    def spans(self, wanted: Iterable[str]) -> dict[str, tuple[int, int]]:
        """First and last log time of each topic, from message indexes.

        A topic's chunks are looked at in order of their own first (last) time
        until one begins after (ends before) what was found: exact whatever the
        order of the messages, and no more than a few chunks of an ordered file.
        """
        names = self.topics(wanted)
        read: dict[int, dict[int, tuple[int, int]]] = {}
        out: dict[str, tuple[int, int]] = {}
        with open(self.path, "rb") as file:

            def within(chunk: dict) -> dict[int, tuple[int, int]]:
                if chunk["at"] not in read:
                    file.seek(min(chunk["indexes"].values()))
                    found: dict[int, tuple[int, int]] = {}
                    for kind, raw in records(file.read(chunk["index_size"])):
                        if kind == MESSAGE_INDEX:
                            cur = Cursor(raw)
                            channel = cur.number("H")
                            times = [t for t, _ in cur.pairs("Q", "Q")] if channel in names else []
                            if times:
                                found[channel] = (min(times), max(times))
                    read[chunk["at"]] = found
                return read[chunk["at"]]

            for n, topic in names.items():
                mine = [c for c in self.chunks if n in c["indexes"]]
                first = last = None
                for c in sorted(mine, key=lambda c: c["first"]):
                    if first is not None and c["first"] > first:
                        break
                    if n in within(c):
                        first = within(c)[n][0] if first is None else min(first, within(c)[n][0])
                for c in sorted(mine, key=lambda c: -c["last"]):
                    if last is not None and c["last"] < last:
                        break
                    if n in within(c):
                        last = within(c)[n][1] if last is None else max(last, within(c)[n][1])
                if first is not None and last is not None:
                    out[topic] = (first, last)
        return out

    def messages(self, wanted: Iterable[str]) -> Iterator[tuple[str, int, dict]]:
        """(topic, log time, fields) of all messages of topics, chunk by chunk."""
        names = self.topics(wanted)
        decoders = {n: _decoder(*self.channels[n][1:]) for n in names}
        with open(self.path, "rb") as file:
            for c in self.chunks:
                if not set(c["indexes"]) & set(names):
                    continue
                file.seek(c["at"])
                _, raw = next(records(file.read(c["size"])))
                cur = Cursor(raw)
                cur.number("Q"), cur.number("Q")
                size, _, compression = cur.number("Q"), cur.number("I"), cur.text()
                for kind, content in records(unpacked(compression, cur.blob("Q"), size)):
                    if kind == MESSAGE:
                        m = Cursor(content)
                        n, _, at, _ = m.number("H"), m.number("I"), m.number("Q"), m.number("Q")
                        if n in names:
                            yield names[n], at, decoders[n](m.rest())


def overlap(path: str, topics: Iterable[str]) -> tuple[int, int]:
    """From the latest first to the earliest last message of the topics; a missing one, or none in common, raises."""
    topics = list(topics)
    spans = Recording(path).spans(topics)
    missing = sorted(set(topics) - set(spans))
    if missing:
        raise ValueError(f"{path} has no messages of {missing}")
    t0, t1 = max(a for a, _ in spans.values()), min(z for _, z in spans.values())
    if t1 < t0:
        raise ValueError(f"the topics of {path} have no time in common")
    return t0, t1


# payloads


def wire_fields(raw: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field number, wire type, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, wire, varint()
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            yield number, wire, raw[at : at + size]
            at += size
        elif wire == 2:
            size = varint()
            yield number, wire, raw[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {wire} in a message")


# Fixed values of the descriptor format: field types by number.
DOUBLE, FLOAT, STRING, MESSAGE_TYPE, BYTES = 1, 2, 9, 11, 12


def descriptor(schema: bytes, name: str) -> dict[int, tuple[str, int]]:
    """(field name, type) by number of a message of a file descriptor set."""
    for number, _, file in wire_fields(schema):
        if number != 1:
            continue
        package = next((v.decode() for n, _, v in wire_fields(file) if n == 2), "")
        for n, _, message in wire_fields(file):
            if n != 4:
                continue
            own = next((v.decode() for k, _, v in wire_fields(message) if k == 1), "")
            if name in (own, f"{package}.{own}"):
                out = {}
                for k, _, f in wire_fields(message):
                    if k == 2:
                        told = {a: b for a, _, b in wire_fields(f)}
                        out[told[3]] = (told[1].decode(), told.get(5, 0))
                return out
    raise ValueError(f"the schema has no message {name!r}")


def _decoder(encoding: str, name: str, schema: bytes):
    if encoding != "protobuf":
        return lambda raw: json.loads(raw) if raw else {}
    fields = descriptor(schema, name)

    def decode(raw: bytes) -> dict:
        out: dict = {}
        for number, wire, value in wire_fields(raw):
            field, kind = fields.get(number, ("", 0))
            if kind in (DOUBLE, FLOAT):
                numbers = struct.unpack(f"<{len(value) // (8 if kind == DOUBLE else 4)}{'d' if kind == DOUBLE else 'f'}", value)
                out.setdefault(field, []).extend(numbers)
            elif kind == STRING:
                out[field] = value.decode()
            elif field:
                out[field] = value
        return out

    return decode
