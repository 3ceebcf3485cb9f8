"""Records that go on over fragment borders: walks, carries, probes and payloads.

The record framing is data (`Layout`), given by the caller; none of a recorder is built in.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Layout:
    """sync bytes, then a type byte; by type the header's size, the place of the payload's length, and its struct format."""

    sync: bytes
    types: dict[int, tuple[int, int, str]]
    most: int = 4 << 20
    #: Bytes all of which are padding.
    blanks: bytes = b"\x00\xff"
    run: int = 64
    #: A record that is carried must end so many bytes before a fragment does.
    room: int = 32

    @property
    def longest(self) -> int:
        """The longest header's size."""
        return max(h for h, _, _ in self.types.values())


def record(data: bytes, at: int, layout: Layout) -> tuple[int, int, int] | None:
    """(type, header size, payload size) of the record at `at`. Of data, which may be anything that is sliced into bytes, only the header is read."""
    n = len(layout.sync)
    head = data[at : at + layout.longest]
    kind = layout.types.get(head[n]) if head[:n] == layout.sync and len(head) > n else None
    if kind is None or kind[0] > len(head):
        return None
    (size,) = struct.unpack_from(kind[2], head, kind[1])
    return (head[n], kind[0], size) if 0 < size <= layout.most else None


def padding_at(data: bytes, at: int, layout: Layout) -> bool:
    return not data[at : at + layout.run].strip(layout.blanks)


def walk(data: bytes, at: int, layout: Layout) -> tuple[str, int]:
    """How a fragment ends: ('padding', place), ('exact', length) or ('carry', place of the record that goes on). Anything else is an error."""
    while at < len(data):
        r = record(data, at, layout)
        if r is None:
            if padding_at(data, at, layout):
                return "padding", at
            if len(data) - at < layout.longest:
                return "carry", at
            raise ValueError(f"no record at {at}")
        if at + r[1] + r[2] > len(data):
            return "carry", at
        at += r[1] + r[2]
    return "exact", at


def probe(tail: bytes, fragment: bytes, layout: Layout) -> tuple[str, int] | None:
    """How the fragment ends if it goes on with the record begun in tail; None if it can't."""
    need = 0
    if tail:
        r = record(tail + fragment[: layout.longest], 0, layout)
        if r is None or not 0 < r[1] + r[2] - len(tail) < len(fragment) - layout.room:
            return None
        need = r[1] + r[2] - len(tail)
    if record(fragment, need, layout) is None and not padding_at(fragment, need, layout):
        return None
    try:
        return walk(fragment, need, layout)
    except ValueError:
        return None


def spans(data: bytes, layout: Layout, media: frozenset[int]) -> tuple[list[tuple[int, int]], int]:
    """Of a fragment after what the last one left: where payloads of records of the types in `media` lie, and where the bytes begin that go on in the next. Lost sync is an error.

    Of data, which may be anything that is sliced into bytes, only headers and a run of padding are read.
    """
    out, at = [], 0
    while at < len(data):
        r = record(data, at, layout)
        if r is None and padding_at(data, at, layout):
            return out, len(data)
        if r is None and len(data) - at >= layout.longest:
            raise ValueError("lost sync")
        if r is None or at + r[1] + r[2] > len(data):
            break
        if r[0] in media:
            out.append((at + r[1], at + r[1] + r[2]))
        at += r[1] + r[2]
    return out, at


def take(data: bytes, layout: Layout, media: frozenset[int]) -> tuple[bytes, int, bytes]:
    """The payloads that `spans` finds, how many, and the bytes that go on."""
    found, rest = spans(data, layout, media)
    return b"".join(data[a:z] for a, z in found), len(found), data[rest:]


class Joined:
    """Sliceable bytes end to end, read as they are sliced."""

    def __init__(self, parts: list) -> None:
        self.parts = parts
        self.ends = list(itertools.accumulate(len(p) for p in parts))

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def __getitem__(self, s: slice) -> bytes:
        a, z, _ = s.indices(len(self))
        out, begin = [], 0
        for part, end in zip(self.parts, self.ends, strict=True):
            if a < end and begin < z:
                out.append(part[max(a, begin) - begin : min(z, end) - begin])
            begin = end
        return b"".join(out)


def payloads(fragments: list[bytes], layout: Layout, media: frozenset[int]) -> tuple[bytes, int]:
    """The payloads along a path, and the bytes left over at its end."""
    out, tail = [], b""
    for f in fragments:
        payload, _, tail = take(tail + f, layout, media)
        out.append(payload)
    return b"".join(out), len(tail)


def extract(paths: DataFrame, layout: Layout, media: frozenset[int]) -> DataFrame:
    """path, payload, left_over, error of each path; paths: path, seq, data. Paths run in parallel, a path is sequential."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            payload, left = payloads([bytes(x) for x in pdf.sort_values("seq")["data"]], layout, media)
            row = (pdf["path"].iloc[0], payload, left, None)
        except ValueError as e:
            row = (pdf["path"].iloc[0], None, None, str(e))
        return pd.DataFrame([row], columns=["path", "payload", "left_over", "error"])

    return paths.groupBy("path").applyInPandas(run, "path long, payload binary, left_over long, error string")


def continuations(pairs: DataFrame, layout: Layout) -> DataFrame:
    """pairs (src, dst, tail, fragment) whose fragment goes on with the tail, with the new tail: the suffix that is carried, and the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for src, dst, tail, fragment in b[["src", "dst", "tail", "fragment"]].itertuples(index=False):
                if (end := probe(bytes(tail), bytes(fragment), layout)) is not None:
                    out.append((src, dst, end[0], bytes(fragment)[end[1] :] if end[0] == "carry" else b""))
            yield pd.DataFrame(out, columns=["src", "dst", "ending", "tail"])

    return pairs.select("src", "dst", "tail", "fragment").mapInPandas(run, "src long, dst long, ending string, tail binary")
