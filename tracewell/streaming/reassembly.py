"""Signature hits over chunks that arrive in any order.

State is kept by source: how far its bytes are whole, the last of them that a pattern may go on from, and the chunks that wait
for those before them. If there is a `patience` and chunks have waited for longer, a timeout declares the gap a hole, of which a row is
given, and goes on behind it. The state is in the query's checkpoint, so a query that is started again goes on where it was.

A call of Python costs more than a short source's bytes, so sources are dealt to buckets by a hash, and a bucket is one call, one row of the state and one search.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scan import Matcher, Signature, as_signatures

#: A hit of a signature, or, without an id, a hole of so many bytes.
FOUND = "source string, id string, offset long, length long"
#: A bucket's sources; by source, how far it is whole, when its patience ends (0: never), the length of its tail and how many chunks wait; by
#: chunk that waits, its base and length; and the bytes, compressed: of each source its tail and its chunks.
STATE = "sources array<string>, heads binary, chunks binary, data binary"
#: A source's hits of a signature, or a hole, as Python gives them: a row each costs more than the search.
PACKED = "source string, id string, length long, offsets array<long>"
#: Buckets that sources are dealt to; a checkpoint belongs to this number.
BUCKETS = 2048
#: Bytes of several sources that are searched at once.
AT_ONCE = 4 << 20


class Reassembly:
    """The whole bytes of a source so far, and the chunks that wait."""

    def __init__(self, signatures: list[Signature], at: int = 0, tail: bytes = b"", waiting: dict[int, bytes] | None = None, matcher: Matcher | None = None) -> None:
        self.signatures, self.at, self.tail, self.waiting = signatures, at, tail, waiting or {}
        self.matcher = matcher or Matcher([s.pattern for s in signatures])
        self.keep = max(len(s.pattern) for s in signatures) - 1

    def add(self, base: int, data: bytes) -> None:
        """A chunk; what came before is left out of it."""
        if base < self.at:
            base, data = self.at, data[self.at - base :]
        if data and len(self.waiting.get(base, b"")) < len(data):
            self.waiting[base] = data

    def go_on(self) -> Iterator[tuple[str | None, int, int]]:
        """Hits in what follows the whole bytes, as far as it is there."""
        for i, places in self._found():
            n = len(self.signatures[i].pattern)
            for p in places.tolist():
                yield self.signatures[i].id, p, n

    def _found(self) -> list[tuple[int, np.ndarray]]:
        """By signature, where its hits are; chunks that follow each other are searched as one."""
        if (more := self.take()) is None:
            return []
        begin, old, both = more
        # a hit within the old bytes was found before
        return [(i, begin + places[places + len(self.signatures[i].pattern) > old]) for i, places in self.matcher.find(both)]

    def take(self) -> tuple[int, int, bytes] | None:
        """What follows the whole bytes, as far as it is there, behind the tail: where the tail begins, its length, and the bytes. They are whole then."""
        parts, end = [self.tail], self.at
        while (data := self.waiting.pop(end, None)) is not None:
            parts.append(data)
            end += len(data)
        if end == self.at:
            return None
        both, old, begin = b"".join(parts), len(self.tail), self.at - len(self.tail)
        self.at, self.tail = end, both[max(0, len(both) - self.keep) :] if self.keep else b""
        return begin, old, both

    def over(self) -> Iterator[tuple[str | None, int, int]]:
        """The hole before the first chunk that waits, and what follows it."""
        if self.waiting:
            yield self.skip()
            yield from self.go_on()

    def skip(self) -> tuple[None, int, int]:
        """The hole before the first chunk that waits; the whole bytes go on behind it."""
        after = min(self.waiting)
        hole = None, self.at, after - self.at
        self.at, self.tail = after, b""
        return hole


class Bucket:
    """Sources by name, and when the patience with each ends."""

    def __init__(self, signatures: list[Signature], matcher: Matcher, state: tuple | None = None) -> None:
        self.signatures, self.matcher = signatures, matcher
        self.sources: dict[str | None, Reassembly] = {}
        self.until: dict[str | None, int] = {}
        if state is None:
            return
        names, heads, chunks, data = state
        chunks, data, chunk, place = np.frombuffer(chunks, "<i8").reshape(-1, 2).tolist(), zlib.decompress(data), 0, 0
        for name, (at, until, tail, waiting) in zip(names, np.frombuffer(heads, "<i8").reshape(-1, 4).tolist(), strict=True):
            r = self.sources[name] = Reassembly(signatures, at, data[place : place + tail], matcher=matcher)
            place += tail
            for base, n in chunks[chunk : chunk + waiting]:
                r.waiting[base] = data[place : place + n]
                place += n
            chunk += waiting
            if until:
                self.until[name] = until

    def state(self) -> tuple:
        heads, chunks, data = [], [], []
        for name, r in self.sources.items():
            heads.append((r.at, self.until.get(name, 0), len(r.tail), len(r.waiting)))
            chunks += [(base, len(part)) for base, part in r.waiting.items()]
            data += [r.tail, *r.waiting.values()]
        return list(self.sources), np.array(heads, "<i8").tobytes(), np.array(chunks, "<i8").tobytes(), zlib.compress(b"".join(data), 1)

    def add(self, source: str | None, base: int, data: bytes) -> None:
        if (r := self.sources.get(source)) is None:
            r = self.sources[source] = Reassembly(self.signatures, matcher=self.matcher)
        r.add(base, data)

    def go_on(self, fresh: Iterable[str | None], now: int = 0, patience: float | None = None) -> Iterator[pd.DataFrame]:
        """Hits in what follows the whole bytes of sources with new chunks, and holes and hits of others that the patience (in seconds; now: in ms) has ended with."""
        moved = dict.fromkeys(fresh)
        if patience is not None:
            late = [name for name, until in self.until.items() if until <= now and name not in moved]
            if late:
                yield packed([(name, i, n, [at]) for name in late for i, at, n in [self.sources[name].skip()]])
            moved.update(dict.fromkeys(late))
        yield from self._whole(moved)
        if patience is not None:
            for name in moved:
                if self.sources[name].waiting:
                    self.until[name] = now + max(1, int(1000 * patience))
                else:
                    self.until.pop(name, None)

    def _whole(self, sources: Iterable[str | None]) -> Iterator[pd.DataFrame]:
        """Several sources are searched at once."""
        runs, size = [], 0
        for name in sources:
            if (more := self.sources[name].take()) is not None:
                runs.append((name, *more))
                size += len(more[2])
            if size >= AT_ONCE:
                yield from self._search(runs)
                runs, size = [], 0
        if runs:
            yield from self._search(runs)

    def _search(self, runs: list[tuple[str | None, int, int, bytes]]) -> Iterator[pd.DataFrame]:
        names, begins, olds, parts = zip(*runs, strict=True)
        names, begins = np.array([*names, None], object)[:-1], np.array(begins)
        ends = np.cumsum([len(p) for p in parts])
        starts = np.append(0, ends[:-1])
        new = starts + np.array(olds)
        for i, places in self.matcher.find(b"".join(parts)):
            n = len(self.signatures[i].pattern)
            run = np.searchsorted(ends, places, "right")
            # a hit within the old bytes was found before; one over a run's end isn't in any source
            keep = (places + n > new[run]) & (places + n <= ends[run])
            places, run = places[keep], run[keep]
            if len(places):
                first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
                offsets = np.split(begins[run] + places - starts[run], first[1:])
                yield packed([(name, self.signatures[i].id, n, o) for name, o in zip(names[run[first]], (o.tolist() for o in offsets), strict=True)])


def packed(rows: list[tuple[str | None, str | None, int, list[int]]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["source", "id", "length", "offsets"])


def hits(chunks: DataFrame, signatures: Iterable[Signature | tuple[str, bytes]], patience: float | None = None) -> DataFrame:
    """source, id, offset and length of signatures in a stream of chunks (source, base, data), and a row without id for each hole.

    Chunks of a source don't overlap, but may come twice; patience: seconds without a chunk of the source after which a hole isn't waited for any more.
    A query with such timeouts always has another batch to run, so it has no end by trigger(availableNow=True); without patience it has.
    """
    known = as_signatures(signatures)
    matchers: list[Matcher] = []  # a task's, made once

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if not matchers:
            matchers.append(Matcher([s.pattern for s in known]))
        b, fresh = Bucket(known, matchers[0], state.get if state.exists else None), dict[str | None, None]()
        if not state.hasTimedOut:
            for part in parts:
                for source, base, data in zip(part["source"].tolist(), part["base"].tolist(), part["data"].tolist(), strict=True):
                    b.add(source, base, bytes(data))
                    fresh[source] = None
        now = 0 if patience is None else state.getCurrentProcessingTimeMs()
        yield from b.go_on(fresh, now, patience)
        if b.until:
            state.setTimeoutDuration(max(1, min(b.until.values()) - now))
        state.update(b.state())

    dealt = chunks.select("source", "base", "data", F.pmod(F.xxhash64("source"), F.lit(BUCKETS)).alias("bucket"))
    found = dealt.groupBy("bucket").applyInPandasWithState(run, PACKED, STATE, "append", GroupStateTimeout.NoTimeout if patience is None else GroupStateTimeout.ProcessingTimeTimeout)
    return found.select("source", "id", F.explode("offsets").alias("offset"), "length")
