"""Bounded-space online packing (operator 4).

Each partition streams its documents past WINDOWS open sequences. A piece goes where the least room is left
after it (best fit). When none has room for it, the fullest one is filled with the front of the piece, if the
gap is at least MIN_CUT, and emitted; the rest starts a new sequence. At its end a partition fills its open
sequences up from one another; the one or few that stay short are merged over all partitions, group by
group, in rounds, without cutting.

Ids are those of byte_bpe_50k.json. They are made by tiktoken over the same vocabulary, four times as fast;
tests hold both equal, and texts that tiktoken refuses go to tokenizers.

Defined results. Null text: a document of the final id 0 alone; empty text the same. Rows that repeat a
doc_id are packed each for itself. Null doc_id: packed, doc_id null. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, stored, table

LENGTH = 1024
WINDOWS = 8
MIN_CUT = 8
#: Leftover sequences merged by one task in a round.
MERGE = 512
LEAST_GAIN = 0.02
END = 0
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_COLUMNS = [c.split()[0] for c in PIECE.split(", ")]


class Encoder:
    """Ids of texts by the public byte-level vocabulary; special tokens are ordinary text."""

    def __init__(self, vocabulary: str = "byte_bpe_50k") -> None:
        import public_tokenizers as P
        import tiktoken

        with open(P.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.slow = P.path(f"{vocabulary}.json"), None

    def by_tokenizers(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # its regular expressions give up on some very long runs of white space
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.by_tokenizers(text)


class Packer:
    """Open windows of one partition. A window is a list of (doc row, start, ids) and its fill."""

    def __init__(self, length: int, windows: int, min_cut: int) -> None:
        self.length, self.windows, self.min_cut = length, windows, min_cut
        self.open: list[tuple[int, list]] = []

    def _best(self, n: int) -> int | None:
        fits = [(fill, -i) for i, (fill, _) in enumerate(self.open) if fill + n <= self.length]
        return -max(fits)[1] if fits else None

    def add(self, piece: tuple) -> Iterator[list]:
        """piece: (row, start, ids). Yields the sequences that get full or must make room."""
        row, start, ids = piece
        while len(ids) >= self.length:
            yield [(row, start, ids[: self.length])]
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            i = self._best(len(ids))
            if i is None and len(self.open) < self.windows:
                self.open.append((0, []))
                i = len(self.open) - 1
            if i is None:
                i = max(range(len(self.open)), key=lambda k: self.open[k][0])
                fill, parts = self.open.pop(i)
                if (gap := self.length - fill) >= self.min_cut:
                    parts.append((row, start, ids[:gap]))
                    start, ids = start + gap, ids[gap:]
                yield parts
                continue
            fill, parts = self.open[i]
            parts.append((row, start, ids))
            self.open[i] = (fill + len(ids), parts)
            if fill + len(ids) == self.length:
                yield self.open.pop(i)[1]
            return

    def close(self) -> Iterator[list]:
        """The open windows, the emptiest poured into the fullest."""
        left = [p for p in sorted(self.open, key=lambda w: -w[0])]
        self.open = []
        while left:
            fill, parts = left.pop(0)
            while left and fill < self.length:
                size, last = left.pop()
                row, start, ids = last.pop()
                take = min(len(ids), self.length - fill)
                parts.append((row, start, ids[:take]))
                fill += take
                if take < len(ids):
                    last.append((row, start + take, ids[take:]))
                if last:
                    left.append((size - take, last))
            yield parts


def pack_partitions(docs: DataFrame, length: int = LENGTH, windows: int = WINDOWS, min_cut: int = MIN_CUT, encoder=Encoder) -> DataFrame:
    """The pieces of each partition; sequence_id has the partition in its upper bits. docs must read the same again if a task is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(), Packer(length, windows, min_cut)
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def put(parts: list) -> None:
            nonlocal sequence
            offset = 0
            for (doc, total), start, ids in parts:
                out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))
                offset += len(ids)
            sequence += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(_COLUMNS)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _COLUMNS)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                for parts in packer.add(((doc, len(ids)), 0, ids)):
                    put(parts)
            yield batch()
        for parts in packer.close():
            put(parts)
        yield batch()

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECE)


def _merge(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Best fit, decreasing, of whole sequences."""
    sizes = pdf.groupby("sequence_id")["length"].sum().sort_index().sort_values(ascending=False, kind="stable")
    rooms: list[list[int]] = []
    to: dict[int, tuple[int, int]] = {}
    for s, n in sizes.items():
        fit = min((r for r in rooms if r[0] >= n), default=None)
        if fit is None:
            rooms.append(fit := [length, s])
        to[s] = (fit[1], length - fit[0])
        fit[0] -= n
    moved = pdf["sequence_id"].map(to)
    return pdf.assign(sequence_id=[x[0] for x in moved], offset=pdf["offset"] + [x[1] for x in moved])[_COLUMNS]


def merge_leftovers(short: DataFrame, sequences: int, length: int = LENGTH, most: int = MERGE, least_gain: float = LEAST_GAIN) -> DataFrame:
    """Merges short sequences, about `most` in a task, in rounds of other groups, until all are in one group or a round no longer pays."""
    step = 0
    while sequences > 1:
        groups = -(-sequences // most)
        key = F.pmod(F.xxhash64(F.col("sequence_id"), F.lit(step)), F.lit(groups))
        short = short.withColumn("g", key).groupBy("g").applyInPandas(lambda pdf: _merge(pdf, length), PIECE)
        if groups == 1:
            break
        short = stored(short, "merged")
        left = short.select("sequence_id").distinct().count()
        if left > (1 - least_gain) * sequences:
            break
        sequences, step = left, step + 1
    return short


def pack(docs: DataFrame, length: int = LENGTH, windows: int = WINDOWS, min_cut: int = MIN_CUT) -> DataFrame:
    """The pieces of all documents, with gapless offsets in each sequence."""
    pieces = stored(pack_partitions(docs, length, windows, min_cut).withColumn("fill", F.lit(0).cast("long")), "pieces").drop("fill")
    # a partition's sequences are all full but for those with the last ids, and some cut short by less than min_cut
    fills = pieces.groupBy("sequence_id").agg(F.sum("length").alias("fill")).where(F.col("fill") <= length - min_cut).select("sequence_id")
    fills = stored(fills, "short")
    short = pieces.join(fills, "sequence_id", "left_semi").select(_COLUMNS)
    return pieces.join(fills, "sequence_id", "left_anti").select(_COLUMNS).unionByName(merge_leftovers(short, fills.count(), length))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
