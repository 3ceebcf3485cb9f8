"""Frames of the DHAV container, by the public description in FFmpeg's demuxer: carving and demultiplexing."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from contextlib import nullcontext

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytesx import packed_time
from ..sources.evidence import Space

MAGIC, FOOTER = b"DHAV", b"dhav"
HEADER, TAIL, MOST = 24, 8, 64 << 20
#: Bytes of frames after which a batch goes on.
HELD = 64 << 20
#: Lengths of known extension records by type, the type byte included: fixed values.
EXTENSIONS = {0x80: 4, 0x81: 4, 0x82: 8, 0x83: 4, 0x88: 8, 0x8C: 8, 0x91: 8, 0x92: 8, 0x93: 8, 0x94: 4, 0x95: 8, 0x96: 4, 0x9A: 8, 0x9B: 8, 0xB3: 4}
CODECS = {0x2: "h264", 0x4: "h264", 0x8: "h264", 0xC: "hevc"}


def build(kind: int, channel: int, number: int, packed: int, millis: int, payload: bytes, extension: bytes = b"") -> bytes:
    """A frame with a valid footer."""
    n = HEADER + len(extension) + len(payload) + TAIL
    head = MAGIC + struct.pack("<BBBBIIIHB", kind, 0, channel, 0, number, n, packed, millis, len(extension))
    return head + bytes([sum(head) & 255]) + extension + payload + FOOTER + struct.pack("<I", n)


def extension(data: bytes) -> dict:
    """Codec, rate, size and the types met; an unknown type or a cut record ends the walk."""
    out: dict = {"codec": None, "fps": None, "width": None, "height": None, "types": [], "truncated": False, "unknown": None}
    at = 0
    while at < len(data):
        kind = data[at]
        n = EXTENSIONS.get(kind)
        if n is None:
            out["unknown"] = kind
            break
        if at + n > len(data):
            out["truncated"] = True
            break
        out["types"].append(kind)
        if kind == 0x81:
            out["codec"], out["fps"] = CODECS.get(data[at + 2]), data[at + 3] or None
        elif kind == 0x80:
            out["width"], out["height"] = data[at + 2] * 8 or None, data[at + 3] * 8 or None
        elif kind == 0x82:
            w, h = struct.unpack_from("<HH", data, at + 4)
            out["width"], out["height"] = w or None, h or None
        at += n
    return out


def annexb_hint(payload: bytes) -> str | None:
    """The codec that the first parameter set names, start codes of four bytes before those of three."""
    for code in (b"\0\0\0\1", b"\0\0\1"):
        at = payload.find(code)
        while 0 <= at < len(payload) - len(code):
            b = payload[at + len(code)]
            if b & 0x1F in (7, 8) and not b & 0x80 and b >> 5:
                return "h264"
            if b >> 1 & 0x3F in (32, 33, 34):
                return "hevc"
            at = payload.find(code, at + len(code))
    return None


FRAME = "source string, offset long, length long, frame_type int, channel int, frame_number long, packed long, millis int, codec string, fps int, width int, height int, extension_length int, declared_codec string, payload_codec string, truncated boolean, unknown_type int, valid boolean, payload binary"


def parse_at(data: bytes, at: int) -> dict | None:
    """The frame at a magic; None if its header can't be one or it isn't all there."""
    if at + HEADER > len(data):
        return None
    kind, _, channel, _, number, n, packed, millis, ext = struct.unpack_from("<BBBBIIIHB", data, at + 4)
    if not HEADER + TAIL <= n <= MOST or HEADER + ext + TAIL > n or at + n > len(data):
        return None
    e = extension(data[at + HEADER : at + HEADER + ext])
    payload = data[at + HEADER + ext : at + n - TAIL]
    valid = data[at + n - TAIL : at + n] == FOOTER + struct.pack("<I", n)
    hint = annexb_hint(payload[:4096])
    return {"declared_codec": e["codec"], "payload_codec": hint, "truncated": e["truncated"], "unknown_type": e["unknown"], "length": n, "frame_type": kind, "channel": channel, "frame_number": number, "packed": packed, "millis": millis, "codec": e["codec"] or hint, "fps": e["fps"], "width": e["width"], "height": e["height"], "extension_length": ext, "valid": valid, "payload": payload}


def frame_size(head: bytes) -> int | None:
    """The whole length that a header states; None if it can't be one."""
    if len(head) < HEADER:
        return None
    n, ext = struct.unpack_from("<I", head, 12)[0], head[22]
    return n if HEADER + ext + TAIL <= n <= MOST else None


def in_chunk(raw: bytes, base: int, size: int, whole: Space | None = None, start: int = 0) -> Iterator[dict]:
    """Frames that begin in the first `size` bytes, with their offsets; the search goes on a byte after each magic. whole: where a frame that goes on past the bytes is read."""
    at = raw.find(MAGIC)
    while 0 <= at < size:
        f = parse_at(raw, at) if base + at >= start else None
        if f is None and whole and base + at >= start:
            n = frame_size(raw[at : at + HEADER] if at + HEADER <= len(raw) else whole.read(base + at, HEADER))
            if n is not None and at + n > len(raw):
                f = parse_at(whole.read(base + at, n), 0)
        if f:
            yield {"offset": base + at, **f}
        at = raw.find(MAGIC, at + 1)


def carve(chunks: DataFrame, strict: bool = True, start: int = 0, stop: int | None = None, space: tuple | None = None, most: int | None = None, payloads: bool = True) -> DataFrame:
    """Frames in chunks (source, base, size, data); a frame is its chunk's whose range it starts in.

    A frame that goes on past its chunk's data is read again at its offset from `space`, the arguments of
    evidence.Space; data need only go on past size by a magic less one byte. Without `space`, data must go on by the
    longest frame, as those cut off are left out. The search goes on a byte after each magic, so frames nested in
    payloads are found as well. strict drops frames without a valid footer; none may end after stop. most: the first so
    many of each source. payloads: False leaves their bytes out.
    """
    schema = pa.schema([("source", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("frame_type", pa.int32()), ("channel", pa.int32()), ("frame_number", pa.int64()), ("packed", pa.int64()), ("millis", pa.int32()), ("codec", pa.string()), ("fps", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("extension_length", pa.int32()), ("declared_codec", pa.string()), ("payload_codec", pa.string()), ("truncated", pa.bool_()), ("unknown_type", pa.int32()), ("valid", pa.bool_()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Space(*space) if space else nullcontext() as whole:
            yield from frames_of(batches, whole)

    def frames_of(batches: Iterator[pa.RecordBatch], whole: Space | None) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for source, base, size, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                for f in in_chunk(data.as_py(), base, size, whole, start):
                    if (f["valid"] or not strict) and (stop is None or f["offset"] + f["length"] <= stop):
                        out.append({"source": source, **f, **({} if payloads else {"payload": None})})
                        held += f["length"]
                    if held > HELD:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)

    found = chunks.select("source", "base", "size", "data").mapInArrow(run, FRAME)
    if most is not None:
        # a window-group limit keeps at most `most` rows of a source per task
        found = found.withColumn("__n", F.row_number().over(Window.partitionBy("source").orderBy("offset"))).where(F.col("__n") <= most).drop("__n")
    return found.withColumn("ts", packed_time("packed"))


def demux(frames: DataFrame) -> DataFrame:
    """Elementary pieces by channel in physical order: key frames and others of a known codec with a payload. Ranges split a channel that has most frames, and partitions are in order."""
    video = frames.where(F.col("codec").isNotNull() & (F.octet_length("payload") > 0))
    return video.select("source", "channel", "offset", "codec", "payload").repartitionByRange("source", "channel", "offset").sortWithinPartitions("source", "channel", "offset")
