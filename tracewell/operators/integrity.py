"""Digests, hash chains, canonical JSON, fingerprints and AES with a known key."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ordered

GENESIS = "0" * 64


def digests(rows: DataFrame, *more: Column) -> DataFrame:
    """key, size, sha256 and sha512 of data, and more columns; values up to Spark's row limit; files of any size: `file_digests`."""
    return rows.select("key", F.octet_length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("sha256"), F.sha2("data", 512).alias("sha512"), *more)


def file_digests(spark: SparkSession, paths: list[str], piece: int = 1 << 20) -> DataFrame:
    """path, size, sha256 and sha512 of files, a task a file, which is read once in pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path in b["path"]:
                found, size = (hashlib.sha256(), hashlib.sha512()), 0
                with open(path, "rb") as f:
                    while part := f.read(piece):
                        size += len(part)
                        for h in found:
                            h.update(part)
                out.append((path, size, *(h.hexdigest() for h in found)))
            yield pd.DataFrame(out, columns=["path", "size", "sha256", "sha512"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return listed.mapInPandas(run, "path string, size long, sha256 string, sha512 string")


def edge_digest(data: Column, sample: int, tag: str = "tracewell-edge-1") -> Column:
    """SHA-256 of tag, size and at most `sample` bytes of either end: a quick identity, not an integrity proof."""
    if not 1 <= sample <= 16 << 20:
        raise ValueError("1 byte to 16 MiB")
    n = F.octet_length(data)
    return F.sha2(F.concat(F.encode(F.concat(F.lit(tag + ":"), n.cast("string"), F.lit(":")), "UTF-8"), F.substring(data, 1, sample), F.substring(data, F.greatest(n - sample + 1, F.lit(1)), F.lit(sample))), 256)


def same_source(a: str, b: str) -> Column:
    """Two fingerprint structs of size, mtime, device, inode and edge name the same unchanged source."""
    return F.forall(F.array(*(F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("size", "mtime", "device", "inode", "edge"))), lambda x: x)


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys, no spaces and no escapes beyond JSON's own; exact bytes need Python's writer."""

    def canonical(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    return F.pandas_udf(canonical, "string")(text)


def entry_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def verify_chain(log: DataFrame, block: int = ordered.BLOCK) -> DataFrame:
    """Per chain: entries, bad entries and the first bad one. log: chain, seq, prev_hash, entry_hash, recomputed.

    An entry is bad if its number isn't the last one's plus 1 (the first: 1), its prev_hash isn't the last entry_hash
    (the first: zeros), or its hash isn't the recomputed one.
    """
    x = ordered.previous(log, ["chain"], "seq", ["seq", "entry_hash"], block)
    follows = (F.col("seq") == F.coalesce("prev_seq", F.lit(0)) + 1) & (F.col("prev_hash") == F.coalesce("prev_entry_hash", F.lit(GENESIS))) & (F.col("entry_hash") == F.col("recomputed"))
    x = x.withColumn("__bad", ~F.coalesce(follows, F.lit(False)))
    return x.groupBy("chain").agg(F.count(F.lit(1)).alias("entries"), F.count_if("__bad").alias("bad"), F.min(F.when(F.col("__bad"), F.col("seq"))).alias("first_bad"))


def decrypt_cbc(data: Column, key: Column, iv: Column, padded: bool = True) -> Column:
    """AES-CBC. Without padding, a block is added that deciphers to a whole block of padding."""
    if not padded:
        last = F.substring(data, F.octet_length(data) - 15, F.lit(16))
        extra = F.substring(F.aes_encrypt(F.lit(b""), key, F.lit("CBC"), F.lit("PKCS"), last), 17, 16)
        data = F.concat(data, extra)
    return F.aes_decrypt(F.concat(iv, data), key, F.lit("CBC"), F.lit("PKCS"))


def _binaries(sizes: np.ndarray, data: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Values of these sizes that lie end to end in data, which isn't copied."""
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [pa.array(valid).buffers()[1], pa.py_buffer(ends), pa.py_buffer(data)]) if ends[-1] > 2**31 - 1 else pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [pa.array(valid).buffers()[1], pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _counters(counter: pa.Array, first: pa.Array, n: pa.Array) -> pa.Array:
    """The n counters from `first` after a counter of 16 bytes on, modulo 2**128: what overflows the lower half is carried."""
    valid = np.array([c.is_valid and k.is_valid for c, k in zip(counter, n, strict=True)], bool)
    many = np.where(valid, n.fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    out = np.empty((int(many.sum()), 2), ">u8")
    at = 0
    for c, add, k in zip(counter, first.to_pylist(), many.tolist(), strict=True):
        if k:
            high, low = divmod((int.from_bytes(c.as_py(), "big") + add) % (1 << 128), 1 << 64)
            lows = np.uint64(low) + np.arange(k, dtype=np.uint64)
            out[at : at + k, 0], out[at : at + k, 1] = np.uint64(high) + (lows < np.uint64(low)), lows
            at += k
    return _binaries(16 * many, out.view(np.uint8).reshape(-1), valid)


def _xor(data: pa.Array, stream: pa.Array) -> pa.Array:
    """data by as much of its key stream; the bytes of a batch are never Python's objects."""
    valid = np.array([a.is_valid and b.is_valid for a, b in zip(data, stream, strict=True)], bool)
    raw = [np.frombuffer(c.as_buffer(), np.uint8) if v else np.zeros(0, np.uint8) for c, v in zip(data, valid, strict=True)]
    sizes = np.array([len(r) for r in raw], np.int64)
    out, at = np.empty(int(sizes.sum()), np.uint8), 0
    for a, b in zip(raw, stream, strict=True):
        if len(a):
            np.bitwise_xor(a, np.frombuffer(b.as_buffer(), np.uint8)[: len(a)], out=out[at : at + len(a)])
            at += len(a)
    return _binaries(sizes, out, valid)


def ctr(data: Column, key: Column, counter: Column, first_block: Column | None = None) -> Column:
    """AES-CTR with a 128-bit counter: the key stream is ECB of all of a value's counters, in one call.

    first_block: how many blocks come before data, so that chunks of a large value go by themselves.
    """
    first = F.lit(0).cast("bigint") if first_block is None else first_block.cast("bigint")
    blocks = F.arrow_udf(_counters, "binary")(counter, first, F.ceil(F.octet_length(data) / 16).cast("bigint"))
    return F.arrow_udf(_xor, "binary")(data, F.aes_encrypt(blocks, key, F.lit("ECB"), F.lit("PKCS")))


def ctr_blocks(rows: DataFrame, key: Column) -> DataFrame:
    """id and data of rows (id, data, counter as 16 bytes) by AES-CTR; no rows are moved."""
    return rows.select("id", ctr(F.col("data"), key, F.col("counter")).alias("data"))


def key_fingerprint(key: Column) -> Column:
    """What may be shown of a key."""
    return F.sha2(key, 256)
