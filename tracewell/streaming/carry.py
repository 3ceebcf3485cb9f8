"""Signature hits over byte chunks that arrive one by one, with the bytes that a pattern may go on from kept as state."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hits(chunks: DataFrame, pattern: bytes) -> DataFrame:
    """source and offset of a pattern in chunks (source, base, data) of streams; the chunks of a source arrive in order."""
    keep = len(pattern) - 1
    found = re.compile(b"(?=" + re.escape(pattern) + b")", re.S)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, at = state.get if state.exists else (b"", 0)
        tail, at = bytes(tail), int(at)
        for part in parts:
            bases, datas = part["base"].to_numpy(), part["data"].to_numpy()
            out: list[int] = []
            run_of: list[bytes] = [tail]  # what follows the tail without a hole is searched at once
            begin = at - len(tail)

            def search(run_of: list[bytes], begin: int, out: list[int]) -> bytes:
                whole = b"".join(run_of)
                out += [begin + m.start() for m in found.finditer(whole)]
                return whole[max(0, len(whole) - keep) :] if keep else b""

            for i in np.argsort(bases, kind="stable"):
                base, data = int(bases[i]), datas[i]
                if base != at:  # a hole: nothing goes on over it
                    search(run_of, begin, out)
                    run_of, begin = [], base
                run_of.append(data)
                at = base + len(data)
            tail = search(run_of, begin, out)
            if out:
                yield pd.DataFrame({"source": [key[0]] * len(out), "offset": out})
        state.update((tail, at))

    return chunks.groupBy("source").applyInPandasWithState(run, "source string, offset long", "tail binary, at long", "append", GroupStateTimeout.NoTimeout)
