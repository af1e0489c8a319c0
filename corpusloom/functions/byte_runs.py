"""How often each byte, or pair of bytes side by side, comes in a column of texts: counted in each task, then summed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(texts: pa.Array, n: int) -> np.ndarray:
    """Counts by the number that n bytes (1 or 2) make; a pair never reaches from one text into the next. NULL has no bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]].astype(np.int64)
    if n == 1:
        return np.bincount(body, minlength=256)
    within = np.ones(max(len(body) - 1, 0), dtype=bool)
    ends = at[1:-1] - at[0] - 1
    within[ends[(ends >= 0) & (ends < len(within))]] = False
    return np.bincount((body[:-1] << 8 | body[1:])[within], minlength=1 << 16)


def byte_runs(df: DataFrame, text: str, n: int) -> DataFrame:
    """(run, n): n bytes in hexadecimal and how often they come. A task gives one row for each run it saw, 65,536 at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 8 * n, dtype=np.int64)
        for b in batches:
            total += counts(b.column(0), n)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["code", "n"])

    by = df.select(text).mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return by.select(F.lpad(F.hex("code"), 2 * n, "0").alias("run"), "n")
