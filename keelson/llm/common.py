"""Shared helpers: scratch tables, Arrow slicing, word splitting, counting.

The Python code here runs inside Spark tasks on bounded slices of one
partition.  Tables that several jobs need are written once to the cluster's
shared checkpoint folder (``scratch``), so a lost executor only repeats the
tasks whose output is missing.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.session import shared_path

#: Bytes of text that one slice holds (a longer text is a slice of its own).
SLICE_BYTES = 4 << 20


#: Rows of a narrow table (ids and counts) that one task of a stored step takes at least.
ROWS_A_TASK = 100_000


#: Removals of the scratch tables of the innermost ``temporary`` block.
_held: ContextVar[list[Callable[[], None]] | None] = ContextVar("held", default=None)


def stored(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, Callable[[], None]]:
    """Write ``df`` under the shared checkpoint folder and read it back; and a function that removes the table.

    ``rows``: about how many rows it has at most, where that is known; the
    last stage and its files then follow the rows instead of the session's
    number of shuffle partitions.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if rows is not None:
        df = df.coalesce(rows // ROWS_A_TASK + 1)
    df.write.parquet(path)

    def remove() -> None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    return spark.read.schema(df.schema).parquet(path), remove


def scratch(df: DataFrame, name: str, rows: int | None = None, keep: bool = False) -> DataFrame:
    """A stored table; inside a ``temporary`` block it lasts to its end, unless ``keep``."""
    table, remove = stored(df, name, rows)
    held = _held.get()
    if held is not None and not keep:
        held.append(remove)
    return table


@contextmanager
def temporary() -> Iterator[None]:
    """Scratch tables of the block are removed at its end; what is returned must not read them any more."""
    token = _held.set([])
    try:
        yield
    finally:
        held = _held.get()
        _held.reset(token)
        for remove in held:
            remove()


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(col: str = "text"):
    """The text as UTF-8 bytes; a null text is empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def slices(batches: Iterable[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of at most ``limit`` text bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The mapInArrow function ``run``; at a task's end, memory that it has freed goes back to the system.

    Spark keeps idle Python workers.  Else what they hold stands beside the
    memory of the stages that follow, also of those without Python.
    """
    @wraps(run)
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)
    return rows


def coded_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts (binary) as codes, the distinct words, and each text's count.

    ``lower``: A-Z are lower-cased first.  Split and coded by Arrow, so only
    distinct words may become Python objects.
    """
    column = texts.view(pa.string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    coded = split.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    # White space at either end of a text leaves an empty word.
    empty = pc.index(words, pa.scalar("")).as_py()
    if empty >= 0:
        inside = codes != empty
        ends = np.append(0, np.cumsum(inside))[ends]
        codes = codes[inside]
    return codes, words.view(pa.binary()), np.diff(ends, prepend=0)


def split_words(texts: Iterable[bytes]) -> tuple[list[bytes], np.ndarray]:
    """A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+`` of all texts in one list, and each text's count.

    ``bytes.lower`` and ``bytes.split`` are exactly those ASCII rules.
    """
    words: list[bytes] = []
    counts = []
    for t in texts:
        w = t.lower().split()
        counts.append(len(w))
        words += w
    return words, np.array(counts, dtype=np.int64)


def as_objects(words: list) -> np.ndarray:
    out = np.empty(len(words), dtype=object)
    out[:] = words
    return out


def hash_words(words: np.ndarray, distinct: bool = False) -> np.ndarray:
    """A 64-bit SipHash of each word (object array of bytes), the same in every process.

    ``distinct``: hardly any word repeats, so repeats are not looked for.
    """
    if len(words) == 0:
        return np.empty(0, dtype=np.uint64)
    return pd.util.hash_array(words, categorize=not distinct)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit words (overwrites ``x``)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Counter64:
    """Sums counts of 64-bit keys in bounded memory.

    ``add`` takes unsorted keys with repeats.  Runs are merged when they
    pile up; when the merged table passes ``limit`` keys it is handed out as
    partial counts, which the shuffle's aggregate sums anyway.
    """

    def __init__(self, limit: int = 3_000_000):
        self.limit, self.runs, self.pending = limit, [], 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            u, c = np.unique(keys, return_counts=True)
            self.runs.append((u, c.astype(np.int64)))
            self.pending += len(u)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.runs:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(self.runs) > 1:
            keys = np.concatenate([u for u, _ in self.runs])
            counts = np.concatenate([c for _, c in self.runs])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.runs = [(keys[first], np.add.reduceat(counts, first))]
        self.pending = len(self.runs[0][0])
        return self.runs[0]

    def full(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Partial counts to hand out now, or None."""
        if self.pending > 2 * self.limit:
            keys, counts = self.merge()
            if len(keys) > self.limit:
                self.runs, self.pending = [], 0
                return keys, counts
        return None
