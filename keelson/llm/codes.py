"""Vector code compression: product codes by Lloyd rounds with Drake-Hamerly adaptive bounds.

A component x becomes the integer floor(1024 * x); a vector is cut into equal
consecutive parts, each with a codebook of its own.  All distances that
decide are squared Euclidean distances of integers, and ties go to the entry
of the lower index.

Bounds.  Between rounds each part keeps its ``b`` closest entries, the
assigned one first and the others by a lower bound of their distance, and one
outer bound below the distance to all entries that are not listed.  When the
codebook moves, a listed bound falls by its entry's drift and the outer bound
by the largest drift.  The distance to the assigned entry is worked out
exactly; every listed entry whose bound is above it is ruled out; the others
are verified with integers; only where the outer bound does not hold are all
entries compared and the list made anew.  Bounds are rounded down, so they
rule out nothing that could win or tie.  ``b`` adapts from round to round to
the list places that were needed (at least ``LEAST``, at most ``MOST``).

How it runs: a round is one pass over the table of vectors and bounds, which
gives the next one (the one before is removed then), and an aggregate of each
task's sums by part, entry and place.  Only codebooks, sums (their size) and
the counts of needed list places reach the driver.

Defined results: repeated rows are coded like others and count as often as
they stand there; null ids are larger than all others; where an id has several
vectors the lexicographically smaller one is first; with fewer vectors than
entries the codebook is as small; vectors that can't be cut (whose length is
no positive multiple of the parts), whose length is not that of the smallest
id's, or that hold a component of 131072 or more in magnitude (no long holds
their error) are left out like null ones; a label's error beyond a long is
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import scratch, stored
from keelson.llm.vectors import matrix

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Listed entries of a part: in the first round, and the limits of later ones.
FIRST, LEAST, MOST = 8, 2, 16
#: Share of parts that may need more list places than the next round keeps.
BEYOND = 0.02
#: Components of this magnitude or more are out of range.
RANGE = float(1 << 17)
#: Integers up to here are exact in double precision.
EXACT = 1 << 53


# ---------------------------------------------------------------- distances
def all_squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of every line of ``x`` to every entry, exact integers (in doubles where those hold them)."""
    top = int(np.abs(x).max(initial=0)) + int(np.abs(book).max(initial=0))
    if x.shape[1] * top * top < EXACT:
        a, c = x.astype(np.float64), book.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    out = np.zeros((len(x), len(book)), dtype=np.int64)
    for k in range(x.shape[1]):
        step = x[:, k, None] - book[None, :, k]
        out += step * step
    return out


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of lines of ``x`` to the entry beside each, exact integers."""
    step = x - entries
    return np.einsum("ij,ij->i", step, step)


def below(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers that are surely not above the exact ones which ``x`` approximates."""
    y = (x * (1 - 1e-12)).astype(np.float32)
    return np.nextafter(y, np.float32(-np.inf))


def above(square: np.ndarray) -> np.ndarray:
    """Surely not below the distances of these squares."""
    return np.sqrt(square.astype(np.float64)) * (1 + 1e-12)


# ------------------------------------------------------------------- bounds
class Bounds:
    """The lists of one part of many vectors: ``near`` entries, their ``low`` bounds, the ``outer`` bound."""

    def __init__(self, near: np.ndarray, low: np.ndarray, outer: np.ndarray):
        self.near, self.low, self.outer = near, low, outer

    @classmethod
    def fresh(cls, square: np.ndarray, b: int) -> Bounds:
        """Lists from all squared distances (lines by entries)."""
        k = square.shape[1]
        b = min(b, k)
        if b < k:
            some = np.argpartition(square, b, axis=1)[:, :b + 1]
            some.sort(axis=1)
        else:
            some = np.broadcast_to(np.arange(k), square.shape)
        got = np.take_along_axis(square, some, axis=1)
        order = np.argsort(got, axis=1, kind="stable")
        some, got = np.take_along_axis(some, order, axis=1), np.take_along_axis(got, order, axis=1)
        # Of equally near entries the lowest index is the nearest; it may have stayed outside the cut.
        best = square.argmin(axis=1)
        some[:, 0] = np.where(got[:, 0] == got[:, -1], best, some[:, 0])
        low = below(np.sqrt(got.astype(np.float64)))
        outer = low[:, b] if b < k else np.full(len(square), np.inf, np.float32)
        return cls(some[:, :b].astype(np.uint8), low[:, :b], outer)

    def resized(self, b: int) -> Bounds:
        """The lists with ``b`` places: dropped ones go to the outer bound, new ones are empty."""
        old = self.near.shape[1]
        if b < old:
            return Bounds(self.near[:, :b], self.low[:, :b], np.minimum(self.outer, self.low[:, b:].min(axis=1)))
        more = ((0, 0), (0, b - old))
        return Bounds(np.pad(self.near, more, mode="edge"), np.pad(self.low, more, constant_values=np.inf), self.outer)

    def assign(self, x: np.ndarray, book: np.ndarray, drift: np.ndarray, b: int) -> tuple[Bounds, np.ndarray, np.ndarray]:
        """The bounds after the codebook moved to ``book`` by ``drift``, the least squares, and the list places needed.

        A place count above the list's length says that all entries were compared.
        """
        low = below(self.low.astype(np.float64) - drift[self.near])
        outer = below(self.outer.astype(np.float64) - drift.max())
        near = self.near.astype(np.int64)
        lines = np.arange(len(x))
        best, square = near[:, 0], squares(x, book[near[:, 0]])
        low[:, 0] = below(np.sqrt(square.astype(np.float64)))
        place = np.zeros(len(x), dtype=np.int64)
        doubt = low[:, 1:] <= above(square)[:, None]
        used = np.where(doubt.any(1), doubt.shape[1] + 1 - doubt[:, ::-1].argmax(1), 1) if doubt.shape[1] else np.ones(len(x), np.int64)
        for j in range(1, near.shape[1]):
            at = np.flatnonzero(doubt[:, j - 1])
            if len(at) == 0:
                continue
            entry = near[at, j]
            got = squares(x[at], book[entry])
            low[at, j] = below(np.sqrt(got.astype(np.float64)))
            wins = (got < square[at]) | ((got == square[at]) & (entry < best[at]))
            won = at[wins]
            best[won], square[won], place[won] = entry[wins], got[wins], j
        # The assigned entry first, the others by their bounds.
        key = low.copy()
        key[lines, place] = -np.inf
        order = np.argsort(key, axis=1, kind="stable")
        out = Bounds(np.take_along_axis(self.near, order, axis=1), np.take_along_axis(low, order, axis=1), outer).resized(b)
        open_ = np.flatnonzero(outer <= above(square))
        if len(open_):
            all_ = all_squares(x[open_], book)
            anew = Bounds.fresh(all_, b)
            out.near[open_], out.low[open_], out.outer[open_] = anew.near, anew.low, anew.outer
            square[open_] = all_.min(axis=1).astype(np.int64)
            used[open_] = near.shape[1] + 1
        return out, square, used


def next_length(used: dict[int, int], b: int) -> int:
    """List places for the next round from how many parts needed how many (``b`` + 1: more than listed)."""
    total = sum(used.values())
    if used.get(b + 1, 0) > BEYOND * total:
        return min(MOST, 2 * b)
    left = 0
    for n in range(b, 0, -1):
        left += used.get(n, 0)
        if left > BEYOND * total:
            return max(LEAST, min(MOST, n))
    return LEAST


# ------------------------------------------------------------------- rounds
def whole_vectors(rows: DataFrame, parts: int) -> DataFrame:
    """``(vec_id, label, v)``: the vectors that take part, as integers."""
    size = F.size("embedding")
    some = rows.where((size > 0) & (size % parts == 0)).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    some = some.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= RANGE)))
    return some.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("int")))


def smallest(vectors: DataFrame, n: int) -> list[list[int]]:
    """The vectors of the ``n`` smallest ids (each task's smallest meet in one task, not at the driver)."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(n)
    return [r.v for r in scratch(first, "codes-first").orderBy(F.asc_nulls_last("vec_id"), "v").collect()]


def pass_over(batches, names: list[str], books: list[np.ndarray], drifts: list[np.ndarray], b: int, first: bool):
    """One assignment of all vectors of a task; the rows with their new bounds."""
    parts = len(books)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x = matrix(batch.column("v")).astype(np.int64)
        n, width = len(x), x.shape[1] // parts
        near, low, outer, square, used = [], [], [], np.zeros(n, np.int64), np.zeros((n, parts), np.int8)
        if not first:
            kept = {c: matrix_of(batch.column(c), t, n) for c, t in (("near", np.uint8), ("low", np.float32), ("outer", np.float32))}
            old = kept["near"].shape[1] // parts
        for p, book in enumerate(books):
            y = x[:, p * width:(p + 1) * width]
            if first:
                all_ = all_squares(y, book)
                got = Bounds.fresh(all_, b)
                square += all_.min(axis=1).astype(np.int64)
            else:
                at = slice(p * old, (p + 1) * old)
                got, least, places = Bounds(kept["near"][:, at], kept["low"][:, at], kept["outer"][:, p]).assign(y, book, drifts[p], b)
                square += least
                used[:, p] = places
            near.append(got.near)
            low.append(got.low)
            outer.append(got.outer)
        yield pa.record_batch({**{c: batch.column(c) for c in names}, "error": pa.array(square),
                               "near": binary_of(np.hstack(near)), "low": binary_of(np.hstack(low)),
                               "outer": binary_of(np.stack(outer, axis=1)), "used": binary_of(used)})


def matrix_of(column: pa.Array, kind, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(n, -1)


def binary_of(x: np.ndarray) -> pa.Array:
    raw, step = np.ascontiguousarray(x).tobytes(), x.shape[1] * x.itemsize
    return pa.array([raw[i:i + step] for i in range(0, len(raw), step)], pa.binary())


def sums(batches, parts: int, entries: int):
    """A task's counts and component sums by part and entry, and its counts of needed list places.

    ``(slot, place, n)``: slot is part * entries + entry; place -1 holds the
    count of vectors, place -2 (slot: list places) the count of parts.
    """
    total = count = None
    needed = np.zeros(256, np.int64)
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        x = matrix(batch.column("v")).astype(np.int64)
        width = x.shape[1] // parts
        near = matrix_of(batch.column("near"), np.uint8, n)
        b = near.shape[1] // parts
        needed += np.bincount(matrix_of(batch.column("used"), np.uint8, n).ravel(), minlength=256)
        if total is None:
            total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for p in range(parts):
            slot = near[:, p * b].astype(np.int64) + p * entries
            order = np.argsort(slot, kind="stable")
            ids, at = np.unique(slot[order], return_index=True)
            total[ids] += np.add.reduceat(x[order, p * width:(p + 1) * width], at, axis=0)
            count += np.bincount(slot, minlength=parts * entries)
    if total is None:
        return
    some, deep = np.flatnonzero(count), np.flatnonzero(needed)
    width = total.shape[1]
    yield pa.record_batch({
        "slot": pa.array(np.concatenate([np.repeat(some, width), some, deep]).astype(np.int64)),
        "place": pa.array(np.concatenate([np.tile(np.arange(width), len(some)), np.full(len(some), -1), np.full(len(deep), -2)]).astype(np.int64)),
        "n": pa.array(np.concatenate([total[some].ravel(), count[some], needed[deep]]))})


def moved(books: list[np.ndarray], totals: list) -> list[np.ndarray]:
    """Each entry at the floor of its vectors' mean; unused entries stay."""
    entries = len(books[0])
    total, count = {}, {}
    for slot, place, n in totals:
        if place == -1:
            count[slot] = n
        elif place >= 0:
            total[slot, place] = n
    out = [book.copy() for book in books]
    for slot, n in count.items():
        for k in range(out[0].shape[1]):
            out[slot // entries][slot % entries, k] = total[slot, k] // n
    return out


def train(vectors: DataFrame, books: list[np.ndarray], rounds: int) -> tuple[DataFrame, list[np.ndarray], list[dict]]:
    """The vectors with their last assignment, the final codebooks, and what each round needed.

    A round's report: list places ``b`` and ``used``, how many parts needed how many (0: the first round).
    """
    parts, entries = len(books), len(books[0])
    names = ["vec_id", "label", "v"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.select(*names).schema)
    ddl = f"{kinds}, error long, near binary, low binary, outer binary, used binary"
    rows, remove, b, drifts, reports = vectors.select(*names), None, min(FIRST, entries), [], []
    for turn in range(rounds + 1):
        now = (books, drifts, b, turn == 0)
        done, gone = stored(rows.mapInArrow(lambda batches, now=now: pass_over(batches, names, *now), ddl), f"codes-{turn}")
        if remove is not None:
            remove()
        rows, remove = done, gone
        if turn == rounds:
            break
        partial = rows.select("v", "near", "used").mapInArrow(lambda batches: sums(batches, parts, entries), "slot long, place long, n long")
        totals = partial.groupBy("slot", "place").agg(F.sum("n").alias("n")).collect()
        fresh = moved(books, totals)
        drifts = [np.sqrt(squares(new, old).astype(np.float64)) * (1 + 1e-12) for new, old in zip(fresh, books)]
        books = fresh
        used = {r.slot: r.n for r in totals if r.place == -2}
        reports.append({"b": b, "used": used})
        if turn:
            b = min(next_length(used, b), entries)
    return rows, books, reports


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, code, error)`` of ``rows(vec_id, embedding, label)``, and the codebooks.

    ``code``: the bytes of the entries' indexes in part order.
    """
    kind = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    vectors = whole_vectors(rows, parts)
    first = smallest(vectors, entries)
    if not first:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind[0]}, label {kind[1]}, code binary, error long"), []
    width = len(first[0])
    if any(len(v) != width for v in first):
        first = smallest(vectors.where(F.size("v") == width), entries)
    start = np.array(first, dtype=np.int64)
    books = [np.ascontiguousarray(x) for x in np.split(start, parts, axis=1)]
    done, books, _ = train(vectors.where(F.size("v") == width), books, rounds)
    b = F.length("near").cast("int") / parts
    code = F.concat(*[F.substring(F.col("near"), (b * p + 1).cast("int"), F.lit(1)) for p in range(parts)])
    return done.select("vec_id", "label", code.alias("code"), "error"), books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the error summed over rows of an equal label (nulls together)."""
    total = codes.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return codes.join(total, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


__all__ = ["compress", "books_digest", "with_label_error", "Bounds", "train"]
