"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+`` of a text and
one end token after them; a text is read after end tokens.  The tree's states
are contexts of up to ``depth`` symbols:

* the words are counted first; then one pass over the training texts for each
  depth counts the next symbols of that depth's candidate contexts;
* a context is a candidate from a fixed number of ``occurrences`` on and lists
  each next symbol that follows it at least ``listed`` times, both whatever
  the corpus, so the model grows with the training text;
* a candidate is retained if its next symbols diverge from what its suffix
  predicts (a G-test over the listed ones and the rest), or a retained
  context ends in it;
* distributions are smoothed by the suffix's: a listed symbol of count c has
  (c + t q) / (n + t), t the number of listed ones and q its probability
  after the suffix; what is left goes to the others in the suffix's
  proportions.  The root is the add-one unigram model over all words.

A symbol is scored in the longest suffix of what precedes it that is a state.
``base_score`` is the add-one unigram model alone.

How it runs.  A gram (a run of symbols, the nearest folded in first) is a
64-bit key.  A task sums the grams of its texts, and hands them on in packed
columns by key range, so a count costs about ten bytes in the shuffle; the
tasks behind it merge them and keep only what is listed.  A gram can only be
listed if its suffix gram is, so a pass counts few of the rare ones.  Filters
of fixed size tell which contexts and grams are possible; a wrong yes costs a
row and changes no result, as exact joins follow.

For scoring, the most frequent entries of each table (at most ``broadcast`` of
words, of next symbols and of contexts a depth) are broadcast and settle nearly
all tokens in place.  A token that may need a rarer entry, be it word, gram or
context, is joined with the model's tables.  No joined key is hot: a key has
at most 1 / ``broadcast`` of the training tokens.

Defined results: a null or empty text has one token, the end; a null id
counts as the text '' for the fold, so the row trains; repeated rows count
as often as they come; no training rows give scores of 0; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import as_objects, coded_words, hash_words, mix64, scratch, slices, temporary, text_bytes, tidy

END = b"\n"  # no word
ODD = 0x9E3779B97F4A7C15
#: Places of a filter: its size is fixed.
FILTER_BITS = 24
#: Different grams that a task holds before it hands them on, and entries from which on a merging task merges.
HELD = 700_000
MERGED = 2_250_000
#: Tokens for which a merging task is planned.
TOKENS_A_TASK = 4_000_000
#: Bytes of text that are read together.
SLICE = 2 << 20


class Places:
    """Where keys stand in ``ordered`` (ascending, hashes): a key's top bits name the place to search from."""

    def __init__(self, ordered: np.ndarray):
        bits = max(1, (len(ordered) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(ordered >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
        self.ordered = np.append(ordered, np.uint64(2**64 - 1))  # a last one that is not less than any key

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = self.starts[keys >> self.shift]
        less = np.flatnonzero(self.ordered[at] < keys)
        while len(less):  # about one key has the same top bits
            at[less] += 1
            less = less[self.ordered[at[less]] < keys[less]]
        return np.where((self.ordered[at] == keys) & (at < len(self.ordered) - 1), at, -1)


def end_key() -> np.uint64:
    return hash_words(as_objects([END]))[0]


class Stream:
    """The symbols of texts on end: ``table`` of the different ones (hashes), ``codes`` into it, ``counts`` a text.

    A key folds a run of symbols, the nearest first, so that a context of ``l``
    symbols has the key of the previous symbol's level ``l - 1``.
    """

    def __init__(self, texts: pa.Array):
        codes, words, counts = coded_words(texts)
        self.counts = counts + 1
        self.first = np.cumsum(self.counts) - self.counts
        self.table = np.append(hash_words(words.to_numpy(zero_copy_only=False), distinct=True), end_key())
        self.end = len(self.table) - 1
        inside = np.ones(self.counts.sum(), bool)
        inside[self.first + counts] = False
        self.codes = np.full(len(inside), self.end, np.int32)
        self.codes[inside] = codes
        self._keys, self._contexts = [self.table[self.codes]], {}
        self._edges = [end_key()]  # the key of so many end tokens

    def _before(self, values: np.ndarray, n: int, edge) -> np.ndarray:
        """The value ``n`` places before each, or ``edge`` where that is before the text."""
        out = np.empty_like(values)
        out[n:], out[:n] = values[:max(0, len(values) - n)], edge
        for at in range(n):
            out[self.first[self.counts > at] + at] = edge
        return out

    def back(self, n: int) -> np.ndarray:
        """The code of the symbol ``n`` places before each."""
        return self._before(self.codes, n, self.end)

    def keys(self, level: int) -> np.ndarray:
        """Each symbol with the ``level`` before it."""
        while len(self._keys) <= level:
            oldest = self._before(self._keys[0], len(self._keys), end_key())
            self._keys.append(mix64(self._keys[-1] * np.uint64(ODD) + oldest))
            self._edges.append(mix64(np.array([self._edges[-1]]) * np.uint64(ODD) + end_key())[0])
        return self._keys[level]

    def contexts(self, level: int) -> np.ndarray:
        """The ``level`` symbols before each."""
        if level not in self._contexts:
            self._contexts[level] = self._before(self.keys(level - 1), 1, self._edges[level - 1])
        return self._contexts[level]


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix64`` (overwrites ``x``)."""
    def back(c: int) -> np.uint64:
        return np.uint64(pow(c, -1, 1 << 64))

    def shifted(s: int) -> None:
        y = x >> np.uint64(s)
        while y.any():  # x ^ x>>s ^ x>>2s ...
            x[:] ^= y
            y >>= np.uint64(s)

    shifted(31)
    x *= back(0x94D049BB133111EB)
    shifted(27)
    x *= back(0xBF58476D1CE4E5B9)
    shifted(30)
    return x


def suffix_grams(keys: np.ndarray, oldest: np.ndarray) -> np.ndarray:
    """The keys without their oldest symbols."""
    return (unmix64(keys.copy()) - oldest) * np.uint64(pow(ODD, -1, 1 << 64))


# ------------------------------------------------------------------ filters
class Filter:
    """Which of the places that keys' top bits name are taken."""

    def __init__(self, places: np.ndarray):
        taken = np.zeros(1 << FILTER_BITS, bool)
        taken[places] = True
        self.bits = np.packbits(taken, bitorder="little")

    @classmethod
    def of(cls, table: DataFrame) -> Filter:
        """Of the ``key`` column; at most a place a bit reaches the driver."""
        spots = table.select(F.shiftrightunsigned("key", 64 - FILTER_BITS).cast("int").alias("spot")).distinct()
        return cls(spots.toArrow().column("spot").to_numpy())

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        spot = (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return (self.bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)


# ----------------------------------------------------------------- counting
class Sums:
    """Counts of keys in bounded memory, each with a 32-bit tag."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, keys: np.ndarray, tags: np.ndarray, n: np.ndarray | None = None) -> None:
        """Counts of keys, which may repeat (``n`` given: as often as it says)."""
        if not len(keys):
            return
        order = np.argsort(keys)
        keys, tags = keys[order], tags[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n[order], first)
        self.runs.append((keys[first], tags[first], n.astype(np.int64)))
        self.pending += len(first)

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.runs:
            return np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(self.runs) > 1:
            keys, tags, n = (np.concatenate(x) for x in zip(*self.runs))
            self.runs, self.pending = [], 0
            self.add(keys, tags, n)
        return self.runs[0]

    def full(self) -> bool:
        """Whether more than ``HELD`` different ones are held."""
        if self.pending > 3 * HELD // 2:
            self.merge()
            return self.pending > HELD
        return False

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = self.merge()
        self.runs, self.pending = [], 0
        return got


def pack(keys: np.ndarray, tags: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys, tags and counts as bytes: differences of keys and counts by planes of equal weight, compressed."""
    def planes(x: np.ndarray) -> bytes:
        return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()

    raw = planes(np.diff(keys, prepend=np.uint64(0))) + planes(n) + tags.astype("<u4").tobytes()
    return len(keys).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=20 * k, codec="zstd", asbytes=True), np.uint8)

    def whole(x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x.reshape(8, -1).T).view("<u8").ravel()

    return np.cumsum(whole(raw[:8 * k]), dtype=np.uint64), raw[16 * k:].view("<u4"), whole(raw[8 * k:16 * k]).astype(np.int64)


def handed_on(got: tuple[np.ndarray, np.ndarray, np.ndarray], shards: int, whole: bool):
    """Record batches of ``(shard, whole, blob)``: the keys of each range, packed."""
    keys, tags, n = got
    if not len(keys):
        return
    bounds = np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    some = np.flatnonzero(np.diff(cuts))
    blobs = [pack(keys[cuts[i]:cuts[i + 1]], tags[cuts[i]:cuts[i + 1]], n[cuts[i]:cuts[i + 1]]) for i in some.tolist()]
    yield pa.record_batch({"shard": pa.array(some.astype(np.int64)), "whole": pa.array([whole] * len(some)), "blob": pa.array(blobs, pa.binary())})


def tag_of(ctx: np.ndarray) -> np.ndarray:
    """The upper half of a context's key, which a gram is tagged with."""
    return (ctx >> np.uint64(32)).astype(np.uint32)


def count_texts(level: int, shared, shards: int):
    """mapInArrow function: a task's packed counts of the level's possible grams, tagged by their contexts.

    Level 0: all symbols.  Above, the symbols after contexts that pass the
    first filter, where the suffix gram passes the second; and (``whole``)
    all tokens after each of those contexts.
    """
    def run(batches):
        sums, totals = Sums(), Sums()
        for batch in slices(batches, limit=SLICE):
            stream = Stream(batch.column("text"))
            if level == 0:
                n = np.bincount(stream.codes, minlength=len(stream.table))
                sums.add(stream.table, np.zeros(len(n), np.uint32), n)
            else:
                of_context, of_suffix = shared.value
                some = np.flatnonzero(of_context(stream.table)[stream.back(1)] if level == 1 else of_context(stream.contexts(level)))
                ctx = stream.contexts(level)[some]
                totals.add(ctx, np.zeros(len(ctx), np.uint32))
                here = of_suffix(stream.keys(level - 1)[some])
                sums.add(stream.keys(level)[some[here]], tag_of(ctx[here]))
            for x, whole in ((sums, False), (totals, True)):
                if x.full():
                    yield from handed_on(x.take(), shards, whole)
        yield from handed_on(sums.take(), shards, False)
        yield from handed_on(totals.take(), shards, True)
    return tidy(run)


def merge_counts(least: int):
    """mapInArrow function: the totals of whole shards, and their grams from ``least`` on."""
    def run(batches):
        sums = {False: Sums(), True: Sums()}
        for batch in batches:
            for whole, blob in zip(batch.column("whole").to_pylist(), batch.column("blob").to_pylist()):
                sums[whole].add(*unpack(blob))
                if sums[whole].pending > MERGED:
                    sums[whole].merge()
        for whole, held in sums.items():
            keys, tags, n = held.take()
            if not whole:
                some = n >= least
                keys, tags, n = keys[some], tags[some], n[some]
            for i in range(0, len(keys), 200_000):
                j = min(i + 200_000, len(keys))
                yield pa.record_batch({"key": pa.array(keys[i:j].view(np.int64)), "tag": pa.array(tags[i:j].astype(np.int64)),
                                       "n": pa.array(n[i:j]), "whole": pa.array([whole] * (j - i))})
    return tidy(run)


def counted(train: DataFrame, level: int, shared, tasks: int, least: int) -> DataFrame:
    """``(key, tag, n, whole)`` of the level; whole: all tokens after the context ``key``."""
    blobs = train.select("text").mapInArrow(count_texts(level, shared, 4 * tasks), "shard long, whole boolean, blob binary")
    merged = blobs.repartition(tasks, "shard").mapInArrow(merge_counts(least), "key long, tag long, n long, whole boolean")
    return scratch(merged, f"lm-counts-{level}", keep=level == 0)


# -------------------------------------------------------------------- model
@dataclass
class Model:
    """Tables of the training texts: words ``(key, n, log10p)``, and by depth those of the retained contexts.

    A depth has its next symbols ``(key, n, log10p)`` and its contexts
    ``(key, n, log10rest)``, n all tokens after the context and log10rest the
    factor of what it doesn't list.
    """

    tokens: int
    kinds: int
    words: DataFrame
    levels: list[tuple[DataFrame, DataFrame]]

    @property
    def size(self) -> float:
        return float(self.tokens + self.kinds + 1)


def with_suffix(rows: DataFrame) -> DataFrame:
    """``rows(key, ..., oldest)`` with ``up``, the gram without its oldest symbol."""
    def run(batches):
        for batch in batches:
            keys, oldest = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "oldest"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(suffix_grams(keys, oldest).view(np.int64))],
                                             names=[*batch.schema.names, "up"])
    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", up long")


def learn(train: DataFrame, depth: int = 3, occurrences: int = 20, listed: int = 10) -> Model:
    """The model of ``train(text)`` (bytes)."""
    with temporary():
        return _learn(train, depth, occurrences, listed)


def _learn(train: DataFrame, depth: int, occurrences: int, listed: int) -> Model:
    spark = train.sparkSession
    least_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = counted(train, 0, None, least_tasks, 1).select("key", "n")
    whole = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, size = whole.n or 0, float((whole.n or 0) + whole.v + 1)
    tasks = max(least_tasks, tokens // TOKENS_A_TASK)
    p = (F.col("n") + 1) / F.lit(size)
    below = words.where(F.col("n") >= min(listed, occurrences)).select(
        "key", F.lit(0).cast("long").alias("up"), F.col("key").alias("oldest"), "n", p.alias("p"))
    built = []
    for level in range(1, depth + 1):
        candidates = below.where(F.col("n") >= occurrences).select(F.col("key").alias("ctx"), F.col("up").alias("suffix"), "oldest")
        if candidates.isEmpty():
            break
        of_context, of_suffix = Filter.of(candidates.select(F.col("ctx").alias("key"))), Filter.of(below.where(F.col("n") >= listed))
        shared = spark.sparkContext.broadcast((of_context, of_suffix))
        counts = counted(train, level, shared, tasks, listed)
        # Another context of the same tag gives a suffix gram that there is not.
        tagged = candidates.withColumn("tag", F.shiftrightunsigned("ctx", 32))
        nexts = with_suffix(counts.where("NOT whole").drop("whole").join(tagged, "tag"))
        nexts = scratch(nexts.join(below.select(F.col("key").alias("up"), F.col("p").alias("q")), "up"), f"lm-nexts-{level}")
        totals = counts.where("whole").select(F.col("key").alias("ctx"), F.col("n").alias("total"))
        n, q = F.col("n"), F.col("q")
        sums = nexts.groupBy("ctx").agg(F.count("*").alias("t"), F.sum("n").alias("known"), F.sum("q").alias("expected"),
                                        F.sum(n * F.log(n / q)).alias("s"))
        total, rest = F.col("total"), F.col("total") - F.col("known")
        share = F.greatest(1 - F.col("expected"), F.lit(1e-12))  # of what is not listed, after the suffix
        g = 2 * (F.col("s") - F.col("known") * F.log(total) + F.when(rest > 0, rest * F.log(rest / total / share)).otherwise(0.0))
        states = candidates.join(totals, "ctx").join(sums, "ctx").select(
            "ctx", "suffix", "total", "t", (g > F.col("t") + 3 * F.sqrt(2 * F.col("t") + 1)).alias("diverges"),
            F.log10(F.greatest((rest + F.col("t") * share) / (total + F.col("t")) / share, F.lit(1e-12))).alias("log10rest"))
        states = scratch(states, f"lm-states-{level}")
        smoothed = (n + F.col("t") * q) / (total + F.col("t"))
        below = scratch(nexts.join(states.select("ctx", "total", "t"), "ctx").select("key", "up", "oldest", "n", smoothed.alias("p"), "ctx"),
                        f"lm-model-{level}", keep=True)
        built.append((below, states))
    levels, longer = [], None
    for nexts, states in reversed(built):  # a suffix of a retained context is retained
        kept = states.withColumn("wanted", F.lit(False))
        if longer is not None:
            wanted = longer.select(F.col("suffix").alias("ctx"), F.lit(True).alias("wanted")).distinct()
            kept = states.join(wanted, "ctx", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
        longer = kept = scratch(kept.where(F.col("diverges") | F.col("wanted")), "lm-kept", keep=True)
        levels.append((nexts.join(kept.select("ctx"), "ctx", "left_semi").select("key", "n", F.log10("p").alias("log10p")),
                       kept.select(F.col("ctx").alias("key"), F.col("total").alias("n"), "log10rest")))
    return Model(tokens, whole.v, words.withColumn("log10p", F.log10(p)), levels[::-1])


# ------------------------------------------------------------------ scoring
def held_out():
    """Whether a row's fold, crc32 of the id's text mod 7, is 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


class Known:
    """The most frequent entries of a table as arrays, at most ``most``, and filters of all and of the others."""

    def __init__(self, table: DataFrame, value: str, most: int):
        table = table.select("key", "n", value)
        # The least count from which on there are few enough, found among powers of two and refined once.
        sizes = table.groupBy((F.length(F.bin("n")) - 1).alias("power")).agg(F.count("*").alias("k")).orderBy(F.desc("power")).collect()
        least, held = 1, 0
        for r in sizes:
            held += r.k
            if held > most:
                least = 1 << (r.power + 1)
                room = most - (held - r.k)
                inside = table.where((F.col("n") >= 1 << r.power) & (F.col("n") < least))
                step = max(1, (1 << r.power) // 64)  # at most 64 steps within the power
                for c in inside.groupBy(F.floor(F.col("n") / step).alias("at")).agg(F.count("*").alias("k")).orderBy(F.desc("at")).collect():
                    room -= c.k
                    if room < 0:
                        break
                    least = c.at * step
                break
        got = table.where(F.col("n") >= least).select("key", value).toArrow()
        keys = got.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], got.column(value).to_numpy()[order]
        self.places = Places(self.keys)
        self.all = Filter.of(table)
        self.others = Filter.of(table.where(F.col("n") < least)) if least > 1 else None

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which are known, their values (0 for others), and which of the others there may be."""
        known, value, maybe = np.zeros(len(keys), bool), np.zeros(len(keys)), np.zeros(len(keys), bool)
        some = np.flatnonzero(self.all(keys))
        place = self.places(keys[some])
        hit = place >= 0
        known[some[hit]], value[some[hit]] = True, self.values[place[hit]]
        if self.others is not None:
            rest = some[~hit]
            maybe[rest] = self.others(keys[rest])
        return known, value, maybe


def settle(stream: Stream, known: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which words are known and their base, each token's log10 probability as far as that tells, and its open level.

    The level is -1 where the token is settled, 0 where its word must be
    looked up, above that where a rarer entry of that depth may count.
    """
    word, base = (x[stream.codes] for x in known[0][0](stream.table)[:2])
    depths = []  # from the shortest contexts: those that are, or may be, states
    live = np.arange(len(word))
    for at in range(1, len(known)):
        if at == 1:
            previous = stream.back(1)
            found = [x[previous] for x in known[1][1](stream.table)]
        else:
            found = known[at][1](stream.contexts(at)[live])
        some = found[0] | found[2]
        live = live[some]
        depths.append((live, found[0][some], found[1][some]))
    got, level, settled = np.zeros(len(word)), np.full(len(word), -1), np.zeros(len(word), bool)
    for at in range(len(known) - 1, 0, -1):
        tokens, state, left = depths[at - 1]
        open_ = ~settled[tokens]
        tokens, state, left = tokens[open_], state[open_], left[open_]
        hit, value, maybe = known[at][0](stream.keys(at)[tokens])
        done, unsure = state & hit, ~state | (~hit & maybe)
        got[tokens[done]] += value[done]
        falls = state & ~hit & ~maybe
        got[tokens[falls]] += left[falls]
        level[tokens[unsure]] = at
        settled[tokens[done | unsure]] = True
    root = ~settled
    got[root] += base[root]
    level[root & ~word] = 0
    return word, base, got, level


def score(docs: DataFrame, depth: int = 3, occurrences: int = 20, listed: int = 10, broadcast: int = 1 << 20) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs(doc_id, text)``.

    ``broadcast`` only says how many entries of a table are broadcast instead of joined.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_bytes().alias("text"), held_out().alias("held_out"))
    model = learn(rows.where(~F.col("held_out")), depth, occurrences, listed)
    top = len(model.levels)
    known = [(Known(model.words, "log10p", broadcast), None)]
    known += [(Known(nexts, "log10p", broadcast), Known(states, "log10rest", broadcast)) for nexts, states in model.levels]
    shared = spark.sparkContext.broadcast(known)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"g{at}" for at in range(top + 1)] + [f"c{at}" for at in range(1, top + 1)]

    def run(batches):
        known = shared.value
        for batch in slices(batches, limit=SLICE):
            stream = Stream(batch.column("text"))
            word, base, got, level = settle(stream, known)
            counts, first = stream.counts, stream.first
            ends = np.append(0, np.cumsum(counts))

            def lists(mask, values):
                return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(mask))[ends].astype(np.int32)), values)

            # A word that is not frequent: its key, and whether the score needs it, too.
            rare = pa.StructArray.from_arrays([pa.array(stream.keys(0)[~word].view(np.int64)), pa.array(level[~word] == 0)], ["key", "scored"])
            tail = level > 0
            fields = [pa.array((stream.keys if x[0] == "g" else stream.contexts)(int(x[1:]))[tail].view(np.int64), mask=level[tail] < int(x[1:]))
                      for x in names]
            yield pa.record_batch({
                "row": batch.column("row"), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "n_tokens": pa.array(counts), "n_known": pa.array(np.add.reduceat(word.astype(np.int64), first)),
                "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(got, first)),
                "rare": lists(~word, rare),
                "tail": lists(tail, pa.StructArray.from_arrays([pa.array(level[tail]), *fields], ["level", *names]))})

    schema = (f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
              f"rare array<struct<key: long, scored: boolean>>, tail array<struct<level: long, {', '.join(f'{x}: long' for x in names)}>>")
    scored = scratch(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text")
                     .mapInArrow(tidy(run), schema), "lm-scored")
    unseen = F.log10(F.lit(1.0) / F.lit(model.size))
    value = F.coalesce("log10p", unseen)
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.scored").join(model.words, "key", "left")
    parts = [rare.select("row", value.alias("base"), F.when(F.col("scored"), value).otherwise(0.0).alias("x"),
                         F.col("n").isNotNull().cast("long").alias("known"))]

    def part(found: DataFrame, x) -> DataFrame:
        return found.select("row", F.lit(0.0).alias("base"), x.alias("x"), F.lit(0).cast("long").alias("known"))

    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.*", F.lit(0.0).alias("so_far"))
    fallen = tail.limit(0)
    for at in range(top, 0, -1):  # what a context does not list is left to its suffix
        nexts, states = model.levels[at - 1]
        here = tail.where(F.col("level") == at).unionByName(fallen)
        here = here.join(nexts.select(F.col("key").alias(f"g{at}"), "log10p"), f"g{at}", "left")
        here = scratch(here.withColumn("log10p", F.col("so_far") + F.col("log10p")), f"lm-tail-{at}")
        parts.append(part(here.where("log10p is not null"), F.col("log10p")))
        fallen = (here.where("log10p is null").drop("log10p").join(states.select(F.col("key").alias(f"c{at}"), "log10rest"), f"c{at}", "left")
                  .withColumn("so_far", F.col("so_far") + F.coalesce("log10rest", F.lit(0.0))).select(tail.columns))
    roots = fallen.join(model.words.select(F.col("key").alias("g0"), "log10p"), "g0", "left")
    parts.append(part(roots, F.col("so_far") + value))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    sums = every.groupBy("row").agg(F.sum("base").alias("more"), F.sum("x").alias("rest"), F.sum("known").alias("also"))
    zero = F.lit(0.0)
    return (scored.drop("rare", "tail").join(sums, "row", "left")
            .withColumn("base_score", F.col("base_score") + F.coalesce("more", zero))
            .withColumn("score", F.col("score") + F.coalesce("rest", zero))
            .withColumn("n_known", F.col("n_known") + F.coalesce("also", F.lit(0)))
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"))
