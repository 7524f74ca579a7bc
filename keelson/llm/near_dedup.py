"""MinHash near-duplicate detection with exact confirmation.

Method: many universal hash minima per document, banded into buckets;
bucket mates are compared by signature, then confirmed on their full
shingle sets; confirmed links become components by alternating large-star
and small-star.

* Documents with the same word sequence form one class; only a class's
  representative (its smallest id) is hashed into buckets, so thousands of
  copies cost one row each and are never paired.
* Buckets are compared by stars, not by all pairs: every member with the
  bucket's smallest.  Then only buckets whose other members still lie in
  different components are open.  Documents in open buckets get exact
  buckets instead: their rarest shingles (by count among the open documents),
  so many that two sets of the similarity must share one.  In those, the
  smallest 8 (then 512, ..) members lead, the others are compared with the leaders
  outside their own component, the leaders retire, and rounds go on until no
  bucket holds two components.  A pair whose sizes, place of the shingle or
  parity bitmaps prove it dissimilar is ruled out inside the join; so every
  two documents that could link end up compared or in one component.
* Two sets at the similarity bound share none of the 32 bands of 4 minima
  with probability (1 - 0.75^4)^32 = 5e-6; the signature check passes pairs
  far below the bound (see ``sure_agreement``), and the last check is exact
  on 64-bit shingle hashes.

Defined results: a null or blank text has no shingles and links with
nothing; fewer words than a shingle make one shingle of all of them; rows
without an id take part in no link (their component is null and they are
kept); an id with several texts is one node: all its rows share a component,
and it joins what its texts link with; an empty table gives an empty result;
other columns are ignored.  ``keep_one`` goes by texts alone: a text that
nothing is similar to stays, whatever its id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.common import as_objects, fresh, hash_words, mix64, scratch, slices, split_words, temporary, text_bytes, tidy
from keelson.llm.components import connected_components


@dataclass(frozen=True)
class Banding:
    """Parameters of the method: words a shingle, similarity, bands x minima."""

    width: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    seed: int = 20240607

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.Generator(np.random.PCG64(self.seed))
        a, b = rng.integers(1, 2**63, size=(2, self.hashes), dtype=np.uint64)
        return a | np.uint64(1), b

    def sure_agreement(self) -> int:
        """Equal minima (of their low byte) that a pair at the bound has, less six standard deviations."""
        p, k = self.percent / 100, self.hashes
        return int(k * p - 6 * (k * p * (1 - p)) ** 0.5)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes.

    ``words``: the word hashes of all texts on end; ``counts``: words a text.
    """
    out = []
    odd = (np.arange(width, dtype=np.uint64) * np.uint64(2) + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15)
    end = 0
    for n in counts.tolist():
        w = words[end:end + n]
        end += n
        k = min(n, width)
        if n == 0:
            out.append(w)
            continue
        h = np.full(n - k + 1, np.uint64(k))
        for i in range(k):
            h = mix64((h + w[i:n - k + 1 + i]) * odd[i])
        out.append(np.unique(h))
    return out


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each universal hash ``(a x + b) mod 2^64 >> 32`` over the 32-bit folds of the shingles."""
    x = (shingles >> np.uint64(32))[None, :]
    best = np.full(len(a), np.uint64(2**64 - 1))
    for at in range(0, x.shape[1], 4096):
        y = a[:, None] * x[:, at:at + 4096]
        y += b[:, None]
        np.minimum(best, y.min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


#: Bytes of text that are hashed together.
SLICE = 2 << 20
#: Bits of the parity bitmap, and its 64-bit words.
BITS = 1024
MARKS = BITS // 64
SKETCH = ("doc_id long, text_hash long, n_shingles long, fp1 long, fp2 long, sig binary, bands array<long>, marks array<long>, "
          "blob binary")


def parity_marks(shingles: np.ndarray) -> np.ndarray:
    """A bitmap that each shingle flips in one place: two sets differ in at least as many shingles as theirs in bits."""
    odd = np.bincount((shingles >> np.uint64(8)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketcher(p: Banding):
    """mapInArrow function: text rows to ``SKETCH`` rows."""
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = p.coefficients()
        salt = np.arange(p.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        pack = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, limit=SLICE):
            texts = batch.column("text").to_pylist()
            words, counts = split_words(texts)
            sets = shingle_hashes(hash_words(as_objects(words)), counts, p.width)
            fps, sigs, bands, marks, blobs, end = [], [], [], [], [], 0
            for n, s in zip(counts.tolist(), sets, strict=True):
                if n == 0:
                    fps.append((0, 0))
                    sigs.append(b"")
                    bands.append([])
                    marks.append([])
                    blobs.append(b"")
                    continue
                plain = b" ".join(words[end:end + n])
                end += n
                m = minima(s, a, b)
                key = salt.copy()
                for i in range(p.rows):
                    key = mix64((key ^ m[i::p.rows]) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(i + 1))
                fps.append(np.frombuffer(hashlib.blake2b(plain, digest_size=16).digest(), np.int64).tolist())
                sigs.append((m & np.uint32(255)).astype(np.uint8).tobytes())
                bands.append(_signed(key))
                marks.append(parity_marks(s))
                blobs.append(pack.compress(plain))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "fp1": pa.array([f[0] for f in fps], pa.int64()), "fp2": pa.array([f[1] for f in fps], pa.int64()),
                "sig": pa.array(sigs, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())),
                "marks": pa.array(marks, pa.list_(pa.int64())),
                "blob": pa.array(blobs, pa.binary())})
    return run


def _sets(blobs: list[bytes], width: int) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    words, counts = split_words(unpack.decompress(x) for x in blobs)
    return shingle_hashes(hash_words(as_objects(words)), counts, width)


def agreement_filter(least: int):
    """mapInArrow function: keep pairs whose signatures agree in ``least`` places."""
    @tidy
    def run(batches):
        for x in batches:
            if x.num_rows == 0:
                continue
            one, two = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(x.num_rows, -1)
                        for c in ("sig_a", "sig_b"))
            same = (one == two).sum(axis=1) >= least
            yield x.select(["a", "b"]).filter(pa.array(same))
    return run


def exact_filter(width: int, percent: int):
    """mapInArrow function: keep pairs whose full shingle sets reach the similarity."""
    @tidy
    def run(batches):
        for batch in batches:
            for x in slices([batch], "blob_b", 1 << 20):
                a, b = x.column("a"), x.column("b")
                known: dict[int, np.ndarray] = {}
                for c, key in (("blob_a", a), ("blob_b", b)):
                    new = {k: v for k, v in zip(key.to_pylist(), x.column(c).to_pylist(), strict=True) if k not in known}
                    known |= dict(zip(new, _sets(list(new.values()), width), strict=True))
                keep = []
                for i, j in zip(a.to_pylist(), b.to_pylist(), strict=True):
                    s, t = known[i], known[j]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(100 * both >= percent * (len(s) + len(t) - both))
                yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def confirmed(pairs: DataFrame, cards: DataFrame, p: Banding) -> DataFrame:
    """The pairs ``(a, b)`` that reach the similarity: by size, by signature, then exactly.

    ``cards``: ``(id, n_shingles, sig, blob)``, one row an id.  A leader that
    many pairs share is a skewed key of a plain two-shuffle join, which AQE
    splits.
    """
    def side(name: str, *cols: str) -> DataFrame:
        return cards.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in cols])

    n_a, n_b = F.col("n_shingles_a"), F.col("n_shingles_b")
    close = (pairs.join(side("a", "n_shingles", "sig"), "a").join(side("b", "n_shingles", "sig"), "b")
             .where(100 * F.least(n_a, n_b) >= p.percent * F.greatest(n_a, n_b))
             .select("a", "b", "sig_a", "sig_b").mapInArrow(agreement_filter(p.sure_agreement()), "a long, b long"))
    close = scratch(close, "dedup-close")
    return (close.join(side("a", "blob"), "a").join(side("b", "blob"), "b")
            .select("a", "b", "blob_a", "blob_b").mapInArrow(exact_filter(p.width, p.percent), "a long, b long"))


def star_pairs(rows: DataFrame, lead: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``, a < b: each row of a bucket with the bucket's leaders outside its component.

    Rows and leaders have ``held``, how many of their ``n`` shingles others
    may share from this bucket's on, and maybe ``marks``.  Pairs that the
    sizes or the bitmaps rule out for certain are not made.
    """
    one, two = rows.alias("one"), lead.alias("two")
    col = lambda name: (F.col(f"one.{name}"), F.col(f"two.{name}"))
    (n_a, n_b), most = col("n"), F.least(*col("held"))
    near = ((F.col("one.key") == F.col("two.key")) & (F.col("one.id") != F.col("two.id"))
            & (F.col("one.component") != F.col("two.component")) & (100 * most >= percent * (n_a + n_b - most)))
    if "m0" in rows.columns:
        # 100 overlap >= percent union, with overlap = (n_a + n_b - difference) / 2
        differ = sum((F.bit_count(F.col(f"one.m{i}").bitwiseXOR(F.col(f"two.m{i}"))) for i in range(MARKS)), F.lit(0))
        near &= 100 * (n_a + n_b - differ) >= percent * (n_a + n_b + differ)
    pairs = one.join(two, near).select(F.least("one.id", "two.id").alias("a"), F.greatest("one.id", "two.id").alias("b"))
    return pairs.distinct()


def open_rows(rows: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """``rows`` (at most ``n``) of the buckets that hold two components or more, each with its present component."""
    own = [c for c in rows.columns if c != "component"]
    at = scratch(rows.select(*own).join(labels, "id", "left")
                 .select(*own, F.coalesce("component", "id").alias("component")), "dedup-at", n)
    several = (at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
               .where("lo < hi").select("key"))
    return at.join(several, "key", "left_semi")


def shingle_rows(width: int):
    """mapInArrow function: ``(id, n_shingles, key)`` for each shingle of each blob."""
    @tidy
    def run(batches):
        for batch in batches:
            for x in slices([batch], "blob", 1 << 20):
                sets = _sets(x.column("blob").to_pylist(), width)
                size = np.array([len(t) for t in sets])
                yield pa.record_batch({"id": pa.array(np.repeat(x.column("id").to_numpy(), size)),
                                       "n_shingles": pa.array(np.repeat(size, size)),
                                       "key": pa.array(_signed(np.concatenate(sets)))})
    return run


def rare_buckets(ids: DataFrame, cards: DataFrame, p: Banding) -> DataFrame:
    """``(key, id, n, held, m0, ..)``: of each document's shingles from the rarest on, the first ``n - ceil(share n) + 1``.

    Two sets of that similarity share one of them, as what follows is too
    little for the overlap.  A shingle that only one of the documents has
    counts among the first but makes no bucket.  ``held`` counts the shingles
    from this one on, which bounds the overlap of two sets that share no
    rarer one.
    """
    rows = scratch(cards.join(ids, "id", "left_semi").select("id", "blob")
                   .mapInArrow(shingle_rows(p.width), "id long, n_shingles long, key long"), "dedup-shingles")
    common = scratch(rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "dedup-common")
    held = rows.join(common, "key")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "key"))
    n = F.col("n_shingles")
    first = n - F.ceil(n * p.percent / 100) + 1
    kept = (held.withColumn("rank", rank).withColumn("held", F.count("*").over(Window.partitionBy("id")))
            .where(F.col("rank") + n - F.col("held") <= first))
    marks = cards.select("id", *[F.col("marks")[i].alias(f"m{i}") for i in range(MARKS)])
    return kept.select("key", "id", n.alias("n"), (F.col("held") - F.col("rank") + 1).alias("held")).join(marks, "id")


def joined_by_ids(rows: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame | None:
    """``(doc_id, component)`` of the ids that hold several texts (or texts and blanks), and of what they join; else None.

    ``rows(doc_id, fp1, fp2, n_shingles)``.  Also returned, as rows without a
    doc_id: ``(label, component)`` of every text component that an id joins to others.
    """
    several = scratch(rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
                      .agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("fp1", "fp2") for f in (F.min, F.max)])
                      .where("min_fp1 <> max_fp1 OR min_fp2 <> max_fp2").select("doc_id"), "dedup-several")
    if several.isEmpty():
        return None
    texts = rows.where("n_shingles > 0").join(several, "doc_id", "left_semi").select("doc_id", "fp1", "fp2").distinct()
    label = classes.join(labels.withColumnRenamed("component", "_c"), "id", "left").select("fp1", "fp2", F.coalesce("_c", "id").alias("label"))
    held = scratch(texts.join(label, ["fp1", "fp2"]).select("doc_id", "label"), "dedup-held")
    least = held.groupBy("doc_id").agg(F.min("label").alias("least"))
    edges = held.join(least.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d")).select(
        F.col("label").alias("a"), F.col("least").alias("b")).where("a <> b")
    merged = scratch(connected_components(edges), "dedup-merged").withColumnRenamed("id", "label")
    ids = least.join(merged.withColumnRenamed("label", "least"), "least", "left").select("doc_id", F.coalesce("component", "least").alias("component"))
    return (ids.withColumn("label", F.lit(None).cast("long"))
            .unionByName(merged.withColumn("doc_id", F.lit(None).cast("long"))))


def near_duplicates(docs: DataFrame, params: Banding = Banding()) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, component_id, text_component)`` for each row of ``docs(doc_id, text)``.

    ``text_hash`` is ``xxhash64(text)``, so a caller can find the row again.
    ``text_component`` numbers the components by texts alone (null: blank, or no id).
    """
    with temporary():  # only the result is kept
        return scratch(_components(docs, params), "dedup-result", keep=True)


def _components(docs: DataFrame, p: Banding) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       text_bytes().alias("text"))
    sketch = scratch(rows.mapInArrow(sketcher(p), SKETCH), "dedup-sketch")
    named = sketch.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))

    # A class's id is a number of its own, in the order of the classes' smallest doc_ids.
    order = ["first", "fp1", "fp2"]
    classes = named.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("first")).repartitionByRange(*order).sortWithinPartitions(*order)
    classes = scratch(classes.withColumn("id", F.monotonically_increasing_id()), "dedup-classes")
    rep = classes.withColumnRenamed("first", "doc_id")
    buckets = (named.select("fp1", "fp2", "doc_id", F.col("n_shingles").alias("n"), "bands").join(rep, ["fp1", "fp2", "doc_id"])
               .select("id", "n", F.explode("bands").alias("key")).distinct())
    shared = buckets.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    live = scratch(buckets.join(shared, "key", "left_semi")
                   .select("key", "id", "n", F.col("n").alias("held"), F.col("id").alias("component")), "dedup-buckets")

    wanted = rep.join(live.select("id").distinct(), "id", "left_semi")
    cards = scratch(named.select("fp1", "fp2", "doc_id", "n_shingles", "sig", "marks", "blob")
                    .join(wanted, ["fp1", "fp2", "doc_id"]).dropDuplicates(["id"])
                    .select("id", "n_shingles", "sig", "marks", "blob"), "dedup-cards")

    n = live.count()
    lead = scratch(live.groupBy("key").agg(F.min(F.struct("id", "n", "held", "component")).alias("x"))
                   .select("key", "x.*"), "dedup-lead", n)
    links = scratch(confirmed(star_pairs(live, lead, p.percent), cards, p), "dedup-links")
    labels = scratch(connected_components(links), "dedup-labels")
    rest = open_rows(live.join(lead.select("key", "id"), ["key", "id"], "left_anti"), labels, n)
    live = scratch(rare_buckets(rest.select("id").distinct(), cards, p), "dedup-rare")
    n = live.count()
    width = 8
    while not (at := scratch(open_rows(live, labels, n), "dedup-open", n)).isEmpty():
        rank = F.row_number().over(Window.partitionBy("key").orderBy("id"))
        lead = scratch(at.withColumn("rank", rank).where(F.col("rank") <= width).drop("rank"), "dedup-lead", n)
        found = scratch(confirmed(star_pairs(at, lead, p.percent), cards, p), "dedup-found")
        if not found.isEmpty():
            links = links.union(found)
            labels = scratch(connected_components(links), "dedup-labels")
        live = at.join(lead.select("key", "id"), ["key", "id"], "left_anti")
        width *= 64

    first = classes.select(F.col("id").alias("component"), F.col("first").alias("component_id"))
    label = classes.join(labels, "id", "left").select("fp1", "fp2", F.coalesce("component", "id").alias("text_component"))
    joined = joined_by_ids(sketch.select("doc_id", "fp1", "fp2", "n_shingles"), labels, classes)
    if joined is None:
        named_class = label.withColumn("component", F.col("text_component"))
    else:
        more = joined.where("label IS NOT NULL").select(F.col("label").alias("text_component"), "component")
        named_class = label.join(more, "text_component", "left").withColumn("component", F.coalesce("component", "text_component"))
    named_class = scratch(named_class.join(first, "component").select("fp1", "fp2", "text_component", "component_id"), "dedup-named")
    # Blank rows have the fingerprint (0, 0), which no class has; spread them by their id.
    alone = F.col("n_shingles") == 0
    left = sketch.select("doc_id", "text_hash", "n_shingles",
                         F.when(alone, F.col("doc_id")).otherwise(F.col("fp1")).alias("fp1"),
                         F.when(alone, F.lit(None).cast("long")).otherwise(F.col("fp2")).alias("fp2"))
    found = left.join(named_class, ["fp1", "fp2"], "left")
    named_row = F.col("doc_id").isNotNull()
    component = F.coalesce("component_id", "doc_id")
    if joined is not None:  # a blank row of an id that holds texts, too
        ids = joined.where("doc_id IS NOT NULL").select("doc_id", "component").join(first, "component").select(
            "doc_id", F.col("component_id").alias("of_id"))
        found = found.join(ids, "doc_id", "left")
        component = F.coalesce("of_id", "component_id", "doc_id")
    return found.select("doc_id", "text_hash", "n_shingles", F.when(named_row, component).alias("component_id"),
                        F.when(named_row, F.col("text_component")).alias("text_component"))


def keep_one(docs: DataFrame, params: Banding = Banding()) -> DataFrame:
    """``docs`` with one row of each component of texts, all its columns.

    The row of the smallest id stays; of repeated rows of that id, one.
    Rows without an id stay, and one of each id's equal blank rows.
    """
    h, found = fresh(docs, "text_hash"), near_duplicates(docs, params)
    texts = (found.where(F.col("text_component").isNotNull()).groupBy("text_component")
             .agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*"))
    blank = found.where(F.col("text_component").isNull() & F.col("doc_id").isNotNull()).select("doc_id", "text_hash")
    keep = texts.unionByName(blank).withColumnRenamed("text_hash", h)
    hashed = docs.withColumn(h, F.xxhash64("text"))
    return (hashed.where(F.col("doc_id").isNotNull()).join(keep, ["doc_id", h], "left_semi")
            .dropDuplicates(["doc_id", h]).select(*docs.columns)
            .unionByName(docs.where(F.col("doc_id").isNull())))
