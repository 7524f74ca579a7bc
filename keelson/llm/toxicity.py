"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features of a text: its words (runs of ASCII letters and digits or of
non-ASCII characters, A-Z lower-cased) and their prefixes of 4, 5 and 6
bytes, each valued log(1 + occurrences).  The model has one weight vector
that all ordered thresholds share:

    P(grade >= k) = sigmoid(w . x - cut_k),   cut_1 <= cut_2 <= ...

and the expected severity is the sum of those probabilities.

Fitting takes a bounded sample of the labelled rows: the ``sample`` rows of
least seeded hash in each of two classes (grade 0, grade above 0), and the
``max_features`` features most tied to toxic rows by a G-test on the whole
sample's document counts (counted in Spark).  Scoring covers every row and
whole texts, row by row, without a shuffle.

Defined results: a null or empty text has no features and scores by the
cuts alone; labels with a null id or grade are ignored, the largest grade
of a repeated id counts; with no labelled rows, or none of one class,
nothing is rejected; an empty table gives an empty result; other columns
are ignored by ``score`` and carried along by ``keep_clean``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import as_objects, fresh, hash_words, scratch, slices, temporary, text_bytes, tidy

PREFIXES = (4, 5, 6)
#: Bytes of text whose features are taken together.
SLICE = 2 << 20
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32
                  for b in range(256))


def text_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of each word, word code, feature hashes by code)``; 0 is no feature."""
    words, counts = [], []
    for t in texts:
        w = t.translate(_TO_WORDS).split()
        counts.append(len(w))
        words += w
    rows = np.repeat(np.arange(len(texts)), counts)
    codes, unique = pd.factorize(as_objects(words))
    table = np.zeros((len(unique), 1 + len(PREFIXES)), np.uint64)
    if len(unique):
        table[:, 0] = hash_words(as_objects(list(unique)))
        long = np.array([len(w) for w in unique])
        for j, k in enumerate(PREFIXES, 1):
            at = np.flatnonzero(long >= k)
            table[at, j] = hash_words(as_objects([b"%d:%b" % (k, unique[i][:k]) for i in at]))
    return rows, codes, table


@dataclass
class Ordinal:
    """A fitted model: features (sorted hashes), their weights, and the ordered cuts."""

    features: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    cuts: np.ndarray = field(default_factory=lambda: np.array([8.0, 12.0, 16.0]))

    def matrix(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Non-zeros ``(row, feature, occurrences)`` of the model's features, and each row's words that have one."""
        none = np.empty(0, np.int64)
        rows, codes, table = text_features(texts)
        if len(self.features) == 0 or len(table) == 0:
            return none, none, none, np.zeros(len(texts), np.int64)
        spot = np.searchsorted(self.features, table).clip(max=len(self.features) - 1)
        hit = self.features[spot] == table
        some = hit.any(axis=1)[codes]
        rows, codes = rows[some], codes[some]
        evidence = np.bincount(rows, minlength=len(texts))
        keys = [rows[on] * len(self.features) + spot[codes[on], j]
                for j in range(table.shape[1]) for on in [hit[codes, j]]]
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        return key // len(self.features), key % len(self.features), n, evidence

    def linear(self, texts: list[bytes]) -> np.ndarray:
        row, col, n, _ = self.matrix(texts)
        return np.bincount(row, np.log1p(n) * self.weights[col], minlength=len(texts))

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., a column each."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -500, 500)))


def fit_cumulative_link(row, col, value, grades, n_features, levels, l2=1e-3, steps=1000, rate=0.1):
    """Weights and ordered cuts by full-batch Adam on the mean log loss (deterministic).

    Cuts are cut_1 plus positive gaps (softplus), so they stay ordered; a
    grade without rows is held in place by the l2 pull on the gaps.
    """
    n, k = len(grades), levels - 1
    share = [(np.sum(grades >= j + 1) + 0.5) / (n + 1) for j in range(k)]
    first = float(np.log((1 - share[0]) / share[0]))
    theta = np.concatenate([np.zeros(n_features), [first], np.zeros(k - 1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, steps + 1):
        w, gaps = theta[:n_features], theta[n_features + 1:]
        cuts = theta[n_features] + np.concatenate([[0], np.cumsum(np.logaddexp(0, gaps))])
        s = np.bincount(row, value * w[col], minlength=n)
        upper = np.concatenate([np.ones((n, 1)), sig(s[:, None] - cuts[None, :]), np.zeros((n, 1))], axis=1)
        slope = upper * (1 - upper)
        i = np.arange(n)
        p = np.maximum(upper[i, grades] - upper[i, grades + 1], 1e-12)
        d_s = -(slope[i, grades] - slope[i, grades + 1]) / p / n
        d_cut = np.zeros(k + 2)
        np.add.at(d_cut, grades, slope[i, grades] / p / n)
        np.add.at(d_cut, grades + 1, -slope[i, grades + 1] / p / n)
        d_cut = d_cut[1:k + 1]
        later = np.cumsum(d_cut[::-1])[::-1]
        grad = np.concatenate([np.bincount(col, value * d_s[row], minlength=n_features) + l2 * w / 100,
                               [later[0]], later[1:] * sig(gaps) + l2 / 100 * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = theta[n_features + 1:]
    return theta[:n_features], theta[n_features] + np.concatenate([[0], np.cumsum(np.logaddexp(0, gaps))])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, seed: int) -> DataFrame:
    """``(doc_id, text, grade)`` of at most ``sample`` labelled ids in each class.

    The chosen ids are at most ``2 * sample`` rows, which bounds the broadcast.
    """
    one = (labels.where("doc_id is not null and grade is not null")
           .groupBy("doc_id").agg(F.max(F.col("grade").cast("int")).alias("grade")))
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    ids = (one.where("grade = 0").orderBy(*order).limit(sample)
           .unionByName(one.where("grade > 0").orderBy(*order).limit(sample)))
    return docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(ids), "doc_id")


@tidy
def _document_counts(batches):
    """Documents of each class that hold a feature, summed within the task."""
    seen: dict[bool, list] = {False: [], True: []}
    for batch in slices(batches, limit=SLICE):
        rows, codes, table = text_features(batch.column("text").to_pylist())
        toxic = batch.column("grade").to_numpy(zero_copy_only=False) > 0
        if not len(rows):
            continue
        for j in range(table.shape[1]):
            names, spot = np.unique(table[:, j], return_inverse=True)
            key = np.unique(rows * len(names) + spot[codes])
            of, name = toxic[key // len(names)], names[key % len(names)]
            for c in (False, True):
                seen[c].append(name[(of == c) & (name != 0)])
    for c, parts in seen.items():
        if parts:
            u, n = np.unique(np.concatenate(parts), return_counts=True)
            for at in range(0, len(u), 100_000):
                k = n[at:at + 100_000].astype(np.int64)
                zero = np.zeros_like(k)
                yield pa.record_batch({"feature": pa.array(u[at:at + 100_000].view(np.int64)),
                                       "toxic": pa.array(k if c else zero), "clean": pa.array(zero if c else k)})


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000, max_features: int = 4096, levels: int = 4,
        refine: tuple[int, ...] = (2, 6), seed: int = 7) -> Ordinal:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, grade)``.

    ``levels`` grades 0 .. levels - 1.  Where the labels only tell 0 from 1
    and ``refine`` is given, grade 1 is split by the number of its words that
    have a selected feature: one grade more from each bound of ``refine`` on.
    """
    with temporary():
        return _fit(docs, labels, sample, max_features, levels, refine, seed)


def _fit(docs: DataFrame, labels: DataFrame, sample: int, max_features: int, levels: int, refine: tuple[int, ...], seed: int) -> Ordinal:
    rows = scratch(labelled_sample(docs, labels, sample, seed), "toxicity-sample")
    size = {r.toxic: r.n for r in rows.groupBy((F.col("grade") > 0).alias("toxic"))
            .agg(F.count_distinct("doc_id").alias("n")).collect()}
    if not size.get(True) or not size.get(False):
        return Ordinal()
    t_all, c_all = float(size[True]), float(size[False])
    counts = (rows.mapInArrow(_document_counts, "feature long, toxic long, clean long")
              .groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")))
    t, c = F.col("t"), F.col("c")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g = (part(t, (t + c) * (t_all / (t_all + c_all))) + part(c, (t + c) * (c_all / (t_all + c_all)))
         + part(t_all - t, (t_all + c_all - t - c) * (t_all / (t_all + c_all)))
         + part(c_all - c, (t_all + c_all - t - c) * (c_all / (t_all + c_all))))
    best = (counts.where((t >= 3) & (t / t_all > 4 * c / c_all)).withColumn("g", g).where("g > 6")
            .orderBy(F.desc("g"), "feature").limit(max_features).select("feature").collect())
    model = Ordinal(np.sort(np.array([r.feature for r in best], np.int64).view(np.uint64)))

    @tidy
    def nonzeros(batches):
        for batch in slices(batches, limit=SLICE):
            texts = batch.column("text").to_pylist()
            row, col, n, evidence = model.matrix(texts)
            ends = np.searchsorted(row, np.arange(len(texts) + 1))
            part = lambda x: pa.array([x[i:j].tolist() for i, j in zip(ends, ends[1:])], pa.list_(pa.int32()))
            yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()),
                                   "grade": batch.column("grade").cast(pa.int32()),
                                   "evidence": pa.array(evidence.astype(np.int64)), "f": part(col), "n": part(n)})

    found = (rows.mapInArrow(nonzeros, "doc_id long, grade int, evidence long, f array<int>, n array<int>")
             .groupBy("doc_id").agg(F.min(F.struct("grade", "evidence", "f", "n")).alias("x"))
             .orderBy("doc_id").select("x.*").collect())
    grades = np.array([r.grade for r in found])
    if refine and grades.max() == 1:
        evidence = np.array([r.evidence for r in found])
        grades = grades * (1 + sum((evidence >= bound).astype(int) for bound in refine))
    row = np.repeat(np.arange(len(found)), [len(r.f) for r in found])
    col = np.array([x for r in found for x in r.f], np.int64)
    value = np.log1p(np.array([x for r in found for x in r.n], np.float64))
    model.weights, model.cuts = fit_cumulative_link(row, col, value, np.minimum(grades, levels - 1),
                                                    len(model.features), levels)
    return model


def score(docs: DataFrame, model: Ordinal, reject_at: float = 0.5) -> DataFrame:
    """``(doc_id, severity, p_toxic, grade, rejected)`` for each row.

    ``severity``: expected grade; ``grade``: the largest grade reached with
    probability one half; ``rejected``: P(grade >= 1) >= ``reject_at``.
    """
    @tidy
    def run(batches):
        for batch in slices(batches, limit=SLICE):
            p = model.at_least(model.linear(batch.column("text").to_pylist()))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "severity": pa.array(p.sum(axis=1)),
                                   "p_toxic": pa.array(p[:, 0]), "grade": pa.array((p >= 0.5).sum(axis=1).astype(np.int32)),
                                   "rejected": pa.array(p[:, 0] >= reject_at)})
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", text_bytes().alias("text"))
            .mapInArrow(run, f"doc_id {kind}, severity double, p_toxic double, grade int, rejected boolean"))


def keep_clean(docs: DataFrame, model: Ordinal, reject_at: float = 0.5) -> DataFrame:
    """``docs``, all columns, without the rows that the model rejects."""
    raw = fresh(docs, "text")

    @tidy
    def run(batches):
        for batch in slices(batches, raw, SLICE):
            p = model.at_least(model.linear(batch.column(raw).to_pylist()))[:, 0]
            yield batch.filter(pa.array(p < reject_at)).select(batch.schema.names[:-1])
    return docs.withColumn(raw, text_bytes()).mapInArrow(run, docs.schema)
