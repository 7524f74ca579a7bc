"""Packing, licences, toxicity, language model: brute force, round trips, held-out accuracy, edge cases."""

import math
import random
import time
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest_llm import EMPTY_DOCS, frame, sf_docs  # noqa: F401
from keelson.llm import licenses, packing, suffix_tree, toxicity
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None, "a"), (2, "", None), (3, "Straße İstanbul ﬁ don't <|endoftext|> <|ENDOFTEXT|> é  x 12345", "b"),
       (3, "same id", "b"), (3, "same id", "b"), (None, "no id", "b"), (7, "word " * 30_000, "b"), (8, "\x00\x1c\x85  y", "c")]


def test_tokens_equal_whole_text_encoding(sf_docs):
    texts = [t or "" for (t,) in sf_docs.select("text").collect()] + [t or "" for _, t, _ in ODD]
    tok = Tokenizer.from_file(PATH)
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    got = packing.CachedTokenizer(PATH).encode(pa.array([t.encode() for t in texts], pa.binary()))
    assert [x.tolist() for x in got] == want


def test_odd_texts_tokenise_as_wholes():
    """Random texts of marks, special tokens, separators and letters outside Latin, in slices of several lengths."""
    rng = random.Random(8)
    letters = "aabcdest'AZ.,;:!?-<|>09 \t\n\x0b\x01\x02\x1c\x85\xa0éÉßÿÀ×÷µªº\u0301\u0307İıſﬁΣςдЖ中　ー٣½😀\ufeffÄß"
    more = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " don't", "'S", "'re", "the", "ing", "Öl.", "\x01"]
    texts = ["".join(rng.choice(more) if rng.random() < 0.06 else rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 20, 60])))
             for _ in range(3000)] + ["\x85", "a", "a ", "!"]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    for step in (1, 50, 4000):
        found, tokenizer = [], packing.CachedTokenizer(PATH, limit=5000)
        for i in range(0, len(texts), step):
            found += tokenizer.encode(pa.array([t.encode() for t in texts[i:i + step]], pa.binary()))
        assert [x.tolist() for x in found] == want


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, inner):
        self.inner, self.given = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.given += len(texts)
        return self.inner.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("form", ["{}", "{}é", "4{}-{}", "д{}"])
def test_new_words_are_tokenised_in_groups(form):
    words = [form.replace("{}", "".join(chr(97 + i // 26 ** k % 26) for k in range(4))) for i in range(6400)]
    cached = packing.CachedTokenizer(PATH)
    cached.tokenizer, cached.latin = Counting(cached.tokenizer), Counting(cached.latin)
    got = cached.encode(pa.array([" ".join(words).encode()] * 2, pa.binary()))
    assert got[0].tolist() == got[1].tolist() == Tokenizer.from_file(PATH).encode(" ".join(words), add_special_tokens=False).ids
    assert cached.tokenizer.given + cached.latin.given == 100


def check_packing(rows, docs, size):
    tok = Tokenizer.from_file(PATH)
    per_doc, seqs = {}, {}
    for r in rows:
        per_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0 and len(r.ids) == 4 * r.length
            at += r.length
        assert at == pieces[0].sequence_length
        assert at == size or (at < size and at & (at - 1) == 0)
    want, got = [], []
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((repr(i), len(ids), sum(ids)))
    total = {}
    for (i, n), pieces in per_doc.items():
        cover = sorted((p.start, p.start + p.length) for p in pieces)
        times = sum(b - a for a, b in cover) / n
        assert times == int(times)
        total[(repr(i), n)] = int(times)
        if times == 1:
            assert cover[0][0] == 0 and all(a[1] == b[0] for a, b in zip(cover, cover[1:]))
            ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in sorted(pieces, key=lambda p: p.start)])
            got.append((repr(i), n, int(ids.sum())))
    once = {k for k, v in total.items() if v == 1}
    assert sorted(got) == sorted(w for w in want if w[:2] in once)
    counts = {}
    for w in want:
        counts[w[:2]] = counts.get(w[:2], 0) + 1
    assert counts == total


def test_packing_round_trip(spark, sf_docs):
    docs = sf_docs.select("doc_id", "text").union(frame(spark, ODD, "doc_id long, text string, source string")
                                                  .select("doc_id", "text"))
    rows = packing.pack(docs, PATH).collect()
    check_packing(rows, [tuple(r) for r in docs.collect()], 4096)


def test_packing_small_windows(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["the", "of", "cat"]) for _ in range(rng.randint(0, 70)))) for i in range(300)]
    rows = packing.pack(frame(spark, docs, "doc_id long, text string", 3), PATH, size=64).collect()
    check_packing(rows, docs, 64)


def test_sum_of_squares_level_is_the_brute_force_choice():
    rng = random.Random(1)
    s = packing.SumOfSquares(16)
    for n in range(400):
        length = rng.randint(1, 15)
        counts = s.counts.copy()

        def cost(h, length=length, counts=counts):
            c = counts.copy()
            if h:
                c[h] -= 1
            if h + length < 16:
                c[h + length] += 1
            return int((c[1:16] ** 2).sum())
        levels = [h for h in range(0, 17 - length) if h == 0 or counts[h]]
        assert s.level(length) == max(h for h in levels if cost(h) == min(map(cost, levels)))
        s.put((n, length, 0, np.zeros(length, np.uint32)))


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], EMPTY_DOCS), PATH).collect() == []


# --- licences ------------------------------------------------------------------------------------------------

LICENSED = [
    (1, "MIT License. mit   license! The MIT-License"), (2, "smit license mit licenses"), (3, None), (4, ""),
    (5, "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */\nx"),
    (6, "SPDX-License-Identifier: AND MIT"), (7, "CC BY CC BY ÉCC BY gnu general public license"),
    (8, "spdx-license-identifier: MIT"), (None, "Apache License"), (8, "spdx-license-identifier: MIT"),
]


def test_license_places_match_brute_force(spark, sf_docs):
    docs = sf_docs.select("doc_id", "text").union(frame(spark, LICENSED, "doc_id long, text string"))
    got = sorted((repr(r.doc_id), r.n_words, tuple(sorted((p.word, p.label) for p in r.places)))
                 for r in licenses.scan_licenses(docs).collect())
    want = []
    for i, t in docs.collect():
        n, hits = brute.license_base(t, licenses.BASE)
        want.append((repr(i), n, tuple(hits)))
    assert got == sorted(want)


def test_license_expressions(spark):
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, LICENSED, "doc_id long, text string")).collect()}
    assert got[5].labels == ["gpl-2.0-only with classpath-exception-2.0", "or:apache-2.0", "or:mit"]
    assert got[6].labels == [] and 0 < got[6].score < got[8].score <= 1
    assert got[3].score == got[4].score == 0 and got[8].labels == ["mit"] and got[8].base == []
    assert all(0 <= r.score <= 1 and set(r.base) <= set(r.labels) for r in got.values())
    assert licenses.scan_licenses(spark.createDataFrame([], EMPTY_DOCS)).collect() == []


@pytest.mark.parametrize("text,want", [
    ("MIT", ["MIT"]), ("a and b or c", ["a", "b", "and", "c", "or"]), ("a or b and c", ["a", "b", "c", "and", "or"]),
    ("(a or b) and c with d", ["a", "b", "or", "c", "d", "with", "and"]), ("GPL-2.0+ */", ["GPL-2.0+"]), ("MIT) x", ["MIT"])])
def test_shunting_yard(text, want):
    assert licenses.postfix(text) == want


@pytest.mark.parametrize("text", ["", "and", "(a or b", "a or", "()", "a and (or b)", "*"])
def test_bad_expressions(text):
    with pytest.raises(licenses.ExpressionError):
        licenses.postfix(text)


@pytest.mark.parametrize("text,must,some", [
    ("MIT", ["mit"], []), ("MIT AND GPL-2.0", ["gpl-2.0", "mit"], []), ("MIT OR GPL-2.0", [], ["gpl-2.0", "mit"]),
    ("MIT OR (MIT AND Zlib)", ["mit"], ["zlib"]), ("(MIT OR ISC) AND (MIT OR Zlib) AND X11", ["x11"], ["isc", "mit", "zlib"]),
    ("GPL-2.0+ WITH Classpath-exception-2.0 OR LicenseRef-own.1", [], ["gpl-2.0+ with classpath-exception-2.0", "licenseref-own.1"]),
    ("MIT OR MIT", ["mit"], [])])
def test_obligations_and_choices(text, must, some):
    got = licenses.evaluate(licenses.postfix(text))
    assert (sorted(got[0]), sorted(got[1] - got[0])) == (must, some)


@pytest.mark.parametrize("text", ["the quick brown fox", "MIT WITH MIT", "(MIT OR ISC) WITH Classpath-exception-2.0", "Classpath-exception-2.0",
                                  "MIT AND nothing-1.0", "MIT WITH Classpath-exception-2.0 WITH LLVM-exception"])
def test_unknown_identifiers_and_exceptions(text):
    with pytest.raises(licenses.ExpressionError):
        licenses.evaluate(licenses.postfix(text))


def test_long_expressions_and_other_columns(spark):
    text = "SPDX-License-Identifier: " + " or ".join(["MIT", "ISC"] * 200_000)
    docs = frame(spark, [(1, text, "x", 2), (2, "SPDX-License-Identifier: the quick brown fox", None, None),
                         (3, "SPDX-License-Identifier: MIT AND ISC", "y", 3)],
                 "doc_id long, text string, Labels string, n_words int")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert got[1].labels == ["or:isc", "or:mit"] and got[2].labels == [] and got[3].labels == ["isc", "mit"]
    assert 0 < got[2].score < got[1].score < got[3].score < 1


# --- toxicity ------------------------------------------------------------------------------------------------

def test_toxicity_held_out_accuracy(spark, sf_docs):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("toxic").alias("grade"))
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0
    model = toxicity.fit(docs, labels.where(~fold))
    assert list(model.cuts) == sorted(model.cuts) and len(model.cuts) == 3
    found = toxicity.score(docs, model).join(labels.where(fold), "doc_id", "inner").select(
        "rejected", labels["grade"].alias("y"), "severity").collect()
    wrong_clean = sum(r.rejected for r in found if r.y == 0) / max(1, sum(r.y == 0 for r in found))
    caught = sum(r.rejected for r in found if r.y == 1) / max(1, sum(r.y == 1 for r in found))
    assert caught >= 0.9 and wrong_clean <= 0.01


def test_severity_matches_brute_force(spark):
    """Expected severity, grade and rejection of each text from the model's weights and cuts, one by one."""
    rng = random.Random(12)
    bad, good = [f"vile{c}" for c in "abcdefgh"], [f"nice{c}" for c in "abcdefghijklmnop"]
    rows = []
    for i in range(300):
        n = rng.choice([0, 0, 1, 2, 4, 8]) if i % 3 else 0
        rows.append((i, " ".join(rng.sample(good, 6) + [rng.choice(bad) for _ in range(n)]), int(n > 0)))
    docs = frame(spark, [r[:2] for r in rows] + [(900, None), (901, ""), (0, rows[0][1])], "doc_id long, text string")
    model = toxicity.fit(docs, frame(spark, [(i, g) for i, _, g in rows], "doc_id long, grade int"))
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    for r in toxicity.score(docs, model).join(docs.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d")).collect():
        count = {}
        for w in brute.license_words(r.text):
            _, _, table = toxicity.text_features([w])
            for h in table[0].tolist():
                if h in weight:
                    count[h] = count.get(h, 0) + 1
        x = sum(weight[h] * math.log(1 + n) for h, n in count.items())
        p = [1 / (1 + math.exp(c - x)) for c in model.cuts]
        assert abs(r.severity - sum(p)) < 1e-9 and abs(r.p_toxic - p[0]) < 1e-9
        assert r.rejected == (p[0] >= 0.5) and r.grade == sum(q >= 0.5 for q in p)
    by_words = {i: t.count("vile") for i, t, _ in rows}
    mean = {n: [] for n in (0, 1, 2, 4, 8)}
    for r in toxicity.score(docs, model).where("doc_id < 300").collect():
        mean[by_words[r.doc_id]].append(r.severity)
    means = [sum(x) / len(x) for x in mean.values()]
    assert means == sorted(means)  # more toxic words, more severe


def test_cumulative_link_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, 600)
    grades = np.clip(x + rng.integers(-1, 2, 600), 0, 4) // 2  # 0..2
    row = np.flatnonzero(x)
    w, cuts = toxicity.fit_cumulative_link(row, np.zeros(len(row), int), x[row].astype(float), grades, 1, 3)
    model = toxicity.Ordinal(np.array([1], np.uint64), w, cuts)
    p = model.at_least(np.arange(5) * w[0])
    assert w[0] > 0 and cuts[0] <= cuts[1] and (np.diff(p.sum(axis=1)) > 0).all() and (p[:, 0] >= p[:, 1]).all()


def test_toxicity_edge_cases(spark):
    docs = frame(spark, [(i, t, s, "x") for i, t, s in ODD], "doc_id long, text string, source string, Severity string")
    clean = spark.createDataFrame([(1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, grade int")
    model = toxicity.fit(docs, clean)
    assert not any(r.rejected for r in toxicity.score(docs, model).collect())
    assert toxicity.keep_clean(docs, model).count() == docs.count()
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    none = spark.createDataFrame([], EMPTY_DOCS)
    assert toxicity.score(none, toxicity.fit(none, clean)).collect() == []


# --- language model -------------------------------------------------------------------------------------------

def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6)))


@pytest.mark.parametrize("broadcast", [1 << 20, 50])
def test_lm_base_matches_brute_force_and_tree_beats_it(spark, sf_docs, broadcast):
    """With few entries broadcast nearly all tokens are joined, and the scores stay the same."""
    docs = sf_docs.select("doc_id", "text").union(frame(spark, ODD, "doc_id long, text string, source string")
                                                  .select("doc_id", "text"))
    got = suffix_tree.score(docs, broadcast=broadcast).collect()
    want = brute.unigram([tuple(r) for r in docs.collect()])
    a, b = by_id([tuple(r)[:6] for r in got]), by_id(want)
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert np.allclose([x[5] for x in a], [x[5] for x in b], rtol=1e-9)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def trained(rows):
    return [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]


@pytest.mark.parametrize("broadcast", [1 << 20, 40, 0])
def test_lm_scores_are_those_of_the_whole_tree(spark, broadcast):
    """Whatever is broadcast, a score is that of the tree of all contexts and next symbols of so many occurrences."""
    rng = random.Random(4)
    word = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(word[:1 + rng.randrange(60)]) if rng.random() < 0.7 else "a b c" for _ in range(30)) for _ in range(300)]
    rows = [*enumerate(texts), *((i, "w3 never a b zz") for i in range(300, 340)), *((i, "") for i in range(340, 400)), (None, None)]
    docs = frame(spark, rows, "doc_id long, text string")
    tree = brute.Tree(trained(rows), 3, 20, 3)
    assert {len(c) for c in tree.states} == {0, 1, 2, 3}
    got = suffix_tree.score(docs.withColumn("row", F.lit("x")).withColumn("tail", F.lit(1)), occurrences=20, listed=3, broadcast=broadcast).collect()
    assert len(got) == len(rows)
    score = {r.doc_id: r.score for r in got}
    for i, text in rows:
        assert abs(score[i] - tree.score(text)) < 1e-6


def test_tree_is_a_distribution_with_longer_contexts(spark):
    """Next-symbol probabilities of every state sum to one over the vocabulary and the unseen word."""
    rng = random.Random(2)
    texts = []
    for _ in range(400):  # the third word depends on the first two together
        a, b = rng.choice("xy"), rng.choice("xy")
        texts.append(f"{a} {b} {'p' if a == b else 'q'} {rng.choice('klmn')}")
    rows = list(enumerate(texts))
    tree = brute.Tree(trained(rows), 3, 20, 5)
    for state in tree.states:
        p = sum(tree.after(state, w) for w in tree.word) + tree.after(state, b"unseen")
        assert abs(p - 1) < 1e-9
    docs = frame(spark, [*rows, (9, "x x p"), (16, "x x q")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in suffix_tree.score(docs, occurrences=20, listed=5).where("doc_id in (9, 16) and n_tokens = 4").collect()}
    assert got[9] > got[16] + 1


def test_gram_keys_fold_and_unfold():
    stream = suffix_tree.Stream(pa.array([b"a b a c", b"", b" x ", b"c"], pa.binary()))
    assert stream.counts.tolist() == [5, 1, 2, 2]
    for level in (1, 2, 3):
        oldest = stream.table[stream.back(level)]
        assert (suffix_tree.suffix_grams(stream.keys(level), oldest) == stream.keys(level - 1)).all()
    assert stream.contexts(2)[2] == stream.keys(1)[1] and stream.contexts(1)[0] == stream.contexts(1)[5] == suffix_tree.end_key()
    assert stream.contexts(2)[0] == stream.keys(1)[5]  # two end tokens, as an empty text's end after an end


def test_symbols_before_stay_within_their_text():
    rng = random.Random(6)
    texts = [[rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 9]))] for _ in range(60)]
    stream = suffix_tree.Stream(pa.array([" ".join(t).encode() for t in texts], pa.binary()))
    key = dict(zip(["a", "b", "c"], suffix_tree.hash_words(suffix_tree.as_objects([b"a", b"b", b"c"])))) | {"": suffix_tree.end_key()}
    for n in range(5):
        want = [([""] * n + t + [""])[i] for t in texts for i in range(len(t) + 1)]
        assert stream.table[stream.back(n)].tolist() == [key[w] for w in want]


def test_places_of_keys():
    rng = np.random.default_rng(5)
    for size in (0, 1, 2, 3, 1000, 1 << 12):
        held = np.unique(np.append(rng.integers(0, 1 << 64, size, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)[:size // 2]))
        asked = np.concatenate([held, held + np.uint64(1), rng.integers(0, 1 << 64, 99, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        place = {k: i for i, k in enumerate(held.tolist())}
        assert suffix_tree.Places(held)(asked).tolist() == [place.get(k, -1) for k in asked.tolist()]


def test_stream_costs_little_more_than_its_words():
    """Coding the words is most of a stream's time: no Python object is made and sought a word."""
    rng = random.Random(8)
    texts = pa.array([" ".join(f"{rng.getrandbits(40):x}" for _ in range(1000)).encode() for _ in range(100)], pa.binary())

    def least(run):
        took = []
        for _ in range(7):
            start = time.process_time()
            run(texts)
            took.append(time.process_time() - start)
        return min(took)

    assert least(suffix_tree.Stream) < 4 * least(suffix_tree.coded_words)


def test_filters_never_miss(spark):
    some = spark.range(5000).select(F.xxhash64("id").alias("key"))
    f = suffix_tree.Filter.of(some)
    assert f(some.toPandas()["key"].to_numpy(np.int64).view(np.uint64)).all()
    assert not suffix_tree.Filter.of(some.limit(0))(np.arange(9, dtype=np.uint64)).any()


def test_sums_merge_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(suffix_tree, "HELD", 50)
    rng, sums, got, want = np.random.default_rng(1), suffix_tree.Sums(), {}, {}

    def take():
        for batch in suffix_tree.handed_on(sums.take(), 3, False):
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist()):
                for k, t, n in zip(*(x.tolist() for x in suffix_tree.unpack(blob))):
                    assert shard == k * 3 >> 64
                    got[k, t] = got.get((k, t), 0) + n

    some = rng.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2)
    for _ in range(20):
        keys = rng.choice(some, 60)
        for k in keys.tolist():
            want[k, k >> 32] = want.get((k, k >> 32), 0) + 1
        sums.add(keys, suffix_tree.tag_of(keys))
        if sums.full():
            take()
    take()
    assert got == want


@pytest.mark.parametrize("most", [0, 1, 37, 300, 5000])
def test_known_holds_the_most_frequent(spark, most):
    rng = np.random.default_rng(2)
    rows = [(int(k), int(n), float(n)) for k, n in zip(rng.integers(-1 << 62, 1 << 62, 1000), rng.zipf(1.4, 1000).clip(max=10**9))]
    known = suffix_tree.Known(spark.createDataFrame(rows, "key long, n long, x double"), "x", most)
    assert len(known.keys) <= most and (most < 1000 or len(known.keys) == 1000)
    held = {k for k, n, _ in rows if np.uint64(k & (1 << 64) - 1) in set(known.keys)}
    if held and len(held) < 1000:
        assert min(n for k, n, _ in rows if k in held) > max(n for k, n, _ in rows if k not in held)
    hit, value, maybe = known(np.array([k for k, *_ in rows], np.int64).view(np.uint64))
    assert (hit | maybe).all() and [v for v, h in zip(value, hit) if h] == [x for (*_, x), h in zip(rows, hit) if h]


def test_lm_empty_and_untrained(spark):
    assert suffix_tree.score(spark.createDataFrame([], EMPTY_DOCS)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = suffix_tree.score(frame(spark, [(held, "x y")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
