"""Near duplicates, mixing and the pipeline: brute force and edge cases."""

import random
import subprocess
import sys

import brute
import corpus_pipeline
import pyarrow as pa
import pytest
from conftest_llm import EMPTY_DOCS, SF01, frame, sf_docs  # noqa: F401
from keelson.llm import components, mixing, near_dedup, packing, toxicity
from pyspark.sql import functions as F


def planted(seed, groups=12, size=9):
    """Families of copies edited more and more, some below and some above the bound, and a shared line."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 8, 40, 90]))
        for k in range(size):
            w = list(base)
            for _ in range(k * len(w) // 60):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            line = "one line that many of them share word for word " if rng.random() < 0.3 else ""
            rows.append((n, line + rng.choice([" ", "\n", "  "]).join(w).title()))
            n += 1
    return rows


def test_components_match_brute_force(spark):
    rows = planted(1) + planted(2, 4, 30)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == brute.components(rows)


def test_sf_components_match_brute_force(sf_docs):
    rows = [tuple(r) for r in sf_docs.select("doc_id", "text").collect()]
    found = near_dedup.near_duplicates(sf_docs).collect()
    assert {r.doc_id: r.component_id for r in found} == brute.components(rows)
    size = {i: len(brute.shingles(t)) for i, t in rows}
    assert all(r.n_shingles == size[r.doc_id] for r in found) and len(found) == len(rows)


ODD = [(5, None), (6, ""), (7, " \n\t"), (8, "A b"), (9, "a B"), (9, "a B"), (None, "a b"), (None, None),
       (10, "x " * 30_000), (11, "x " * 29_000), (12, "a\u00a0b c d e f g"), (13, "a b c d e f g")]


def test_dedup_edge_cases(spark):
    docs = frame(spark, [(i, t, "s", j) for j, (i, t) in enumerate(ODD)], "doc_id long, text string, Component_ID string, key int")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id)
                 for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(-1, 0, None), (-1, 1, None), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8), (9, 1, 8),
                   (10, 1, 10), (11, 1, 10), (12, 2, 12), (13, 3, 13)]
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, -1, 5, 6, 7, 8, 10, 12, 13]
    same = frame(spark, [(1, "q r s"), (1, "q r s"), (1, "other text here")], "doc_id long, text string")
    assert sorted(r.text for r in near_dedup.keep_one(same).collect()) == ["other text here", "q r s"]
    empty = spark.createDataFrame([], EMPTY_DOCS)
    assert near_dedup.near_duplicates(empty).collect() == [] and near_dedup.keep_one(empty).collect() == []


def test_ids_with_several_texts(spark):
    """An id joins what its texts link with; a text that only shares an id is kept."""
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a), (5, a), (5, b), (9, b), (20, b + " more"), (30, "alone here"), (30, None), (40, ""), (40, "c d"), (41, "c d"),
            (50, "p q"), (50, "r s"), (51, "t u"), (51, "r s"), (52, "t u"), (None, a)]
    docs = frame(spark, rows, "doc_id long, text string")
    got = {}
    for r in near_dedup.near_duplicates(docs).where("doc_id is not null").collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    assert got == {i: {c} for i, c in brute.components([r for r in rows if r[0] is not None]).items()}
    kept = sorted(((r.doc_id or 0, r.text or "") for r in near_dedup.keep_one(docs).collect()))
    assert kept == [(0, a), (1, a), (5, b), (20, b + " more"), (30, ""), (30, "alone here"), (40, ""), (40, "c d"), (50, "p q"), (50, "r s"),
                    (51, "t u")]
    many = [(i % 40, f"w{i} x{i % 7} y{i % 11}") for i in range(400)]
    found = near_dedup.near_duplicates(frame(spark, many, "doc_id long, text string")).collect()
    want = brute.components(many)
    assert all(r.component_id == want[r.doc_id] for r in found)
    assert near_dedup.keep_one(frame(spark, many, "doc_id long, text string")).count() == len({t for _, t in many})


def test_connected_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, j) for j in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {199: 199, 200: 199}


# --- mixing --------------------------------------------------------------------------------------------------

def sizes_of(rows):
    out = {}
    for _, t, s in rows:
        out[s] = out.get(s, 0) + len(brute.WORD.findall((t or "").encode()))
    return out


def check_mix(got, rows, near):
    sizes = sizes_of(rows)
    want, taken = brute.targets(sizes), {}
    text = {}
    for i, t, s in rows:
        text.setdefault(i, []).append((s, len(brute.WORD.findall((t or "").encode()))))
    assert len(got) == len(rows)
    for r in got:
        s = next(s for s, n in text[r.doc_id] if n == r.size)
        assert r.source_size == sizes[s] and abs(r.target - want[s]) <= 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= near * want[s] + 8, (s, t, want[s])


def test_mix_meets_targets(spark, sf_docs):
    rows = [tuple(r) for r in sf_docs.select("doc_id", "text", "source").collect()]
    rows += [(100_000 + i, "a b c", f"tiny{i}") for i in range(4)] + [(100_010, "x y z " * 50, None)]
    docs = frame(spark, rows, "doc_id long, text string, source string", 3)
    got = mixing.takes(docs).collect()
    check_mix(got, rows, 0.01)
    again = mixing.takes(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_rows_hold_what_is_taken(spark, sf_docs):
    docs = sf_docs.withColumn("Size", F.lit("clash")).withColumn("target", F.lit(1))
    want = {r.doc_id: r.taken for r in mixing.takes(docs).collect() if r.taken}
    rows = mixing.mix(docs)
    assert rows.columns == docs.columns
    got, whole = {}, {r.doc_id: r.text for r in docs.collect()}
    for r in rows.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(brute.WORD.findall(r.text.encode()))
        assert r.n_chars == len(r.text)
        assert r.text == whole[r.doc_id] or set(brute.WORD.findall(r.text.encode())) <= set(brute.WORD.findall(whole[r.doc_id].encode()))
    assert got == want


def test_mix_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "one two three", None), (None, "four", None), (4, "x " * 5000, "a"), (4, "x " * 5000, "a")]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    got = mixing.takes(docs).collect()
    check_mix(got, rows, 0.02)
    assert mixing.takes(spark.createDataFrame([], EMPTY_DOCS)).collect() == []
    assert mixing.mix(spark.createDataFrame([], EMPTY_DOCS)).collect() == []
    blank = frame(spark, [(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.takes(blank).collect()] == [(0, 0.0, 0)] * 2


def test_null_ids_spread_over_shards(spark):
    """A third of the rows without an id: no shard holds more than a small part of them."""
    rows = [(None if i % 3 == 0 else i, f"w{i} x y", f"s{i % 2}") for i in range(12_000)]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    dealt, n = mixing.quotas(docs, (1, 2, 3), 3, 4, 7)
    sizes = [r["count"] for r in dealt.groupBy(n["k"], n["shard"]).count().collect()]
    assert max(sizes) < 0.15 * 6000 and sum(sizes) == 12_000


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    sizes = [(None if i == 7 else f"s{i:04}", rng.choice([0, 1, 5, 1000, 100_000])) for i in range(700)]
    sources = frame(spark, [("t" if s is None else f"s{s}", n, 1) for s, n in sizes], "k string, source_size long, docs long", 5)
    got = {r.k: r.target for r in mixing.targets(sources, (1, 2, 3), 3).collect()}
    want = brute.targets(dict(sizes))
    assert all(abs(got["t" if s is None else f"s{s}"] - x) < 1e-6 * max(1, x) for s, x in want.items())


@pytest.mark.parametrize("by", [["g"], []])
def test_apportion_is_sainte_lague(spark, by):
    rng = random.Random(4)
    for _ in range(4):
        votes = [rng.randint(0, 1000) for _ in range(9)]
        seats = rng.choice([0, 5, 40, 333])
        df = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, k int, v long, m long")
        got = {r.k: r.won for r in mixing.apportion(df, by, "v", "m", ["k"]).collect()}
        want = dict.fromkeys(range(9), 0)
        for _ in range(seats if any(votes) else 0):
            best = max(range(9), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[best] += 1
        assert got == want


# --- pipeline ------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, sf_docs, tmp_path):
    docs, toxic = sf_docs, {r.doc_id for r in spark.read.parquet(f"{SF01}/labels.parquet").where("toxic = 1").collect()}
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF01).write.parquet(f"{tmp_path}/{n}")
        seen[name] = docs = spark.read.parquet(f"{tmp_path}/{n}")
        if name != "packing":
            assert docs.columns == sf_docs.columns
    kept = {r.doc_id for r in seen["toxicity"].select("doc_id").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF01}/labels.parquet").where("toxic = 0").collect()}
    # 51 toxic rows name too few words to catch all; recall and clean rows lost are tested at sf0.1 on held-out labels.
    labels = spark.read.parquet(f"{SF01}/labels.parquet").select("doc_id", F.col("toxic").alias("grade"))
    judged = toxicity.score(sf_docs, toxicity.fit(sf_docs, labels)).collect()
    assert kept == {r.doc_id for r in judged if not r.rejected}
    assert len(toxic - kept) >= 0.8 * len(toxic) and len(clean - kept) <= 0.01 * len(clean)
    groups = brute.components([tuple(r) for r in seen["toxicity"].select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in seen["near_dedup"].collect()) == sorted(set(groups.values()))
    mixed = [(r.doc_id, len(brute.WORD.findall(r.text.encode()))) for r in seen["mixing"].collect()]
    want = {r.doc_id: r.taken for r in mixing.takes(seen["near_dedup"]).collect() if r.taken}
    got = {}
    for i, n in mixed:
        got[i] = got.get(i, 0) + n
    assert got == want
    tokens = sum(len(x) + 1 for x in packing.CachedTokenizer(__import__("public_tokenizers").path("word_bpe_49k.json"))
                 .encode(pa.array([r.text.encode() for r in seen["mixing"].collect()], pa.binary())))
    assert seen["packing"].agg(F.sum("length")).first()[0] == tokens
    assert corpus_pipeline.run(spark, SF01).agg(F.sum("length")).first()[0] == tokens


ODD_DOCS = "doc_id long, text string, lang string, source string, n_chars long, Size int, _part string, grade string"


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None, None, None), (None, "no id", "x", None, 5, 1, "p", "g"),
                                       (1, "", "x", "s", 0, 1, "p", "g"), (2, "same text here", "x", "s", 14, 1, "p", "g"),
                                       (2, "same text here", "x", "s", 14, 1, "p", "g"), (3, "same text here", "x", "t", 14, 1, "p", "g"),
                                       (4, "word " * 9000, "x", None, 45000, None, None, None)]])
def test_pipeline_of_odd_rows_and_nothing(spark, tmp_path, rows):
    """Nulls, empty and very long texts, repeated rows, clashing names, an empty table: every stage gives its defined result."""
    frame(spark, rows, ODD_DOCS, 1).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [(1, 1, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int", 1).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [f.strip().split()[0] for f in ODD_DOCS.split(",")], name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    dedup = spark.read.parquet(f"{tmp_path}/near_dedup")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if not rows:
        assert dedup.count() == 0 and packed == []
        return
    assert sorted((r.doc_id or 0, (r.text or "")[:4]) for r in dedup.collect()) == [(0, ""), (0, "no i"), (1, ""), (2, "same"), (4, "word")]
    assert {r.doc_id for r in packed} <= {None, 2, 4} and 4 in {r.doc_id for r in packed}


HELD = """
import random, re
from types import SimpleNamespace
import public_tokenizers
import pyarrow as pa
from keelson.llm import packing

def held():
    return sum(map(int, re.findall(r"Pss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches(rows, n):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(60_000)]
    for _ in range(n):
        texts = [" ".join(rng.choices(vocabulary, k=300)).encode() for _ in range(rows)]
        yield pa.record_batch({"doc_id": pa.array(range(rows), pa.int64()), "text": pa.array(texts, pa.binary())})

packing.TaskContext = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
packing.text_bytes = lambda: SimpleNamespace(alias=lambda name: name)
kind = SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))
docs = SimpleNamespace(schema={"doc_id": kind}, mapInArrow=lambda run, schema: run)
docs.select = lambda *columns: docs
task = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
for _ in task(batches(20, 1)):
    pass
before = held()
for _ in task(batches(3000, 3)):
    pass
_ = None
print(held() - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_idle_workers_give_memory_back():
    done = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 60
