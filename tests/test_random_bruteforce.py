"""Seeded random fixtures checked against plain-Python brute force.

Each test builds many random groups in one DataFrame (cheap on Spark) and
compares every group with a direct re-statement of the rule.
"""

import random

import pytest

from keelson.operators.aggregates import render_properties, resolve_properties, topology
from keelson.operators.joins import conditional_refresh
from keelson.operators.sets import expand_instances
from keelson.operators.windows import bounded_attempts

SEEDS = [1, 7, 42]


@pytest.mark.parametrize("seed", SEEDS)
def test_last_write_wins_and_render(spark, seed):
    rnd = random.Random(seed)
    rows_ = []
    for e in range(40):
        seqs = rnd.sample(range(1000), rnd.randint(1, 12))
        for s in seqs:
            key = rnd.choice("abcdef")
            val = rnd.choice(["x", "y\\z", "", "\\\\", "v=1"])
            rows_.append((f"e{e}", key, val, s))
    df = spark.createDataFrame(rows_, "ent string, key string, value string, seq int")
    got = {r.ent: r.document for r in
           render_properties(resolve_properties(df, "ent", "key", "value", ["seq"]), "ent", "key", "value").collect()}
    want = {}
    for ent in {r[0] for r in rows_}:
        writes = sorted((s, k, v) for e, k, v, s in rows_ if e == ent)
        last, first = {}, {}
        for s, k, v in writes:
            last[k] = v
            first.setdefault(k, s)
        lines = [f"{k}={last[k].replace(chr(92), chr(92) * 2)}" for k in sorted(first, key=first.get)]
        want[ent] = "\n".join(lines)
    assert got == want


@pytest.mark.parametrize("seed", SEEDS)
def test_bounded_attempts_bruteforce(spark, seed):
    rnd = random.Random(seed)
    rows_ = []
    for k in range(60):
        ts = rnd.sample(range(100), rnd.randint(1, 7))
        for t in ts:
            rows_.append((k, t, rnd.choice([True, False, False, None])))
    df = spark.createDataFrame(rows_, "k int, t int, ok boolean")
    got = {r.k: (r.outcome, r.attempt) for r in bounded_attempts(df, "k", ["t"], "ok", n=3).collect()}
    for k in {r[0] for r in rows_}:
        first3 = sorted((t, ok) for kk, t, ok in rows_ if kk == k)[:3]
        hit = next((i + 1 for i, (_, ok) in enumerate(first3) if ok), None)
        want = ("succeeded", hit) if hit else (("exhausted", None) if len(first3) == 3 else ("in_progress", None))
        assert got[k] == want, k


@pytest.mark.parametrize("seed", SEEDS)
def test_topology_chunking_is_order_preserving(spark, seed):
    rnd = random.Random(seed)
    rows_ = [(rnd.choice("abc"), i, f"h{i}", 1000 + i) for i in rnd.sample(range(5000), 400)]
    df = spark.createDataFrame(rows_, "g string, o int, host string, port int")
    for chunk in (1, 3, 64, 10_000):
        got = {r.g: r.topology for r in topology(df, "g", "host", "port", "o", chunk=chunk).collect()}
        for g in "abc":
            want = ",".join(f"http://h{o}:{1000 + o}/" for gg, o, _, _ in sorted(rows_, key=lambda r: r[1]) if gg == g)
            assert got.get(g, "") == want


@pytest.mark.parametrize("seed", SEEDS)
def test_expand_instances_split_equals_plain(spark, seed):
    rnd = random.Random(seed)
    df = spark.createDataFrame([(i, rnd.choice([0, 1, 2, 5, 17, 40, 100, -3])) for i in range(50)], "k int, n int")
    plain = sorted(tuple(r) for r in expand_instances(df, "n").select("k", "instance_id").collect())
    split = sorted(tuple(r) for r in expand_instances(df, "n", chunk=3).select("k", "instance_id").collect())
    want = sorted((k, i) for k, n in df.collect() for i in range(max(n, 0)))
    assert plain == want and split == want


@pytest.mark.parametrize("seed", SEEDS)
def test_conditional_refresh_bruteforce(spark, seed):
    rnd = random.Random(seed)
    keys = rnd.sample(range(200), 120)
    cur = {k: (rnd.choice(["a", "b", None]), float(k)) for k in keys[:80]}
    sto = {k: (rnd.choice(["a", "b", None]), -float(k)) for k in keys[40:]}
    cdf = spark.createDataFrame([(k, t, v) for k, (t, v) in cur.items()], "k int, etag string, v double")
    sdf = spark.createDataFrame([(k, t, v) for k, (t, v) in sto.items()], "k int, etag string, v double")
    got = {r.k: (r.status, r.etag, r.v) for r in conditional_refresh(cdf, sdf, "k", "etag", ["v"], True).collect()}
    for k in set(cur) | set(sto):
        if k not in cur:
            want = ("missing", *sto[k])
        elif k not in sto:
            want = ("new", *cur[k])
        elif cur[k][0] is not None and cur[k][0] == sto[k][0]:
            want = ("not_modified", *sto[k])
        else:
            want = ("modified", *cur[k])
        assert got[k] == want, k
