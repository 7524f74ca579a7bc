"""URL rules, WARC, vector searches: brute force, round trips, recall, edge cases."""

import base64
import hashlib
import math
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import SF01, frame
from keelson.llm import ann, topk, url_rules, warc
from pyspark.sql import functions as F

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.example.org", "/es/x/", "allow"), ("b.com", "", "block")]
URLS = [None, "", "no scheme", "x://", "http://ORG", "http://org/", "https://a.EXAMPLE.org/es/x/1?q", "https://example.org/es/x/",
        "http://xexample.org/es/", "http://example.org/en/12", "http://m.example.org/en/1#f", "a://b.com", "a://c.b.com/de/", "a://c.com/de/x",
        "a://com:80/fr/", "http://É.com/fr/\n?x", "http://u@h.org/p://q", "ftp://org?x/", "//org/", "http://.org/", "http://org./"]


@pytest.mark.parametrize("parts", [1, 7])
def test_url_verdicts_match_brute_force(spark, parts):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[6]), (4, URLS[4])]
    rows += [tuple(r) for r in spark.read.parquet(f"{SF01}/pages.parquet").select("page_id", "url").collect()]
    rules = spark.createDataFrame([*RULES, RULES[0], (None, "/", "block")], "host string, path string, verdict string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in url_rules.judge(frame(spark, rows, "page_id long, url string", 3), rules).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = [(i, *brute.verdict(u, RULES)) for i, u in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_url_rules_empty(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string, key string"), rules).collect() == []
    got = url_rules.judge(frame(spark, [(1, "a://b.com/x")], "page_id long, url string"), rules.limit(0)).collect()
    assert [tuple(r) for r in got] == [(1, "b.com", "/x", None, "allow")]


# --- WARC ----------------------------------------------------------------------------------------------------

PAGES = [(3, "http://a/\r\nX: y", "same"), (1, None, "same"), (2, "u", "same"), (4, "u", None), (5, "u", ""), (6, "u", "é\r\n\r\nWARC/1.1\r\n"),
         (7, "u", "z" * 300_000), (8, "u", "z" * 300_000), (None, "u", "lonely"), (9, "u", "\r\n\r\n")]


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(b) if len(b) >= least else None
        to = None if to == i else to
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(map(repr, out))


def digest(df):
    got = df.select(F.col("record_id").cast("long"), "payload_length", "payload_digest", "record_type",
                    F.col("refers_to").cast("long")).collect()
    return sorted(repr(tuple(r)) for r in got)


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, tmp_path, least):
    pages = frame(spark, [(i, u, h, 1) for i, u, h in PAGES], "page_id long, url string, html string, Payload_Digest int", 3)
    warc.write_warc(pages, f"{tmp_path}/w", least)
    read = warc.read_warc(spark, f"{tmp_path}/w")
    assert digest(read) == expected(PAGES, least)
    html = {i: h or "" for i, _, h in PAGES}
    for r in read.collect():
        body = "" if r.record_type == "revisit" else html[None if r.record_id is None else int(r.record_id)]
        assert bytes(r.payload) == body.encode() and r.content_length == len(body.encode())
    assert read.where("record_type = 'revisit'").count() == sum("revisit" in x for x in expected(PAGES, least))
    assert read.where("record_type = 'response' and refers_to is not null").count() == 0
    one = read.where("record_id = '6' and record_type = 'response'").collect()
    assert len(one) == 1 and bytes(one[0].payload) == PAGES[5][2].encode()
    assert digest(warc.verified(spark, f"{tmp_path}/w")) == expected(PAGES, least)
    bare = warc.read_warc(spark, f"{tmp_path}/w", payload=False)
    assert digest(bare) == expected(PAGES, least) and bare.where("payload is not null").count() == 0


def test_warc_pushdown_skips_in_the_reader(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan
    warc.write_warc(frame(spark, PAGES, "page_id long, url string, html string"), f"{tmp_path}/w")
    reader = warc.WarcReader({"path": f"{tmp_path}/w", "partition_bytes": "1"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("content_length",), 1), EqualTo(("payload",), "x")]))
    assert len(left) == 2 and reader.wanted == {"record_type": "revisit"}
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == sum("revisit" in x for x in expected(PAGES)) and all(r[0] == "revisit" for r in rows)


def foreign_records():
    """Records as other writers make them: odd header cases, no blanks, folded lines, other ids, a warcinfo record."""
    def record(head, body):
        return ("\r\n".join([*head, f"content-length:{len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"

    big = bytes(range(256)) * 2000
    return [record(["WARC/1.0", "WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1-a>"], b"software: x\r\n"),
            record(["WARC/1.0", "warc-type:response", "WARC-RECORD-ID:<urn:uuid:2-b>", "WARC-Target-URI: http://a/", " b"], big),
            record(["WARC/1.0", "WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:3-c>", "WARC-Refers-To: <urn:uuid:2-b>"], b"")], big


@pytest.mark.parametrize("packed", [None, "members", "whole"])
def test_warc_of_other_writers(spark, tmp_path, packed):
    import gzip
    parts, big = foreign_records()
    name = "x.warc" if packed is None else "x.warc.gz"
    raw = b"".join(map(gzip.compress, parts)) if packed == "members" else b"".join(parts)
    (tmp_path / name).write_bytes(gzip.compress(raw) if packed == "whole" else raw)
    got = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert set(got) == {"urn:uuid:1-a", "urn:uuid:2-b", "urn:uuid:3-c"}
    assert bytes(got["urn:uuid:2-b"].payload) == big and got["urn:uuid:2-b"].target_uri == "http://a/ b"
    assert got["urn:uuid:3-c"].refers_to == "urn:uuid:2-b" and got["urn:uuid:3-c"].payload_digest is None
    one = warc.read_warc(spark, str(tmp_path), payload=False).where("record_type = 'revisit'").collect()
    assert [r.record_id for r in one] == ["urn:uuid:3-c"]


@pytest.mark.parametrize("raw,text", [(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nx", "no Content-Length"),
                                      (b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort", "ends before"), (b"WARC/1.0\r\nContent", "no end of its header")])
def test_broken_archives_are_refused(spark, tmp_path, raw, text):
    (tmp_path / "x.warc").write_bytes(raw)
    with pytest.raises(Exception, match=text):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_warc_repeated_rows_of_the_smallest_id(spark, tmp_path):
    rows = [(1, "u", "p"), (1, "u", "p"), (2, "u", "p")]
    warc.write_warc(frame(spark, rows, "page_id long, url string, html string"), f"{tmp_path}/w")
    got = sorted((r.record_id, r.record_type, r.refers_to) for r in warc.read_warc(spark, f"{tmp_path}/w").collect())
    assert got == [("1", "response", None), ("1", "response", None), ("2", "revisit", "1")]


def test_warc_empty(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert warc.read_warc(spark, f"{tmp_path}/w").collect() == []


# --- vectors -------------------------------------------------------------------------------------------------

def vectors(spark, seed=0, n=600, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[100:180] = x[100]
    x[3], x[4] = 0, x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1050, [None] * d), (1100, [float("nan")] * d), (1150, [float("inf")] * d), (1200, [1.0, 2.0]), (1201, [2.0, 1.0]),
             (1250, []), (None, rows[7][1]), (50, rows[50][1])]
    return frame(spark, [(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, v string", 3), rows


def valid(rows, zero):
    out = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out[i] = v
    return out


def best(rows, measure, zero, k=5):
    ok = valid(rows, zero)
    out = {}
    for q in ok:
        if q % 50 == 0:
            c = sorted((-measure(ok[q], ok[j]), j) for j in ok if j != q and len(ok[j]) == len(ok[q]))
            out[q] = [(j, -s) for s, j in c[:k]]
    return {q: v for q, v in out.items() if v}


def test_topk_is_exact(spark):
    df, rows = vectors(spark)
    for block, query_block, levels in ((4096, 512, 8), (64, 3, 3)):
        got = {}
        for r in topk.search(df, df.where("vec_id % 50 = 0"), block=block, query_block=query_block, levels=levels).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        whole = lambda v: [math.floor(256 * x) for x in v]
        want = best(rows, lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b))), True)
        assert {q: [(j, s) for _, j, s in sorted(v)] for q, v in got.items()} == want


def test_ann_scores_ties_and_recall(spark):
    df, rows = vectors(spark)
    cosine = lambda a, b: float(np.dot(np.float64(a), np.float64(b)) / math.sqrt(np.dot(a, a) * np.dot(b, b)))
    want = best(rows, lambda a, b: round(cosine(a, b), 9), False)
    got, ok = {}, valid(rows, False)
    for r in ann.search(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert abs(r.score - cosine(ok[r.query_id], ok[r.vec_id])) < 1e-12 and r.query_id != r.vec_id
    hits = sum(len({j for _, j, _ in got.get(q, [])} & {j for j, _ in v}) for q, v in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, len(found) + 1))
    same = [j for _, j, _ in sorted(got[100])]
    assert same == [101, 102, 103, 104, 105] and [j for _, j, _ in sorted(got[150])] == [100, 101, 102, 103, 104]
    assert got[1200][0][1] == 1201 and 1000 not in got and 1250 not in got


def test_ann_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    got = {}
    for r in ann.search(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for n in np.flatnonzero(ids % 50 == 0):
        s = x @ x[n]
        s[n] = -9
        top = set(ids[np.argsort(-s)[:5]].tolist())
        hit, total = hit + len(top & got.get(int(ids[n]), set())), total + len(top)
    assert hit >= 0.9 * total


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(1).normal(size=(7, 32))
    y = ann.hadamard(x)
    assert np.allclose((x * x).sum(axis=1), (y * y).sum(axis=1)) and np.allclose(ann.hadamard(y), x)
    assert ann.axes(np.array([[0.1, -0.9, 0.3, 0.2]]), 3).tolist() == [[3, 4, 6]]


def test_vector_searches_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(none, none).collect() == [] and topk.search(none, none).collect() == []
    one = frame(spark, [(0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert ann.search(one, one).collect() == [] and topk.search(one, one).collect() == []


def test_impact_order_stops_early():
    """Rows of few large values: the proof comes after the first segments, and sparse lists give what a product gives."""
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (2000, 32)).astype(float)
    hot = rng.integers(0, 2000, 60)
    x[hot, rng.integers(0, 32, 60)] = rng.integers(200, 250, 60)
    table = pa.table({"block": pa.array([0] * 2000, pa.int32()), "vec_id": pa.array(range(2000)), "v": pa.array(list(x))})
    index = sorted(topk.segments(table, 8).to_pylist(), key=lambda s: -s["impact"])
    assert len(np.frombuffer(index[0]["rows"], np.int32)) <= 60
    q = np.zeros((40, 32))
    q[np.arange(40), np.arange(40) % 32] = 50
    (asked, found, score), touched = topk.score_at_a_time(index, q, np.arange(5000, 5040), 1, few=8)
    product = q @ x.T
    for i in range(40):
        got = [(s, f) for a, f, s in zip(asked, found, score) if a == 5000 + i]
        assert got == [(product[i].max(), int(product[i].argmax()))]
    assert touched < 0.2 * 40 * (x != 0).sum()
    dims, rows = np.nonzero((x != 0).T)
    for some in (slice(0, 50), slice(0, None)):  # sparse and dense
        out = np.zeros((40, 2000))
        topk.accumulate(out, q, rows[some], dims[some], x[rows[some], dims[some]])
        part = np.zeros_like(x)
        part[rows[some], dims[some]] = x[rows[some], dims[some]]
        assert np.allclose(out, q @ part.T)


def test_ann_of_very_large_and_small_components(spark):
    rows = [(0, [1e200, 1e200, 0.0, 0.0]), (50, [3e199, 3.1e199, 0.0, 0.0]), (1, [0.0, 0.0, 1e-300, 0.0]), (100, [0.0, 1e-299, 2e-300, 0.0])]
    df = frame(spark, rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(df, df).collect()}
    assert got[50, 1][0] == 0 and 0.999 < got[50, 1][1] <= 1 and got[0, 1][0] == 50
    assert got[1, 1][0] == 100 and abs(got[1, 1][1] - 0.19611613513818404) < 1e-12


def test_topk_beyond_double_precision(spark):
    big = 2.0 ** 40 + 1
    rows = [(0, [big, -3.0]), (1, [big, 1.0]), (2, [-big, 7.0]), (3, [1.0, 1.0])]
    got = topk.search(frame(spark, rows, "vec_id long, embedding array<double>"),
                      frame(spark, rows[:1], "vec_id long, embedding array<double>"), scale=1).collect()
    full = lambda v: int(big) * int(v[0]) - 3 * int(v[1])
    clip = lambda s: min(max(s, -2**63), 2**63 - 1)
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(i, clip(full(v))) for i, v in (rows[1], rows[3], rows[2])]


random.seed(0)


def crowded():
    """A query's best id in many copies and in several vectors; the others in one row each."""
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(i, [1.0, 0.01 * i, 0.0, 0.0]) for i in range(2, 12)]
    return rows + [(1, [1.0, 0.0, 0.0, 0.0])] * 8 + [(1, [1.0, 0.0, 0.0, 0.001 * j]) for j in range(1, 8)]


@pytest.mark.parametrize("block", [4096, 4])
def test_topk_counts_ids_not_rows(spark, block):
    df = frame(spark, crowded(), "vec_id long, embedding array<double>")
    got = topk.search(df, df.where("vec_id = 0"), block=block).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(n, n, 65536) for n in range(1, 6)]


def test_ann_block_counts_ids_not_rows():
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    x = np.stack([base] * 8 + [base + 0.01 * i * np.eye(16)[3] for i in range(1, 12)])
    ids = np.array([1] * 8 + [1, 1] + list(range(2, 11)))
    got = ann.best_of(x, ids, np.stack([base, base]), np.array([0, 2]), 5)
    assert got[0] == [0] * 5 + [2] * 5 and got[1] == [1, 2, 3, 4, 5, 1, 3, 4, 5, 6]
    assert [s for s in got[2][:5]] == sorted(got[2][:5], reverse=True)


def test_ann_counts_ids_not_rows(spark):
    base = np.random.default_rng(5).normal(size=16)
    rows = [(0, base.tolist())] + [(1, base.tolist())] * 12
    rows += [(i, (base + 0.001 * i * np.eye(16)[3]).tolist()) for i in range(2, 12)]
    df = frame(spark, rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id = 0"), tables=2).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(n, n) for n in range(1, 6)]
