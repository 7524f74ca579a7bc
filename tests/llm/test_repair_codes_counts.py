"""Conversation repair, vector codes, token counts: brute force, library counts, edge cases."""

import random

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import SF01, frame
from keelson.llm import codes, conversations, token_counts
from keelson.llm.queries import QUERIES

CONV = "conv_id long, turn long, role string, text string"
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def digests(df):
    return {r.conv_id: tuple(r[c] for c in RESULT) for r in df.collect()}


def odd_conversations(n, seed):
    rnd = random.Random(seed)
    texts = ["hi.", "hi", "", None, " \t", "what?", "no way!", "é", "a.b", "x" * 2000 + ".", "　", "end. \n"]
    roles = ["user", "assistant", "system", None, "tool", "", "User", "usher"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rnd.choice([1, 2, 3, 5, 9])):
            t = rnd.choice([turn, turn, turn, turn + 3, None, -turn])
            rows.append((conv, t, rnd.choice(roles[:3] if rnd.random() < 0.7 else roles), rnd.choice(texts)))
    return rows + rows[:7]


@pytest.mark.parametrize("block", [2, 256])
def test_repairs_match_brute_force(spark, block):
    """Blocks of two rows, and conversations over several range partitions, give what one pass gives."""
    rows = odd_conversations(120, block)
    got = digests(conversations.repair(conversations.damaged(frame(spark, rows, CONV, 3)), block))
    assert got == brute.conversations(rows)


def test_one_conversation_of_many_rows(spark):
    """Rows of one id lie in several tasks and blocks; a third of them repeat one row."""
    rnd = random.Random(3)
    rows = [(5, None if rnd.random() < 0.2 else i, rnd.choice(["user", "assistant", "system", "x"]),
             rnd.choice(["a", "b.", f"{i}.", ""])) for i in range(600)]
    rows += [(5, 7, "user", "same.")] * 300 + [(6, 0, "user", "q?"), (6, 1, "assistant", "a.")]
    got = digests(conversations.repair(conversations.damaged(frame(spark, rows, CONV, 5)), 16))
    assert got == brute.conversations(rows)


def test_repaired_rows_are_those_of_the_audit(spark):
    rows = odd_conversations(30, 9)
    got = {}
    for r in conversations.repaired_rows(conversations.damaged(frame(spark, rows, CONV))).orderBy("place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    want = {c: brute.repair(brute.damage([r for r in rows if r[0] == c]))[-1] for c in {r[0] for r in rows}}
    assert got == {c: list(w) for c, w in want.items() if w}


def test_repairs_of_the_table(spark):
    table = spark.read.parquet(f"{SF01}/conversations.parquet")
    want = brute.conversations([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert digests(QUERIES["op11_scalar_weight_repair"](spark, SF01)) == want


def test_repairs_of_nothing_and_of_undamaged_rows(spark):
    assert conversations.repair(conversations.damaged(frame(spark, [], CONV))).count() == 0
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "user", "Hi."), (2, 1, "user", "So?")]
    wide = frame(spark, [(*r, 9, "x", 1) for r in rows], CONV + ", spot int, planned string, cost int")
    got = {r.conv_id: (r.cost, r.audit) for r in conversations.repair(wide).collect()}
    assert got == {1: (0, "KK"), 2: (3, "KR")}


MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD_PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "e\u0301", "\u2581", "日", "本", "<s>", "</s>", "<unk>", "<0x0A>", "\x00",
             "1", "234", ".", "...", "==", "____", "\U0001f600", "\u200d", "ﬁ", "\u3000", "ß", "\ufeff", "\r\n", "don't", "'s", "aaaaaaa"]


def test_heap_counts_are_the_librarys():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(ODD_PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(5000)] + ["a" * 100_000, "日本" * 5000]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counter = token_counts.load(MODEL)
    assert [counter(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_kept_counts_start_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 3)
    counter = token_counts.Counter({"▁": 5.0, "a": 5.0, "b": 5.0, "ab": 1.0, "ba": 0.0, "▁a": 2.0})
    assert [counter(t) for t in ("a b ab ba aba", "c é", "bab", "aba ab")] == [9, 5, 3, 4]
    assert len(counter.words) <= 3


@pytest.mark.parametrize("bad", [{"a▁": 1.0}])
def test_spaces_inside_a_piece_are_refused(bad):
    with pytest.raises(ValueError):
        token_counts.Counter(bad)


def test_token_counts_of_the_table_and_odd_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def want(rows):
        return sorted((repr(i), len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in rows)

    def got(df):
        return sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect())

    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    assert got(QUERIES["op13_heap_token_counts"](spark, SF01)) == want([tuple(r) for r in docs.select("doc_id", "text").collect()])
    odd = [(1, None), (2, ""), (3, " "), (3, " "), (None, "no id"), (4, "word " * 4096), (5, "word " * 4095 + "x"), (6, "<s>" * 50), (7, "a\x00 \n")]
    wide = frame(spark, [(*r, "x", 1) for r in odd], "doc_id long, text string, n_bytes string, n_tokens int")
    assert got(token_counts.count_tokens(wide, MODEL)) == want(odd)
    assert token_counts.count_tokens(wide.limit(0), MODEL).count() == 0


VEC = "vec_id long, embedding array<double>, label int"


def coded(df, **kw):
    got, books = codes.compress(df, **kw)
    rows = codes.with_label_error(got).collect()
    return sorted(((r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in rows), key=repr), codes.books_digest(books)


def check_codes(spark, rows, parts=3, **kw):
    want, digest = brute.product_codes(rows, **kw)
    got = coded(frame(spark, rows, VEC, parts), **kw)
    assert got == (sorted(want, key=repr), digest)


def test_codes_match_brute_force(spark):
    rnd = random.Random(5)
    clusters = [[rnd.gauss(0, 0.3) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rnd.gauss(0, 0.02) for x in rnd.choice(clusters)], rnd.choice([1, 2, None])) for i in range(700)]
    check_codes(spark, rows, entries=16)
    check_codes(spark, rows[:40])  # fewer vectors than entries
    # Few different values: ties everywhere, unused entries; repeated rows and ids, null ids.
    grid = [(rnd.choice([None, *range(50)]), [rnd.choice([-1, 0, 0, 1]) / 512 for _ in range(8)], i % 3) for i in range(400)]
    check_codes(spark, grid + grid[:20], entries=40)


def test_codes_beyond_double_precision(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([-1, 1]) * (131071 - rnd.random()) for _ in range(8)], 0) for i in range(120)]
    check_codes(spark, rows, entries=10)


def test_codes_of_the_table_and_odd_rows(spark):
    table = spark.read.parquet(f"{SF01}/embeddings.parquet")
    want, digest = brute.product_codes([tuple(r) for r in table.select("vec_id", "embedding", "label").collect()])
    got = QUERIES["op12_adaptive_bound_codes"](spark, SF01).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted(want)
    assert {r.codebooks_sha256 for r in got} == {digest}
    good = [(i, [i / 7, -i / 3, 0.5, i / 11], None) for i in range(30)]
    odd = [(90, None, 1), (91, [], 1), (92, [1.0, None, 1.0, 1.0], 1), (93, [float("nan")] * 4, 1), (94, [1e200, 0.0, 0.0, 0.0], 1),
           (95, [float("-inf"), 0.0, 0.0, 0.0], 1), (96, [1.0] * 8, 1), (97, [1.0] * 5, 1)]
    wide = frame(spark, [(*r, "x", 5) for r in good + odd], VEC + ", v string, error int")
    want, digest = brute.product_codes(good, entries=5)
    assert coded(wide, entries=5) == (sorted(want, key=repr), digest)
    assert codes.compress(wide.limit(0))[0].count() == 0


def test_bounds_spare_most_comparisons(spark):
    """With settled clusters the lists decide nearly all later rounds, and shrink."""
    rnd = random.Random(8)
    clusters = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(32)]
    rows = [(i, [x + rnd.gauss(0, 0.01) for x in clusters[i % 32]], 0) for i in range(2000)]
    vectors = codes.whole_vectors(frame(spark, rows, VEC), 2)
    start = np.array(codes.smallest(vectors, 32))
    _, _, reports = codes.train(vectors, np.split(start, 2, axis=1), 4)
    assert reports[0]["used"] == {0: 4000}
    assert all(sum(r["used"].values()) == 4000 for r in reports)
    assert reports[-1]["used"].get(reports[-1]["b"] + 1, 0) < 400
    assert reports[-1]["b"] < codes.FIRST
    assert codes.next_length({9: 50, 1: 950}, 8) == 16 and codes.next_length({3: 30, 1: 970}, 8) == 3 and codes.next_length({1: 9}, 8) == 2
