"""Token counts of a byte-pair vocabulary, without emitting tokens.

A text is a linked list of symbols; a heap holds its adjacent pairs that join
to a piece of the vocabulary.  The pair of the lowest rank (ties: the one
further left) is popped and joined until none is left.  The count is the
number of initial symbols less the number of merges: each character that the
vocabulary has is one initial symbol, any other is one for each UTF-8 byte
(byte fallback), and those never merge.

The vocabulary is a sentencepiece model's: a space stands as ``▁``, one is put
in front of the text, nothing else is normalised, and control strings in a
text are ordinary text.  Two neighbouring characters that stand side by side
in no piece are never in one token, so a text is first cut there (words, and
what punctuation cuts off them).  The parts are independent; a task keeps the
counts of words and parts that it has seen, in tables of a bounded size.

Defined results: a null or empty text has no bytes and no tokens; a text
without any cut is one heap of its length; repeated rows and null ids are
counted like others; an empty table gives no rows; other columns are ignored.
Rows are counted one by one on whole texts, without a shuffle.
"""

from __future__ import annotations

import re
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import slices, text_bytes

SPACE = "▁"
#: Words (and parts) whose counts a task keeps; a full table starts anew.
KEPT = 500_000
#: Characters up to which a word's count is kept.
KEPT_CHARS = 64


def merged(symbols: list[str], rank: dict[str, float]) -> int:
    """How many merges the pairs of ``symbols`` allow, lowest rank first and then from the left."""
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = rank.get(symbols[i] + symbols[i + 1])
        if r is not None:
            heap.append((r, i, len(symbols[i]) + len(symbols[i + 1])))
    heapify(heap)
    merges = 0
    while heap:
        _, i, size = heappop(heap)
        j = after[i]
        # A symbol that was merged since is empty, or longer than it was.
        if j == n or not symbols[i] or len(symbols[i]) + len(symbols[j]) != size:
            continue
        both = symbols[i] + symbols[j]
        symbols[i], symbols[j] = both, ""
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = rank.get(both + symbols[k])
            if r is not None:
                heappush(heap, (r, i, size + len(symbols[k])))
        h = before[i]
        if h >= 0:
            r = rank.get(symbols[h] + both)
            if r is not None:
                heappush(heap, (r, h, len(symbols[h]) + size))
    return merges


class Kept(dict):
    """Counts by string, worked out when first asked for; long strings are not kept."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, s: str) -> int:
        n = self.count(s)
        if len(s) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[s] = n
        return n


class Counter:
    """Counts texts by ``rank`` (lower merges first) of the vocabulary's pieces."""

    def __init__(self, rank: dict[str, float]):
        self.rank = rank
        self.known = {p for p in rank if len(p) == 1}
        self.beside = {p[i:i + 2] for p in rank for i in range(len(p) - 1)}
        if any(a != SPACE and b == SPACE for a, b in self.beside):
            raise ValueError("a piece of the vocabulary holds a space after another character")
        self.parts = Kept(self.part)
        self.words = Kept(lambda w: self.segment(SPACE + w))

    def part(self, s: str) -> int:
        symbols = len(s) if self.known.issuperset(s) else sum(1 if c in self.known else len(c.encode()) for c in s)
        return symbols - merged(list(s), self.rank) if len(s) > 1 else symbols

    def segment(self, s: str) -> int:
        """Cut where two neighbours stand side by side in no piece; count the parts."""
        cuts = [i for i in range(1, len(s)) if s[i - 1:i + 1] not in self.beside]
        return sum(self.parts[s[a:b]] for a, b in zip([0, *cuts], [*cuts, len(s)]))

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            found = re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))
            return sum(self.words[s[1:]] for s in found)
        return sum(map(self.words.__getitem__, text.split(" ")))


@cache
def load(model: str) -> Counter:
    """The counter of a sentencepiece BPE model file."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ordinary = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return Counter({sp.id_to_piece(i): -sp.get_score(i) for i in ordinary})


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``: more than ``limit`` tokens are over it."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        counter = load(model)
        for batch in slices(batches):
            counts = [counter(t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({key: batch.column(key), "n_bytes": batch.column("n_bytes"),
                                   "n_tokens": pa.array(counts, pa.int64())})

    rows = docs.select(key, text_bytes(text).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return (rows.mapInArrow(run, f"{key} {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
