"""Sum-of-squares online packing of tokenised documents into fixed windows.

Method: a level array counts the partly filled windows of each fill level.
A document (what is left of it after its full windows) goes to the level
that minimises the sum of the squared counts; ties go to the fullest
window.  Each task packs the rows of its own input partition as they come,
so nothing is shuffled and memory is bounded by the open windows (at most
``max_open``, else they are closed early).

At the end of a partition the open windows are mended: the emptiest give
their pieces, cut where needed, to the fullest, until one window is left;
its tokens go to sequences of power-of-two lengths.  So no sequence is
padded: each has ``size`` tokens or a smaller power of two.

Defined results: a null or empty text is one end token; repeated rows are
packed as often as they come, under the same doc_id; a null doc_id stays
null; an empty table gives no rows; other columns are ignored.  The result
follows the order of the input partitions, which is fixed for stored files.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, pre_tokenizers

from keelson.llm.common import coded_words, slices, text_bytes, tidy


MARKS = ".,;:!?"
#: Bytes of text that are tokenised together.
SLICE = 2 << 20
#: Words of these letters are, in lower case, one run of letters that is normalised as it is.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Stands between other words; no other character gives its token.
BETWEEN = "\x01"


def plain_parts(words: pa.Array) -> pa.Array:
    """Two parts a word (UTF-8, as string): it in lower case without its closing marks, and the marks.

    Tokens never span a letter and a mark after it, and the vocabulary is
    lower case; a word that may hold a special token stays as it is.
    """
    special = pc.match_substring(words, "<|")
    low = pc.if_else(special, words, pc.ascii_lower(words))
    _, ends, data = low.buffers()
    ends = np.frombuffer(ends, np.int32)[low.offset:low.offset + len(low) + 1]
    stems = pc.binary_length(pc.ascii_rtrim(low, characters=MARKS)).to_numpy()
    last = np.frombuffer(data, np.uint8)[np.maximum(ends[:-1] + stems, 1) - 1]
    parted = (stems > 0) & (last >= 97) & (last <= 122) & ~special.to_numpy(zero_copy_only=False)
    cuts = np.empty(2 * len(low) + 1, np.int32)
    cuts[::2], cuts[1::2] = ends, np.where(parted, ends[:-1] + stems, ends[1:])
    return pa.Array.from_buffers(pa.binary(), 2 * len(low), [None, pa.py_buffer(cuts), data])


class CachedTokenizer:
    """Token ids of whole texts, tokenising each distinct run of characters between white space once.

    Right for lower-case byte-level vocabularies whose pre-tokenizer drops white
    space and parts letters from marks, as ``word_bpe_49k.json`` does.  ``limit``
    bounds the cache, not the result.
    """

    _loaded: dict[str, CachedTokenizer] = {}

    def __init__(self, path: str, limit: int = 500_000):
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.latin = Tokenizer(self.tokenizer.model)  # neither normalises nor searches a word's runs
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else -1
        self.clear()

    @classmethod
    def load(cls, path: str) -> CachedTokenizer:
        """The worker process's tokenizer for this file; Spark runs a worker a core, so it gets no threads of its own."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def clear(self) -> None:
        self.index: dict[bytes, int] = {b"": 0}  # stems and marks
        self.starts, self.lengths, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def fresh_ids(self, words: list[str], latin: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of all words on end, and the number of each word's, both in runs.

        Words are tokenised 64 at a time: in ``latin`` words a token that ends
        a word shows where each stops, others have a mark between them.
        """
        group = 64
        lines = [words[i:i + group] for i in range(0, len(words), group)]
        tokenizer, space = (self.latin, " ") if latin else (self.tokenizer, f" {BETWEEN} ")
        joined = tokenizer.encode_batch_fast([space.join(x) for x in lines], add_special_tokens=False)
        flat: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        for line, found in zip(lines, joined, strict=True):
            ids = np.array(found.ids, np.uint32)
            if latin:
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                whole = len(ends) == len(line) and ends[-1] == len(ids)
                counts = np.diff(ends, prepend=0)
            else:
                inside = ids != self.between
                ends = np.flatnonzero(~inside)
                whole = len(ends) == len(line) - 1
                counts = np.diff(ends, prepend=-1, append=len(ids)) - 1
                ids = ids[inside]
            if whole:
                flat.append(ids)
                lengths.append(counts)
                continue
            for e in self.tokenizer.encode_batch_fast(line, add_special_tokens=False):
                flat.append(np.array(e.ids, np.uint32))
                lengths.append(np.array([len(e.ids)], np.int64))
        return flat, lengths

    def learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        other = [LATIN(t) is None for t in texts]
        order = sorted(range(len(words)), key=other.__getitem__)  # Latin words first
        words, split = [words[i] for i in order], len(words) - sum(other)
        flat, runs = self.fresh_ids([texts[i].lower() for i in order[:split]], latin=True)
        more = self.fresh_ids([texts[i] for i in order[split:]], latin=False)
        lengths = np.concatenate(runs + more[1])
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.index.update(zip(words, range(len(self.lengths), len(self.lengths) + len(words)), strict=True))
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, *flat, *more[0]])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """One array of ids a text (UTF-8, as binary)."""
        codes, unique, counts = coded_words(texts, lower=False)
        if len(codes) == 0:
            return [np.zeros(0, np.uint32) for _ in counts]
        if len(self.index) > self.limit:
            self.clear()
        parts = plain_parts(unique.view(pa.string())).dictionary_encode()
        distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        if fresh := [w for w in distinct if w not in self.index]:
            self.learn(fresh)
        at = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1])]
        # From distinct parts to the two parts of each distinct word, then to all words.
        spans = packed(4 * np.append(0, ends), pa.py_buffer(ids)).take(parts.indices)
        spans = packed(cuts_of(spans)[::2], spans.buffers()[2]).take(pa.array(codes))
        cuts = cuts_of(spans)[np.append(0, np.cumsum(counts))] // 4
        ids = np.frombuffer(spans.buffers()[2], np.uint32, cuts[-1])
        return [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def packed(cuts: np.ndarray, data: pa.Buffer) -> pa.Array:
    """The bytes of ``data`` between each two ``cuts``."""
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), data])


def cuts_of(spans: pa.Array) -> np.ndarray:
    return np.frombuffer(spans.buffers()[1], np.int64)[spans.offset:spans.offset + len(spans) + 1]


Piece = tuple  # (doc_id, doc_tokens, start, ids)


class SumOfSquares:
    """The level array and the open windows of one task."""

    def __init__(self, size: int = 4096, max_open: int = 8192):
        self.size, self.max_open, self.open = size, max_open, 0
        self.counts = np.zeros(size + 1, np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(size)]

    def level(self, length: int) -> int:
        """The fill level that takes ``length`` tokens at the least sum of squared counts; 0 opens a window."""
        last = self.size - length
        here, there = self.counts[:last + 1], self.counts[length:]
        change = 2 * (there - here) + 2
        change[here == 0] = np.iinfo(np.int64).max
        change[0] = 2 * there[0] + 1 if last else 0
        if last and here[last]:
            change[last] = 1 - 2 * here[last]  # a full window counts no more
        return last - int(np.argmin(change[::-1]))

    def put(self, piece: Piece) -> list[list[Piece]]:
        """Place a piece shorter than a window; the windows that are done now."""
        length = len(piece[3])
        h = self.level(length)
        window = self.windows[h].pop() if h else []
        self.counts[h] -= h > 0
        window.append(piece)
        if h + length == self.size:
            self.open -= 1 if h else 0
            return [window]
        self.open += h == 0
        self.windows[h + length].append(window)
        self.counts[h + length] += 1
        return self.mend() if self.open > self.max_open else []

    def mend(self) -> list[list[Piece]]:
        """Close all open windows without padding."""
        rest = [w for h in range(self.size - 1, 0, -1) for w in self.windows[h]]
        self.__init__(self.size, self.max_open)
        done, low = [], len(rest) - 1
        for high in range(len(rest)):
            if high > low:
                break
            window, need = rest[high], self.size - sum(len(x[3]) for x in rest[high])
            while need and low > high:
                head, tail = cut(rest[low].pop(), need)
                window.append(head)
                need -= len(head[3])
                if tail:
                    rest[low].append(tail)
                if not rest[low]:
                    low -= 1
            if need:
                done += powers(window)
            else:
                done.append(window)
        return done


def cut(piece: Piece, at: int) -> tuple[Piece, Piece | None]:
    doc, tokens, start, ids = piece
    if len(ids) <= at:
        return piece, None
    return (doc, tokens, start, ids[:at]), (doc, tokens, start + at, ids[at:])


def powers(window: list[Piece]) -> list[list[Piece]]:
    """The pieces of a window as windows of power-of-two lengths, the largest first."""
    left, done = list(window[::-1]), []
    total = sum(len(x[3]) for x in window)
    while total:
        need = 1 << (total.bit_length() - 1)
        total -= need
        out = []
        while need:
            head, tail = cut(left.pop(), need)
            out.append(head)
            need -= len(head[3])
            if tail:
                left.append(tail)
        done.append(out)
    return done


SCHEMA = "start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = 4096) -> DataFrame:
    """A row for each piece of each document: where it lies and its ids.

    ``docs(doc_id, text)``.  ``start``: the document's tokens before the
    piece; ``offset``: the sequence's tokens before it; ``ids``: unsigned
    32-bit little-endian.  ``tokenizer_path`` must exist on every executor.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(windows: list[list[Piece]], first: int, arrow: pa.DataType) -> pa.RecordBatch:
        out = []
        for n, window in enumerate(windows):
            offset, total = 0, sum(len(x[3]) for x in window)
            for doc, tokens, start, ids in window:
                out.append((doc, start, len(ids), tokens, first + n, offset, total, ids.astype("<u4").tobytes()))
                offset += len(ids)
        cols = list(zip(*out, strict=True))
        return pa.record_batch({"doc_id": pa.array(cols[0], arrow)}
                               | {name: pa.array(cols[i], pa.int64()) for i, name in enumerate(
                                   ("start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length"), 1)}
                               | {"ids": pa.array(cols[7], pa.binary())})

    @tidy
    def run(batches) -> Iterator[pa.RecordBatch]:
        tokenizer, state = CachedTokenizer.load(tokenizer_path), SumOfSquares(size)
        next_id, done, arrow = TaskContext.get().partitionId() << 40, [], None
        for batch in slices(batches, limit=SLICE):
            arrow = batch.schema.field("doc_id").type
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.encode(batch.column("text")),
                                strict=True):
                ids = np.append(ids, np.uint32(end_id))  # a copy, so a piece doesn't hold its slice
                whole = len(ids) // size * size
                done += [[(doc, len(ids), at, ids[at:at + size])] for at in range(0, whole, size)]
                if whole < len(ids):
                    done += state.put((doc, len(ids), whole, ids[whole:].copy()))
                if len(done) >= 256:
                    yield rows(done, next_id, arrow)
                    next_id, done = next_id + len(done), []
        done += state.mend()
        tokenizer.clear()  # the worker goes on with other tasks and stages
        if done:
            yield rows(done, next_id, arrow)

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
