"""License scan: Aho-Corasick over words, and identifier expressions by shunting-yard.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z lower-cased text.  One
automaton over the words joined by spaces finds the base phrases, notice
phrases and the identifier tag.  Where the tag stands, the rest of its line
is parsed as a licence expression (and, or, with, parentheses; ``with``
binds closest, then ``and``) and evaluated to obligations: what holds
whichever way one chooses (``and`` joins those of both sides, ``or`` keeps the
common ones), and what holds for some choice only.  An obligation is a label;
a choice is one behind ``or:``, as in ``or:gpl-2.0``.  Identifiers and exceptions
must be known ones (or own ``LicenseRef-`` ones); other words make the
expression invalid, and it gives no label.

The score says how sure the scan is: 0 without a finding, else
1 - product of (1 - weight) over the distinct findings: a valid expression 0.9
where it names an obligation and 0.8 where it only leaves a choice, an invalid
one 0.3, a base phrase 0.6, a notice 0.4.

Defined results: a null or empty text has no words, no labels and score 0;
repeated rows and null ids are scanned like others; an empty table gives no
rows; other columns are ignored.  Rows are scanned one by one on whole
texts, without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keelson.llm.common import slices, text_bytes

TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Notices of this method.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd", "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge": "mit", "isc license": "isc", "the unlicense": "unlicense",
    "all rights reserved": "proprietary", "public domain": "public-domain", "boost software license": "bsl",
}
TAG = "spdx license identifier"
TAG_LINE = re.compile(rb"spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier[^0-9a-z\x80-\xff(\r\n]*[ \t:]*([^\r\n]*)")
TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.\-:]*\+?)")
# How strongly each operator binds.
BINDS = {"with": 3, "and": 2, "or": 1}
# Identifiers and exceptions of the public licence list that are in wide use.
IDENTIFIERS = frozenset("""
0bsd afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0
blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 bzip2-1.0.6 cc0-1.0
cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0
cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 efl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gfdl-1.3-only gfdl-1.3-or-later
gpl-1.0 gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd icu ijg isc
lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng
lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql
psf-2.0 python-2.0 qpl-1.0 ruby sgi-b-2.0 sleepycat tcl ucl-1.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
""".split())
EXCEPTIONS = frozenset("""
autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 font-exception-2.0 gcc-exception-2.0
gcc-exception-3.1 linux-syscall-note llvm-exception openjdk-assembly-exception-1.0 qt-gpl-exception-1.0 u-boot-exception-2.0
wxwindows-exception-3.1
""".split())
OWN = re.compile(r"(documentref-[a-z0-9.\-]+:)?licenseref-[a-z0-9.\-]+")


class ExpressionError(ValueError):
    pass


def postfix(text: str) -> list[str]:
    """Shunting-yard: the expression in reverse Polish order; operators are lower case.

    A comment end or other text after a whole expression is left out; what
    is no expression raises ``ExpressionError``.  One pass over the text.
    """
    out: list[str] = []
    held: list[str] = []
    operand, at, open_ = True, 0, 0
    while m := TOKEN.match(text, at):
        word = m[1]
        low = word.lower()
        if operand:
            if word == "(":
                held.append(word)
                open_ += 1
            elif word == ")" or low in BINDS:
                raise ExpressionError(text)
            else:
                out.append(word)
                operand = False
        elif word == ")":
            if not open_:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            open_ -= 1
        elif low in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        else:
            break
        at = m.end()
    if operand or open_:
        raise ExpressionError(text)
    return out + held[::-1]


def known(word: str) -> str:
    """The identifier in lower case; one that is not known raises ``ExpressionError``."""
    low = word.lower()
    if low.removesuffix("+") in IDENTIFIERS or OWN.fullmatch(low):
        return low
    raise ExpressionError(word)


def evaluate(tokens: list[str]) -> tuple[frozenset[str], frozenset[str]]:
    """Of an expression in reverse Polish order: what holds for every choice, and what for some."""
    stack: list[tuple[frozenset[str], frozenset[str]] | str] = []

    def value(x) -> tuple[frozenset[str], frozenset[str]]:
        if isinstance(x, str):
            one = frozenset([known(x)])
            return one, one
        return x

    for t in tokens:
        if t not in BINDS:
            stack.append(t)
            continue
        right, left = stack.pop(), stack.pop()
        if t == "with":  # an exception to one licence
            if not isinstance(left, str) or not isinstance(right, str) or right.lower() not in EXCEPTIONS:
                raise ExpressionError(t)
            one = frozenset([f"{known(left)} with {right.lower()}"])
            stack.append((one, one))
        else:
            (a, a_some), (b, b_some) = value(left), value(right)
            stack.append((a | b if t == "and" else a & b, a_some | b_some))
    return value(stack[0])


@dataclass
class Scan:
    n_words: int = 0
    places: list[tuple[int, str]] = field(default_factory=list)  # of base phrases: first word, label
    base: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    score: float = 0.0


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES):
        self.automaton = ahocorasick.Automaton()
        for kind, phrases in (("notice", notices), ("base", base), ("tag", {TAG: ""})):
            for phrase, label in phrases.items():
                raw = f" {phrase} ".encode().decode("latin-1")
                self.automaton.add_word(raw, (kind, label, len(raw)))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> Scan:
        words = text.translate(TO_WORDS).split()
        out = Scan(n_words=len(words))
        line = f" {b' '.join(words).decode('latin-1')} "
        tag, notices, starts = False, set(), []
        for end, (kind, label, length) in self.automaton.iter(line):
            if kind == "base":
                starts.append((end - length + 1, label))
            elif kind == "notice":
                notices.add(label)
            else:
                tag = True
        if starts:
            ends = np.cumsum([1 + len(w) for w in words])
            out.places = [(int(np.searchsorted(ends, at, side="right")), label) for at, label in starts]
        out.base = {label for _, label in out.places}
        out.labels = out.base | notices
        doubt = 0.4 ** len(out.base) * 0.6 ** len(notices)
        if tag:
            for m in TAG_LINE.finditer(text.lower()):
                try:
                    must, some = evaluate(postfix(m[1].decode("utf-8", "replace")))
                    out.labels |= must | {f"or:{x}" for x in some - must}
                    doubt *= 0.1 if must else 0.2
                except ExpressionError:
                    doubt *= 0.7
        out.score = 1 - doubt
        return out


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """``(doc_id, n_words, places, base, labels, score)`` for each row of ``docs(doc_id, text)``.

    ``places``: each place of a base phrase, its first word (from 0) and label.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))

    def run(batches):
        scanner = Scanner(base, notices)
        for batch in slices(batches):
            found = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_words": pa.array([s.n_words for s in found], pa.int64()),
                "places": pa.array([[{"word": w, "label": x} for w, x in s.places] for s in found], place),
                "base": pa.array([sorted(s.base) for s in found], pa.list_(pa.string())),
                "labels": pa.array([sorted(s.labels) for s in found], pa.list_(pa.string())),
                "score": pa.array([s.score for s in found], pa.float64())})

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, places array<struct<word: long, label: string>>, base array<string>, "
             "labels array<string>, score double")
