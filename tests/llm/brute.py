"""Plain single-process versions of the operators' contracts."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def words(text):
    return WORD.findall(lower(text))


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def components(rows):
    """{doc_id: (set size, smallest reachable id)} of ``(doc_id, text)``."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    by_shingle = {}
    for n, (_, s) in enumerate(flat):
        for x in s:
            by_shingle.setdefault(x, []).append(n)
    seen = set()
    for group in by_shingle.values():
        for a, b in itertools.combinations(group, 2):
            if (a, b) in seen:
                continue
            seen.add((a, b))
            (i, s), (j, t) = flat[a], flat[b]
            both = len(s & t)
            if 100 * both >= 75 * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def unigram(rows):
    """[(doc_id, held_out, n_tokens, n_known, train_tokens, base)] of ``(doc_id, text)``."""
    toks = [(i, [*words(t), b"\n"]) for i, t in rows]
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in toks]
    count = Counter(w for (_, ws), held in zip(toks, out, strict=True) if not held for w in ws)
    total, vocabulary = sum(count.values()), len(count)
    return [(i, held, len(ws), sum(count[w] > 0 for w in ws), total,
             sum(math.log10((count[w] + 1) / (total + vocabulary + 1)) for w in ws))
            for (i, ws), held in zip(toks, out, strict=True)]


def targets(sizes, cap=3, weights=(1, 2, 3)):
    """Targets of ``[(source, size)]`` by resharing step by step; null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in full]
        total = sum(w[s] for s in free)
        share = {s: left * w[s] / total for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return got | share
        for s in over:
            got[s] = float(cap * sizes[s])
            left -= got[s]
            full.add(s)


def license_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def license_base(text, phrases):
    w = license_words(text)
    hits = []
    for phrase, label in phrases.items():
        p = phrase.encode().split()
        hits += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return len(w), sorted(hits)


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def verdict(url, rules):
    host, path = host_path(url)
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    return host, path, *max(fits)[2:]


def damage(rows):
    """``(conv_id, turn, role, text)`` rows after damage, in order; nulls shown as one space."""
    show = lambda x: " " if x is None else str(x)
    order = lambda r: (r[1] is not None, r[1] or 0, show(r[2]), hashlib.sha256(show(r[3]).encode()).digest())
    out = []
    for conv, turn, role, text in rows:
        spot = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if spot == 0:
            continue
        text = "" if spot == 1 else re.sub("[.!?]", "", text) if spot == 2 else text
        out += [(conv, turn, "user" if spot == 4 else role, text)] * (2 if spot == 3 else 1)
    return sorted(out, key=order)


def repair(rows):
    """``(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired rows)`` of one conversation's ordered rows."""
    found, seen = [], set()
    for _, _, role, text in rows:
        chars = re.findall(r"[^\x20\x09-\x0D]", text)
        found.append("blank" if not chars else "duplicate" if (role, text) in seen else
                     "truncated" if chars[-1] not in ".!?" else "fine")
        seen.add((role, text))
    nxt = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    turn = {"": "u", "s": "u", "a": "u", "u": "a"}
    best = {}
    # From the end; a node is (row, state, Inserts made since the last row).
    for i in range(len(rows), -1, -1):
        for made in (2, 1, 0):
            for q in ("", "s", "u", "a"):
                ways = [(0, "", ())] if i == len(rows) and q in ("", "a") else []

                def way(cost, letter, row, node, ways=ways):
                    if best.get(node):
                        c, audit, kept = best[node]
                        ways.append((cost + c, letter + audit, row + kept))

                if made < 2:
                    t = turn[q]
                    way(3, "I", (({"u": "user", "a": "assistant"}[t], ""),), (i, t, made + 1))
                if i < len(rows):
                    _, _, role, text = rows[i]
                    way(4, "D", (), (i + 1, q, 0))
                    if found[i] in ("fine", "truncated"):
                        more = 3 * (found[i] == "truncated")
                        if (q, role[:1]) in nxt:
                            way(more, "K", ((role, text),), (i + 1, nxt[q, role[:1]], 0))
                        t = turn[q]
                        way(3 + more, "R", (({"u": "user", "a": "assistant"}[t], text),), (i + 1, t, 0))
                best[i, q, made] = min(ways) if ways else None
    turns = {t for _, t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, kept = best[0, "", 0]
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, kept)


def conversations(rows):
    """The digest rows of all conversations by their ids."""
    out = {}
    for conv in {r[0] for r in rows}:
        *counts, kept = repair(damage([r for r in rows if r[0] == conv]))
        text = "\n".join(f"{role}:{t}" for role, t in kept)
        out[conv] = (*counts, hashlib.sha256(text.encode()).hexdigest())
    return out


def product_codes(rows, parts=4, entries=256, rounds=4):
    """``([(vec_id, code, error, label_error)], digest)`` of ``(vec_id, vector, label)`` with whole vectors."""
    rows = sorted(((i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for _, v, _ in rows] for p in range(parts)]
    books = [[list(x) for x in cut[p][:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - c) ** 2 for a, c in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in cut[p]:
                groups.setdefault(nearest(x, books[p])[1], []).append(x)
            for k, xs in groups.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    final = [[nearest(x, books[p]) for x in cut[p]] for p in range(parts)]
    errors = [sum(final[p][n][0] for p in range(parts)) for n in range(len(rows))]
    label = Counter()
    for (_, _, lab), e in zip(rows, errors):
        label[lab] += e
    text = ",".join(str(x) for book in books for e in book for x in e)
    return [(i, "".join(f"{final[p][n][1]:02x}" for p in range(parts)), errors[n], label[lab])
            for n, (i, _, lab) in enumerate(rows)], hashlib.sha256(text.encode()).hexdigest()


class Tree:
    """The suffix tree over words of ``texts``, by dictionaries of runs (nearest symbol last)."""

    def __init__(self, texts, depth, occurrences, listed):
        self.depth = depth
        streams = [[*words(t), b"\n"] for t in texts]
        self.word = Counter(w for s in streams for w in s)
        self.size = sum(self.word.values()) + len(self.word) + 1
        grams = [Counter() for _ in range(depth + 1)]
        totals = Counter()
        for s in streams:
            padded = [b"\n"] * depth + s
            for j in range(len(s)):
                for k in range(depth + 1):
                    run = tuple(padded[j + depth - k:j + depth + 1])
                    grams[k][run] += 1
                    if k:
                        totals[run[:-1]] += 1
        below = {(w,): n for w, n in self.word.items()}
        self.p, self.rest, self.states = {}, {}, {()}
        for k in range(1, depth + 1):
            contexts = {c for c, n in below.items() if n >= occurrences}
            nexts = {}
            for run, n in grams[k].items():
                if run[:-1] in contexts and n >= listed and below.get(run[1:], 0) >= listed:
                    nexts.setdefault(run[:-1], {})[run[-1]] = n
            below, diverge = {}, set()
            for c, ns in nexts.items():
                n, t = totals[c], len(ns)
                q = {w: self.after(c[1:], w, all_states=True) for w in ns}
                rest, share = n - sum(ns.values()), max(1 - sum(q.values()), 1e-12)
                g = 2 * sum(x * math.log(x / n / q[w]) for w, x in ns.items()) + (2 * rest * math.log(rest / n / share) if rest else 0)
                if g > t + 3 * math.sqrt(2 * t + 1):
                    diverge.add(c)
                self.p[c] = {w: (x + t * q[w]) / (n + t) for w, x in ns.items()}
                self.rest[c] = max((rest + t * share) / (n + t) / share, 1e-12)
                below |= {(*c, w): x for w, x in ns.items()}
            self.states |= {c[i:] for c in diverge for i in range(len(c) + 1)}

    def after(self, context, w, all_states=False):
        if not context:
            return (self.word[w] + 1) / self.size
        if context not in self.p or not (all_states or context in self.states):
            return self.after(context[1:], w, all_states)
        if w in self.p[context]:
            return self.p[context][w]
        return self.rest[context] * self.after(context[1:], w, all_states)

    def score(self, text):
        s = [*words(text), b"\n"]
        padded = [b"\n"] * self.depth + s
        return sum(math.log10(self.after(tuple(padded[j:j + self.depth]), w)) for j, w in enumerate(s))
