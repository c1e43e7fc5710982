"""Plain versions of the operators, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def group(n, links):
    """Smallest member of each member's group."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def smallest_ids(ids, roots):
    low = {}
    for i, r in zip(ids, roots):
        if i is not None and i == i:
            low[r] = min(low.get(r, i), i)
    return [low.get(r) for r in roots]


def simhash(text, shingle=4):
    w = words(text)
    if not w:
        return 0
    runs = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    ones = Counter()
    for r in runs:
        h = xxhash.xxh64(r.encode(), seed=42).intdigest()
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(runs))


def simhash_groups(ids, texts, bits=4):
    prints = [simhash(t) for t in texts]
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits]
    return prints, smallest_ids(ids, group(len(prints), links))


def cosine_links(ids, vectors, cosine=0.95):
    unit = []
    for v in vectors:
        good = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / math.sqrt(sum(float(x) ** 2 for x in v)) if good else None)
    links = [
        (i, j) for i in range(len(unit)) for j in range(i)
        if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine
    ]
    n = Counter(x for link in links for x in link)
    return [n[i] for i in range(len(unit))], smallest_ids(ids, group(len(unit), links))


class SuffixTree:
    def __init__(self, rows, depth=2, fold=10):
        self.depth, self.fold = depth, fold
        self.one, self.after = Counter(), defaultdict(Counter)
        for id, text in rows:
            if self.out(id):
                continue
            w = [*words(text), None]
            self.one.update(w)
            for k in range(1, depth + 1):
                for p in range(k, len(w)):
                    self.after[tuple(w[p - k : p])][w[p]] += 1
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.nodes = {}

    def out(self, id):
        return zlib.crc32(("" if id is None else str(id)).encode()) % self.fold == 0

    def node(self, context):
        """Each occurrence predicted by the others against the suffix, whose logarithms are in eighths."""
        if context not in self.nodes:
            q = self.after.get(context, {})
            n, gain = sum(q.values()), 0.0
            if n > 1:
                for word, c in q.items():
                    suffix = min(255, round(-8 * math.log(self.probability(context[1:], word)))) / 8
                    others = len(q) - (c == 1)
                    gain += c * (math.log((c - 1 + others * math.exp(-suffix)) / (n - 1 + others)) + suffix)
            self.nodes[context] = gain > 3
        return self.nodes[context]

    def probability(self, context, word):
        if not context:
            return (self.one[word] + 0.1) / (self.n + 0.1 * (self.v + 1))
        shorter = self.probability(context[1:], word)
        if not self.node(context):
            return shorter
        q = self.after[context]
        return (q[word] + len(q) * shorter) / (sum(q.values()) + len(q))

    def score(self, text):
        w = [*words(text), None]
        base = total = 0.0
        for p, word in enumerate(w):
            history = tuple(w[max(0, p - self.depth) : p])
            base += math.log10(self.probability((), word))
            total += math.log10(self.probability(history, word))
        return base, total


def bm25(docs, queries, k=10):
    counts = [Counter(words(t)) for _, t in docs]
    n = len(docs)
    average = sum(sum(c.values()) for c in counts) / max(n, 1)
    df = Counter(w for c in counts for w in c)
    out = {}
    for qid, text in queries:
        scores = []
        for (id, _), c in zip(docs, counts):
            length = 1.2 * (0.25 + 0.75 * sum(c.values()) / average) if average else 1.2
            s = sum(
                qt * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + length)
                for w, qt in Counter(words(text)).items() if w in c
            )
            if s > 0:
                scores.append((-round(s, 9), id is None, id))
        out[qid] = [(id, -s) for s, _, id in sorted(scores)[:k]]
    return out


def repeats(rows, window):
    """(id, words, removed, kept) of (id, text) rows, window by window."""
    split = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, split):
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for at in range(len(w) - window + 1):
            if i is not None and first[tuple(w[at : at + window])] < i:
                gone.update(range(at, at + window))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), " ".join(kept)))
    return out


def divergences(rows, least_docs, top):
    """Rows (lang, source, part, item, value, rank) for (lang, source, text) rows."""
    rows = [(lang or "", source or "", text or "") for lang, source, text in rows]
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({u: u + 32 for u in range(65, 91)}))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(s, t) for a, s, t in found if a == lang]
        docs = Counter(term for _, t in mine for term in set(t))
        kept = sorted(t for t, n in docs.items() if n >= least_docs)
        counts = {s: Counter() for s, _ in mine}
        for s, t in mine:
            counts[s].update(x for x in t if docs[x] >= least_docs)
        whole = sum(counts.values(), Counter())

        def share(c, term):
            return 1 + 1_000_000_000 * (c[term] + 2) // (sum(c.values()) + 2 * len(kept))

        for s, c in counts.items():
            p = {t: share(c, t) for t in kept}
            parts = {"pair": [], "term": []}
            for o, d in counts.items():
                if o != s:
                    parts["pair"].append((o, sum((p[t] - share(d, t)) ** 2 // (p[t] + share(d, t)) for t in kept)))
            for t in kept:
                q = share(whole, t)
                if c[t] and p[t] > q:
                    parts["term"].append((t, (p[t] - q) ** 2 // (p[t] + q)))
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, r) for r, (item, v) in enumerate(items, 1) if part == "pair" or r <= top]
    return out


def codes(rows, scale, parts, entries, rounds):
    """Rows (id, code, error) and the codebooks of (id, vector) rows in order of id, with Python's integers."""
    length = len(rows[0][1])
    cut = [(p * length // parts, (p + 1) * length // parts) for p in range(parts)]
    data = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    books = [[v[a:b] for _, v in data[:entries]] for a, b in cut]

    def best(x, book):
        d = [sum((p - q) ** 2 for p, q in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for (a, b), book in zip(cut, books):
            groups = {}
            for _, v in data:
                groups.setdefault(best(v[a:b], book)[0], []).append(v[a:b])
            for e, members in groups.items():
                book[e] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for i, v in data:
        found = [best(v[a:b], book) for (a, b), book in zip(cut, books)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    return out, books
