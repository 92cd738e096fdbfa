"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(text, items, window=13):
    w, hit, found = words(text), set(), []
    for item, passage in items:
        b = words(passage)
        n = min(window, len(b))
        wanted = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
        at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in wanted] if wanted else []
        if at:
            found.append(str(item))
            hit.update(p for k in at for p in range(k, k + n))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


def repeats(docs, length=100):
    """``docs``: ``(id, text)``; returns id -> bytes, removed, runs, hash of the rest."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[doc] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset([("raw", text)])


def near_duplicates(docs, similarity=0.8):
    """``docs``: ``(id, text)`` with text; returns id -> class, copy, links."""
    first, sets = {}, {}
    for doc, text in sorted(docs):
        sets[doc] = shingles(text)
        first.setdefault(sets[doc], doc)
    reps, by_token, links = sorted(first.values()), defaultdict(list), defaultdict(set)
    root = {r: r for r in reps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in reps:
        for other, n in Counter(o for t in sets[r] for o in by_token[t]).items():
            if n >= similarity * (len(sets[r]) + len(sets[other]) - n) - 1e-9:
                links[r].add(other)
                links[other].add(r)
                a, b = sorted((find(r), find(other)))
                root[b] = a
        for t in sets[r]:
            by_token[t].append(r)
    return {doc: (find(first[sets[doc]]), first[sets[doc]], len(links[first[sets[doc]]])) for doc, _ in docs}


def top_k(vectors, queries, k=10):
    """``vectors``: ``(id, integers)``."""
    out = {}
    for q, x in queries:
        scored = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), v) for v, y in vectors if v != q))[:k]
        out[q] = [(r + 1, v, -s) for r, (s, v) in enumerate(scored)]
    return out


def spellings(word, pieces):
    """All ways to cut ``word`` into pieces."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in spellings(word[n:], pieces):
                yield [word[:n], *rest]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _tree(level):
    """Root, and for each leaf its siblings on the left and right, lowest first."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        for k, path in enumerate(paths):
            run, place = runs[at[k] // 8], at[k] % 8
            path.append(("".join(run[:place]), "".join(run[place + 1 :])))
            at[k] //= 8
        level = [digest("".join(run)) for run in runs]
    return level[0], paths


def manifest(rows):
    """``rows``: ``(doc_id, source, lang, n_chars, text)``."""

    def leaf(row):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in names}
    trees = {g: _tree([leaf(r) for r in ordered[g]]) for g in names}
    root, tops = _tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for row, path in zip(ordered[g], trees[g][1], strict=True):
            path, hit = path + top, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node = leaf((*row[:4], row[4].translate(LOWER))) if hit and row[4] is not None else leaf(row)
            for left, right in path:
                node = digest(left + node + right)
            out.append((row[0], leaf(row), trees[g][0], root, digest("".join(a + b for a, b in path)), node, node == root))
    return out


def parts(nodes, links):
    """Least node of the part of each node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs):
    """``docs``: ``(id, text)``."""
    prints = [fingerprint(t) for _, t in docs]
    kinds = sorted(set(prints))
    part = parts(kinds, [(a, b) for k, a in enumerate(kinds) for b in kinds[:k] if (a ^ b).bit_count() <= 2])
    least = {}
    for (doc, _), p in zip(docs, prints, strict=True):
        if doc is not None:
            least[part[p]] = min(doc, least.get(part[p], doc))
    return [(doc, f"{p:016x}", least.get(part[p])) for (doc, _), p in zip(docs, prints, strict=True)]


def search(docs, items, k=10):
    """``docs``, ``items``: ``(id, text)``."""
    counts = [Counter(words(t)) for _, t in docs]
    n_docs, n_terms = sum(1 for c in counts if c), sum(sum(c.values()) for c in counts)
    df, out = Counter(t for c in counts for t in c), []
    for item, text in items:
        scored = []
        for (doc, _), c in zip(docs, counts, strict=True):
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out
