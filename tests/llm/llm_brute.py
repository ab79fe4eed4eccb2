"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").encode().lower()  # bytes.lower touches A-Z only


def shingles(text, width=5):
    w = SPACE_WORD.findall(lower(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_components(docs):
    """{position: (n, component)} for a list of (id, text)."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            r = find(i)
            least[r] = min(least.get(r, k), k)
    return [(k, len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(docs, sets, strict=True))]


def cut_repeats(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), spans, kept))
    return out


def windows(items, width=13):
    out = defaultdict(set)
    for item, text in items:
        w = ALNUM_WORD.findall(lower(text))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            out[tuple(w[i : i + width])].add(item)
    return out


def contamination(text, found):
    w = ALNUM_WORD.findall(lower(text))
    hit, items = [False] * len(w), set()
    for n in {len(k) for k in found}:
        for i in range(len(w) - n + 1):
            if (s := found.get(tuple(w[i : i + n]))) is not None:
                hit[i : i + n] = [True] * n
                items |= s
    n = sum(hit)
    return len(w), n, len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), n > 0 and 20 * n >= len(w)
