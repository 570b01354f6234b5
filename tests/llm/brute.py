"""Plain versions of what the operators compute, for small inputs."""

import hashlib
from collections import Counter

import xxhash

SPACES = " \t\n\x0b\x0c\r"


def ascii_words(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACES:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality(text):
    words = ascii_words(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if ascii_words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), dup, len(covered))


def simhash(text):
    words = ascii_words(lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """doc_id -> smallest doc_id reachable over links of at most three bits, for (doc_id, fp) rows."""
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, fa) in enumerate(prints):
        for b, fb in prints[:i]:
            if (fa ^ fb).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d, _ in prints}


def word_dedup(docs, n):
    """doc_id -> (n_words, n_removed, sha256) for (doc_id, text) rows with distinct ids."""
    first = {}
    for d, t in sorted(docs):
        w = ascii_words(t)
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), d)
    out = {}
    for d, t in docs:
        w = ascii_words(t)
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d for j in range(i, i + n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def byte_dedup(docs, n):
    """Per row (doc_id, n_bytes, n_removed, n_spans, sha256)."""
    texts = [(d, (t or "").encode()) for d, t in docs]
    counts = Counter(b[i : i + n] for _, b in texts for i in range(len(b) - n + 1))
    out = []
    for d, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if counts[b[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)
