"""Plain versions of the contracts, to hold the operators against."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import tiktoken
import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
MARKED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return BLANK.findall(text or "")


def contamination(docs, items, size=13):
    windows = {}
    for i, t in items:
        w = MARKED.findall((t or "").translate(LOW))
        if w:
            n = min(size, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = MARKED.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def base_scores(docs):
    toks = {}
    count = Counter()
    for k, (d, t) in enumerate(docs):
        toks[k] = [*words((t or "").translate(LOW)), "\n"]
        if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1:
            count.update(toks[k])
    n, v = sum(count.values()), len(count)
    return [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1, len(toks[k]), sum(count[w] > 0 for w in toks[k]), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks[k])) for k, (d, _) in enumerate(docs)]


def token_rows(docs, tokenizer):
    at, out = 0, []
    for d, t in docs:  # ascending
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def bpe_rows(docs, ranks, pattern):
    e = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return [(d, len(ids := e.encode_ordinary(t or "")), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for d, t in docs]


def simhash(text, size=4):
    w = words((text or "").translate(LOW))
    if not w:
        return 0
    size = min(size, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + size]).encode(), 42) for k in range(len(w) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(docs, limit=4, prints=None):
    fps = np.array(prints if prints is not None else [simhash(t) for _, t in docs], np.uint64)
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[k + 1 :] ^ fps[k]) <= limit) + k + 1:
            root[top(int(j))] = top(k)
    least = {}
    for k, (d, _) in enumerate(docs):
        r = top(k)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(d, f"{int(f):016x}", least[top(k)]) for k, ((d, _), f) in enumerate(zip(docs, fps, strict=True))]


def substring_rows(docs, size=50):
    first = {}
    split = [(d, words(t)) for d, t in docs]
    for d, w in split:
        if d is not None:
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for k in range(len(w) - size + 1):
                if first[tuple(w[k : k + size])] < d:
                    gone.update(range(k, k + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def rule_counts(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = Counter(grams)
        again = {p for k, g in enumerate(grams) if count[g] > 1 for p in range(k, k + 3)}
        base = len(w) < 50 or 100 * len(again) > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), base))
    return out


def similar_lines(docs, least=1):
    """{(doc, line number)} with an earlier line of similarity 4/5 or more."""
    rows = sorted((d, n, frozenset(words(x.translate(LOW)))) for d, t in docs if d is not None and t is not None for n, x in enumerate(t.split("\n")))
    rows = [r for r in rows if len(r[2]) >= least]
    by_word = {}
    gone = set()
    for k, (d, n, s) in enumerate(rows):
        common = Counter(j for w in s for j in by_word.get(w, ()) if (rows[j][0], rows[j][1]) < (d, n))
        if any(9 * c >= 4 * (len(s) + len(rows[j][2])) for j, c in common.items()):
            gone.add((d, n))
        for w in s:
            by_word.setdefault(w, []).append(k)
    return gone
