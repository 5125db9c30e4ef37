"""Plain versions of the contracts, one text at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SECRET = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    w = BLANK.findall(low(text))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def simhash(docs):
    """{doc_id: (hex, component)} by comparing all fingerprints."""
    prints = {i: fingerprint(t) for i, t in docs}
    first = {}
    for i in sorted(prints):
        first.setdefault(prints[i], i)
    keys = sorted(first)
    links = [(first[a], first[b]) for k, a in enumerate(keys) for b in keys[k + 1 :] if (a ^ b).bit_count() <= 3]
    found = components(prints, links + [(first[p], i) for i, p in prints.items()])
    return {i: (f"{prints[i]:016x}", found[i]) for i in prints}


def quality(text):
    text = text or ""
    w = BLANK.findall(text)
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n = Counter(grams)
    inside = {j for k, g in enumerate(grams) if n[g] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def windows(items, width=10):
    out = {}
    for i, t in items:
        w = BENCH.findall(low(t))
        for k in range(max(1, len(w) - width + 1)):
            if g := tuple(w[k : k + width]):
                out.setdefault(g, set()).add(i)
    return out


def contamination(text, found):
    w = BENCH.findall(low(text))
    hit, items = set(), set()
    for n in {len(g) for g in found}:
        for k in range(len(w) - n + 1):
            if (g := tuple(w[k : k + n])) in found:
                hit |= set(range(k, k + n))
                items |= found[g]
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in SECRET.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def word_scores(docs):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score)}."""
    tokens = {i: BLANK.findall(low(t)) + ["\n"] for i, t in docs}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    return {i: (len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


def binomial_tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
