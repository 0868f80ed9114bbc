"""Plain-Python statements of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    n, r = len(words), len(covered)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(x in "#*$%&|<>" for x in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": r, "base_failed": n < 50 or 100 * r > 50 * n}


def targets(sizes, order):
    """Targets by the words of the contract: excess is reshared until none is above three times its source."""
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def repeated_bytes(texts, length=200):
    """Per text: removed bytes, spans, SHA-256 of the rest."""
    raw = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for k, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            places[b[i:i + length]].append((k, i))
    marks = [bytearray(len(b)) for b in raw]
    for at in places.values():
        if len(at) > 1:
            for k, i in at:
                marks[k][i:i + length] = b"\1" * length
    out = []
    for b, m in zip(raw, marks):
        spans = len(re.findall(rb"\x01+", bytes(m)))
        out.append((len(b), sum(m), spans, hashlib.sha256(bytes(c for c, f in zip(b, m) if not f)).hexdigest()))
    return out


def shingles(text, k):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def jaccard_components(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs}
    owners = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            owners[x].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        overlap = Counter(o for x in s for o in owners[x] if o > d)
        for o, n in overlap.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def contamination(docs, items, n=13, share=20):
    def words(t):
        return ALNUM_WORD.findall((t or "").translate(ASCII_LOWER))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[k:k + size])].add(i)
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        w, hit, met = words(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k:k + size])):
                    hit |= set(range(k, k + size))
                    met |= found
        ids = ",".join(sorted(str(i) for i in met))
        out[d] = (len(w), len(hit), len(met), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and share * len(hit) >= len(w))
    return out


ASSIGN = re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")


def secrets(text):
    text = text or ""
    assign = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    access = [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    hexes = [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    every = sorted((a, i, b, kind) for i, (kind, found) in enumerate((("assign", assign), ("access", access), ("hex", hexes))) for a, b in found)
    digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in every).encode()).hexdigest()
    return len(assign), len(access), len(hexes), digest


def token_rows(docs, encode):
    out, start = [], 0
    for d, t in sorted(docs):
        ids = [*encode(t or ""), 1]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def planted_words(doc_id, text):
    """The words of a text, repeated from a place on where the id's CRC asks for it."""
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n or doc_id is None:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def word_runs(w, exponent=4, least=6):
    """(start, length, period) of all runs: for each period the maximal stretches of words that equal the word a period on."""
    found, n = {}, len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, exponent * q) and not any(s <= i and i + length <= s + m and q % p == 0 for (s, p), m in found.items() if p < q):
                found[i, q] = length
            i = j
    return sorted((s, m, q) for (s, q), m in found.items())


def periodic_row(w):
    runs = sorted(word_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def importance_rows(docs, target, buckets=10_000, percent=25, min_words=20):
    """doc_id -> n_features, weight, score, rank."""
    def features(t):
        w = ALNUM_WORD.findall((t or "").translate(ASCII_LOWER))
        return len(w), [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    source, wanted = Counter(), Counter()
    held = {}
    for d, t in docs:
        held[d] = features(t)
        source.update(held[d][1])
    for t in target:
        wanted.update(features(t)[1])
    s_all, t_all = float(sum(source.values())), float(sum(wanted.values()))
    gain = [math.floor(1000 * math.log((wanted[b] + 1.0) * (s_all + buckets) / ((source[b] + 1.0) * (t_all + buckets)))) for b in range(buckets)]
    out = {}
    for d, (n, found) in held.items():
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        out[d] = (len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    open_ = sorted((d for d in held if held[d][0] >= min_words), key=lambda d: (-out[d][2], d))
    rank = {d: k + 1 for k, d in enumerate(open_[:percent * len(open_) // 100])}
    return {d: (*x, rank.get(d)) for d, x in out.items()}
