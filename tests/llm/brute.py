"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def suffix_dedup(docs, length=100):
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for p in range(len(body) - length + 1):
            s = body[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        out[doc] = (len(body), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, k=5):
    words = SPACED.findall(lower(text))
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near_duplicates(docs, percent=85):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    for d, s in sets.items():
        both = Counter(o for x in s for o in where[x] if o > d)
        for o, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(d), find(o)))
                parent[b] = a
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def contamination(docs, items, window=13):
    windows = defaultdict(set)
    for i, text in items:
        words = ALNUM.findall(lower(text))
        n = min(window, len(words))
        for p in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[p : p + n])].add(i)
    out = {}
    for d, text in docs:
        words = ALNUM.findall(lower(text))
        hit, found = [0] * len(words), set()
        for n in {len(w) for w in windows}:
            for p in range(len(words) - n + 1):
                w = tuple(words[p : p + n])
                if w in windows:
                    found |= windows[w]
                    hit[p : p + n] = [1] * n
        out[d] = (len(words), sum(hit), sorted(found))
    return out


def base_scores(docs):
    tokens = {d: [*SPACED.findall(lower(t)), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(x for d, ts in tokens.items() if not held[d] for x in ts)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ts), sum(c[x] > 0 for x in ts), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ts)) for d, ts in tokens.items()}


def interpolated(docs, weights):
    """Scores of the bigram model with given weights by context bucket."""
    tokens = {d: [*SPACED.findall(lower(t)), None] for d, t in docs}
    train = [ts for d, ts in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    one, two, ctx = Counter(x for ts in train for x in ts), Counter(), Counter()
    for ts in train:
        for a, b in zip(["<s>", *ts[:-1]], ts, strict=True):
            two[a, b] += 1
            ctx[a] += 1
    n, v = sum(one.values()), len(one)
    out = {}
    for d, ts in tokens.items():
        total = 0.0
        for a, b in zip(["<s>", *ts[:-1]], ts, strict=True):
            w = weights[int(ctx[a]).bit_length()]
            total += math.log10(w[0] / (v + 1) + w[1] * one[b] / n + (w[2] * two[a, b] / ctx[a] if ctx[a] else 0))
        out[d] = total
    return out


def em_histogram(docs, learns, tunes, grain=4):
    """(bucket, r2, r1) -> count over the tokens of tuning documents, from counts of the other training documents."""
    tokens = {d: [*SPACED.findall(lower(t)), None] for d, t in docs}
    one, two, ctx = Counter(), Counter(), Counter()
    for d, ts in tokens.items():
        if learns(d) and not tunes(d):
            one.update(ts)
            for a, b in zip(["<s>", *ts[:-1]], ts, strict=True):
                two[a, b] += 1
                ctx[a] += 1
    n, v, out = sum(one.values()), len(one), Counter()
    step = lambda p: round(math.log2(p * (v + 1)) * grain) if p > 0 else -(10**6)
    for d, ts in tokens.items():
        if tunes(d):
            for a, b in zip(["<s>", *ts[:-1]], ts, strict=True):
                out[int(ctx[a]).bit_length(), step(two[a, b] / ctx[a] if ctx[a] else 0), step(one[b] / n)] += 1
    return out


def language(model, text):
    """(language, score) of a text by the model's table, one subword after the other."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    body = b" " + b"".join(bytes([b]) if b >= 128 or 97 <= b <= 122 else b" " for b in text.lower().encode()) + b" "
    total, sums = 0, [0.0] * len(model.langs)
    for n in (1, 2, 3, 4):
        for i in range(len(body) - n + 1):
            s = body[i : i + n]
            if b" " in s[1:-1] or s == b" " or (n > 1 and s[:1] == b" " and s[-1:] == b" "):
                continue
            bucket = (int.from_bytes(s, "big") * ((0x9E3779B1 + 2 * 0x1000193 * n) % 2**32) % 2**32) >> 17
            total += 1
            sums = [x + float(y) for x, y in zip(sums, model.scores[bucket], strict=True)]
    logits = [(x / max(total, 1) + float(b)) / model.temperature for x, b in zip(sums, model.bias, strict=True)]
    p = [math.exp(x - max(logits)) for x in logits]
    best = max(range(len(p)), key=p.__getitem__)
    return model.langs[best], p[best] / sum(p)


def tokens(docs, tokenizer, end=2):
    at, out = 0, []
    for d, text in sorted(docs, key=lambda d: d[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def mix(docs, weights=(5, 2, 1), most=3):
    """(targets by source) by repeating the rule: share, cut, share again what was cut."""
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(SPACED.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        total, spare = sum(weight[s] for s in free), 0.0
        for s in list(free):
            target[s] += left * weight[s] / total
        for s in list(free):
            if target[s] > most * sizes[s]:
                spare += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                free.discard(s)
        left = spare
    return sizes, target


def imatch(docs, low=math.log(100), high=math.log(100_000)):
    """Fingerprints and likenesses of (doc_id, text) and of their edited texts: doc_id -> row."""
    import xxhash

    signed = lambda h: h - 2**64 if h >= 2**63 else h
    h_text = lambda s, seed=42: xxhash.xxh64_intdigest(s.encode(), seed)

    def h_longs(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed)
        return seed

    def terms(text):
        return {signed(h_text(w)) for w in ALNUM.findall(text.lower())}

    docs = sorted(((d, t or "") for d, t in docs), key=lambda r: -r[0])
    n, df = len(docs), Counter(b for _, t in docs for b in {x % 2**21 for x in terms(t)})
    band = {b for b, c in df.items() if n * math.exp(-high) <= c <= (n + math.exp(low)) * math.exp(-low)}

    def fingerprint(text):
        own = sorted(x for x in terms(text) if x % 2**21 in band)
        step = 5
        while len(own) > 1.5 * 2**step:
            step += 2

        def subsets(bits):
            place = lambda x: (x % 2**64 >> 21) % 2**bits
            # a subset's terms as the number of the subset above 58 bits of the term
            held = [[k << 58 | x % 2**64 >> 6 for x in own if place(x) == k] for k in range(32)]
            return [signed(h_longs(vs)) % (2**24 - 1) + 1 if vs else 0 for vs in held]

        full = h_longs(own) if own else h_text("text", h_text(text))
        return full, step, subsets(step), subsets(step + 2)

    def likeness(a, b):
        if a[0] == b[0]:
            return 1.0
        x, y = {0: (a[2] + a[3], b[2] + b[3]), 2: (a[3], b[2]), -2: (a[2], b[3])}.get(b[1] - a[1], ([], []))
        either = [(p, q) for p, q in zip(x, y, strict=True) if p or q]
        return sum(p == q for p, q in either) / len(either) if either else 0.0

    show = lambda f: f"{f[0]:016x}:{f[1]}:" + "".join(f"{h:06x}" for h in f[2] + f[3])
    out = {}
    for i, (d, text) in enumerate(docs):
        after = docs[(i + 1) % n][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, nxt = fingerprint(text), fingerprint(edited), fingerprint(after)
        out[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), show(own), show(other), likeness(own, other), likeness(own, nxt))
    return out


def periodic_runs(words):
    """(start, length, period) by start and period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i + q - s
            if size >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(s, s + size - p)) for p in range(1, q)):
                out.append((s, size, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def hard_negatives(rows, anchor, positives=5, negatives=3, scale=256, low=50, high=95):
    """rows: (id, label, vector) in order of place; anchor(id) -> bool. Null ids sort lowest."""
    kept = []
    for place, (i, label, v) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, label, [math.floor(float(x) * scale) for x in v], place))
    order = lambda s: (-s[0], s[1] is not None, s[1] or 0)
    out = []
    for i, label, v, place in kept:
        if i is None or not anchor(i):
            continue
        found = [(sum(a * b for a, b in zip(v, w, strict=False)), j, m) for j, m, w, at in kept if at != place]
        best = sorted((s for s in found if s[2] == label), key=order)[:positives]
        for ps, pid, _ in best:
            fit = sorted((s for s in found if s[2] != label and low * ps <= 100 * s[0] <= high * ps), key=order)[:negatives]
            out += [(i, pid, rank, nid, ps, ns) for rank, (ns, nid, _) in enumerate(fit, 1)]
    return out
