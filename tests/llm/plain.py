"""The operators' results, worked out one document at a time."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict


def order(doc_id):
    return -(2**63) if doc_id is None else doc_id


def split(text):
    return (text or "").encode().split()


def byte_repeats(rows, size):
    texts = [(order(r[0]), (r[1] or "").encode(), r[0]) for r in rows]
    first = {}
    for i, b, _ in texts:
        for s in range(len(b) - size + 1):
            w = b[s:s + size]
            first[w] = min(first.get(w, (i, s)), (i, s))
    out = []
    for i, b, doc in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if first[b[s:s + size]] < (i, s):
                gone[s:s + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def window_repeats(rows, size):
    texts = [(order(r[0]), split(r[1]), r[0]) for r in rows]
    first = {}
    for i, w, _ in texts:
        for s in range(len(w) - size + 1):
            k = tuple(w[s:s + size])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w, doc in texts:
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s:s + size])] < i:
                gone[s:s + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, size):
    w = (text or "").encode().lower().split()
    if len(w) >= size:
        return frozenset(zip(*[w[i:] for i in range(size)]))
    return frozenset([tuple(w)] if w else [])


def near_groups(rows, size, percent=80):
    """(doc_id, n_shingles, component_id, kept), by comparing all pairs."""
    sets = [(r[0], shingles(r[1], size)) for r in rows]
    above = {d: d for d, _ in sets if d is not None}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is None or b is None or not x or not y or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                lo, hi = sorted((top(a), top(b)))
                above[hi] = lo
    return [(d, len(x), top(d) if d is not None else None, d is None or top(d) == d) for d, x in sets]


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def text_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    w = split(text)
    text = text or ""
    times = Counter(zip(w, w[1:], w[2:]))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if times[w[i], w[i + 1], w[i + 2]] > 1:
            hit[i:i + 3] = [True] * 3
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit))


def leaks(rows, items, least=0.8, size=5):
    """{(doc_id, item_id)} whose best window of the item's length reaches the weighted similarity."""
    found = set()
    grams = defaultdict(set)
    wanted = {}
    for item, text in items:
        w = text.encode().lower().split()
        wanted[item] = (len(w), Counter(zip(*[w[i:] for i in range(size)])))
        for g in wanted[item][1]:
            grams[g].add(item)
    for doc, text, *_ in rows:
        w = split((text or "").lower())
        s = list(zip(*[w[i:] for i in range(size)]))
        for item in {i for g in s for i in grams.get(g, ())}:
            n, counts = wanted[item]
            for k in range(len(s)):
                c = Counter(s[k:k + n - size + 1])
                both = sum((c & counts).values())
                if both >= least * (sum(c.values()) + sum(counts.values()) - both):
                    found.add((doc, item))
    return found


LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def spelling(rows, least=6, often=5, times=5, one_in=199):
    n = Counter()
    for r in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % one_in == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= often}
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for w, others in near.items():
        b = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = b if b is not None and n[b] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return out


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def divergence(rows, least=10, top=10):
    terms, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        terms[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: terms[lang, s][t] for t in kept})

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(terms[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if terms[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found[:limit], start=1)]
    return out


def line_repeats(rows, least_chars=20, least_docs=3):
    held = defaultdict(set)
    keyed = [(order(r[0]), r[0], [(x, x.strip(" \t\n\x0b\x0c\r").translate(LOWER)) for x in (r[1] or "").split("\n")]) for r in rows]
    for i, _, lines in keyed:
        for _, key in lines:
            held[key].add(i)
    out = []
    for i, doc, lines in keyed:
        gone = [len(k) >= least_chars and len(held[k]) >= least_docs and i < max(held[k]) for _, k in lines]
        kept = "\n".join(x for (x, _), g in zip(lines, gone) if not g)
        out.append((doc, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
