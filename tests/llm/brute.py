"""Plain single-machine versions of the corpus operators' contracts."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def shingles(text, k=5):
    w = words(lowered(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))


def near_duplicates(rows):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    ids = sorted(sets)
    for a in ids:
        common = Counter(b for x in sets[a] for b in by[x] if b < a)
        for b, n in common.items():
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def base_counts(text):
    text = text or ""
    w = words(text)
    chars, symbols = sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>")
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), chars, symbols, dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def substring_dedup(rows, k=13):
    """{doc_id: (n_words, n_removed, sha256)}"""
    first = {}
    texts = {d: words(t) for d, t in rows}
    for d, w in texts.items():
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(d, first.get(key, d))
    out = {}
    for d, w in texts.items():
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = len(w), len(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    """[(start, rank, kind, end)]"""
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return sorted(found)


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", url[url.index("://") + 3 :])
    return lowered(m[1]), m[2]


def line_dedup(rows, run=3):
    """{doc_id: (n_lines, n_removed, text)} of distinct doc_ids."""
    places, texts = defaultdict(list), {}
    for d, t in sorted(rows):
        every = [] if t is None else t.split("\n")
        at = [i for i, x in enumerate(every) if WORD.search(x)]
        texts[d] = t, every, at
        for k in range(len(at) - run + 1):
            places[tuple(every[i] for i in at[k : k + run])].append((d, k))
    gone = defaultdict(set)
    for found in places.values():
        for d, k in sorted(found)[1:]:
            gone[d].update(texts[d][2][k : k + run])
    return {d: (len(at), len(gone[d]), None if t is None else "\n".join(x for i, x in enumerate(every) if i not in gone[d])) for d, (t, every, at) in texts.items()}


def kneser_ney(texts, order=5, parts=False):
    """{n-gram: (probability, the same without its own share if it is there once)}, from strings alone; with ``parts`` the
    n-gram's count, what its occurrences give, and what the lower orders give, for the highest order."""
    levels = [Counter("".join(x) for t in texts for x in zip(*(("\n" * (order - 1) + t)[i:] for i in range(order)), strict=False))]
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    below = {}
    for k, level in enumerate(levels[::-1], 1):
        n1, n2, n3, n4 = (sum(n == i for n in level.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [max(0.05, i - (i + 1) * y * b / a) if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cut = {g: min(d[min(n, 3) - 1], n) for g, n in level.items()}
        total, left, kinds = Counter(), Counter(), Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            left[g[:-1]] += cut[g]
            kinds[g[:-1]] += 1
        now = {}
        for g, n in level.items():
            c = g[:-1]
            lower = below[g[1:]] if k > 1 else (1 / (kinds[c] + 1),) * 2
            own, rest = (n - cut[g]) / total[c], left[c] / total[c]
            now[g] = (n, own, rest * lower[1]) if parts and k == order else (own + rest * lower[0], (own if n > 1 else 0) + rest * lower[1])
        below = now
    return below


def quality_kept(rows, above, below, least, order=5, per=500):
    """{doc_id: (nats a word or None, kept; None where the score is within rounding of a band's end)}"""
    score, base = {}, {}
    for lang in {r[2] for r in rows}:
        mine = [(d, t) for d, t, x in rows if x == lang]
        model = kneser_ney([t.lower() for _, t in mine if t], order, parts=True)
        for d, t in mine:
            base[d] = base_counts(t)
            padded = "\n" * (order - 1) + (t or "").lower()
            grams = Counter(padded[i : i + order] for i in range(len(padded) - order + 1))
            part = lambda g, m: model[g][1] * max(model[g][0] - m - 0.75, 0) / (model[g][0] - 0.75) + model[g][2]  # noqa: E731  without the text's own m
            score[d] = -sum(m * math.log(part(g, m)) for g, m in grams.items()) / base[d][0] if t and base[d][0] else None
    found = {}
    for lang in {r[2] for r in rows}:
        ids = [d for d, _, x in rows if x == lang]
        bins = np.array([math.floor(score[d] * per) for d in ids if not base[d][5] and score[d] is not None])
        middle = np.median(bins) if len(bins) else 0
        spread = 1.4826 * np.median(np.abs(bins - middle)) if len(bins) else 0
        low, high = (middle + 0.5 - max(below * spread, least * per)) / per, (middle + 0.5 + max(above * spread, least * per)) / per
        for d in ids:
            x = score[d]
            near = x is not None and not base[d][5] and min(abs(x - low), abs(x - high)) < 0.01
            found[d] = x, None if near else not base[d][5] and (x is None or low <= x <= high)
    return found
