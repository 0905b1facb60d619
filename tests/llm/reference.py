"""Brute-force versions of the corpus operators, and documents with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind int, start string, n long, id long, score string"


def odd_documents(spark, seed=1):
    """Nulls in every column, empty, blank, very long, equal, near-equal and repeated rows, ties, and columns with clashing names."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "dé", "x1", "日本", "mail", "+1", "the", "of"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "other"
    texts = [None, "", "  \n\t", "one", base, base, " ".join(near), base + " tail", text(5000), "the the the " * 400, text(3), text(4), "a b c\x0bd",
             base[:450] + text(40), text(40) + base[-450:], "\u0001 \u0000", "<|endoftext|> and <|endoftext|>"] + [text(rng.randint(1, 90)) for _ in range(20)]
    sources = ["s1", "s2", None, "ä", ""]
    rows = [(i * 10, t, "en", sources[i % 5], len(t or ""), i, "x", i, i, "s") for i, t in enumerate(texts)]
    rows += [(40, base, None, None, None, None, None, None, None, None)] * 2 + [rows[6]] + [(None, text(30), None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, size):
    words = [w.translate(LOWER) for w in WORD.findall(text or "")]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def jaccard_components(rows, size, percent):
    """(n_shingles, smallest reachable key) by key of (key, text) rows."""
    sets = {k: shingles(t, size) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (len(sets[k]), find(k)) for k in keys}


def without_repeats(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def edit_distance_inside(pattern, text):
    """(distance, leftmost end) of the best approximate occurrence."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row), row.index(min(row))


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def valid(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if valid(k, m.group(0))]


def water_filled(sizes, weights, share, repeats):
    """Targets by source of {source: size}: excess over the limit is reshared by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        rest = left - sum(repeats * sizes[s] for s in full)
        target = {s: repeats * sizes[s] if s in full else rest * weight[s] / sum(weight[o] for o in open_) for s in names}
        over = {s for s in open_ if target[s] > repeats * sizes[s]}
        if not over:
            return target
        full |= over


def totals(pairs):
    out = defaultdict(int)
    for k, v in pairs:
        out[k] += v
    return dict(out)
