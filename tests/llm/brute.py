"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(line):
    return set(WORD.findall(lower(line)))


def duplicate_lines(docs, percent=80):
    """{(doc_id, line_no)} to remove, of (doc_id, text)."""
    seen, out = [], set()
    for d, text in sorted(docs):
        for n, line in enumerate((text or "").split("\n")):
            s = words(line)
            if not s:
                continue
            if any(100 * len(s & o) >= percent * len(s | o) for o in seen):
                out.add((d, n))
            seen.append(s)
    return out


def groups(ids, prints, radius):
    """doc_id -> smallest id of its component under Hamming distance."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if int(np.bitwise_count(prints[a] ^ prints[b]).sum()) <= radius:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: find(i) for i in ids}


def normal(text):
    return re.sub(r"[^A-Za-z0-9\x80-\U0010ffff]+", " ", text.lower()).strip(" ").encode()


def best_edits(item, text):
    """Fewest edits of ``item`` against any substring of ``text``, both bytes."""
    d = np.frombuffer(text, np.uint8)
    row = np.zeros(len(d) + 1, np.int64)
    for i, c in enumerate(item):
        cand = np.concatenate([[i + 1], np.minimum(row[:-1] + (d != c), row[1:] + 1)])
        k = np.arange(len(cand))
        row = np.minimum.accumulate(cand - k) + k
    return int(row.min())


def budget(item, rate=0.1):
    return int(rate * len(item))


def contamination(docs, items):
    out = set()
    for d, text in docs:
        t = normal(text or "")
        for i, item in items:
            m = normal(item or "")
            if len(m) >= 8 and len(t) and (e := best_edits(m, t)) <= budget(m):
                out.add((d, i, e))
    return out


def chains(match, max_gap):
    """As licenses.chain(), looking at every pair of matches."""
    match = sorted(set(match))
    best = []
    for i, (x, y, n) in enumerate(match):
        score, back = n, -1
        for j in reversed(range(i)):
            a, b, m = match[j]
            over = max(0, a + m - x, b + m - y)
            if a < x and b < y and x - (a + m) <= max_gap and over < n and best[j][0] + n - over > score:
                score, back = best[j][0] + n - over, j
        best.append((score, back))
    out, used = [], set()
    for i in sorted(range(len(match)), key=lambda i: (-best[i][0], i)):
        path, j = [], i
        while j != -1 and j not in used:
            path.append(j)
            j = best[j][1]
        if path and j == -1:
            used |= set(path)
            out.append((match[path[-1]][0], match[i][0] + match[i][2] - 1, best[i][0]))
    return out


def license_spans(text, templates, min_match=3, min_cover=0.8, max_gap=12):
    """{(license, covered words, template words, first byte, end byte)} of one text."""
    at = [(m.start(), m.end(), lower(m[0])) for m in WORD.finditer(text)]
    size = lambda k: len(text[:k].encode())
    seq = [w for _, _, w in at]
    plain = [(name, [lower(w) for w in WORD.findall(t)]) for name, t in templates]
    longest = []
    for i in range(len(seq)):
        n = 0
        while n <= i and any(seq[i - n : i + 1] == t[k : k + n + 1] for _, t in plain for k in range(len(t))):
            n += 1
        longest.append(n)
    found = {}
    for name, t in plain:
        match = []
        for i, n in enumerate(longest):
            if n >= min_match and (i + 1 == len(seq) or longest[i + 1] != n + 1):
                match += [(i - n + 1, k, n) for k in range(len(t)) if t[k : k + n] == seq[i - n + 1 : i + 1]]
        if sum(n for _, _, n in match) >= min_cover * len(t):
            found.setdefault(name, []).extend((-c, x, y, len(t)) for x, y, c in chains(match, max_gap) if c >= min_cover * len(t))
    out = set()
    for name, spans in found.items():
        taken = []
        for c, x, y, whole in sorted(spans):
            if all(y < p or x > q for p, q in taken):
                taken.append((x, y))
                out.add((name, -c, whole, size(at[x][0]), size(at[y][1])))
    return out


ORDER, SEGMENT = 4, 64


def _grown(texts):
    """Context tree of lower-cased texts: context -> following byte -> count."""
    tree = {}
    for t in texts:
        b = b"\n" * ORDER + t.lower().encode()
        for i in range(ORDER, len(b)):
            for k in range(ORDER + 1):
                follow = tree.setdefault(b[i - k : i], {})
                follow[b[i]] = follow.get(b[i], 0) + 1
    return tree


def _costs(tree, text):
    """Bits of each byte."""
    b, out = b"\n" * ORDER + text.lower().encode(), []
    for i in range(ORDER, len(b)):
        bits = 0.0
        for k in range(ORDER, -1, -1):
            follow = tree.get(b[i - k : i])
            if follow:
                n, d = sum(follow.values()), len(follow)
                if b[i] in follow:
                    bits -= np.log2(follow[b[i]] / (n + d))
                    break
                bits -= np.log2(d / (n + d))
        else:
            bits += 8
        out.append(bits)
    return np.array(out)


def languages(rows, held):
    """{doc_id: (language, bits a byte, accepted)} of (doc_id, lang, text); ids in ``held`` set the limits."""
    langs = sorted({lang for _, lang, _ in rows})
    trees = [_grown([t for d, lang, t in rows if lang == x and d not in held]) for x in langs]
    took, limits = {}, []
    for d, _, t in rows:
        b = np.frombuffer(t.lower().encode(), np.uint8)
        letter = (b >= 128) | ((b >= 97) & (b <= 122))
        costs = np.stack([_costs(tree, t) for tree in trees])
        parts = sum((costs[:, i : i + SEGMENT] * letter[i : i + SEGMENT]).sum(axis=1).min() for i in range(0, len(b), SEGMENT))
        took[d] = costs.sum(axis=1), parts, int(letter.sum()), len(b)
    for x in langs:
        own = [took[d][1] / took[d][2] for d, lang, _ in rows if lang == x and d in held and took[d][2]]
        limits.append(np.quantile(own, 0.99) + 1.5 if len(own) >= 8 else 8.0)
    out = {}
    for d, (whole, parts, letters, size) in took.items():
        best = int(whole.argmin())
        out[d] = (langs[best], whole[best] / size, bool(parts <= limits[best] * letters + 256)) if size else (None, None, False)
    return out
