"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def quality(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if words(x)]
    n = len(w)
    return (
        n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
        len(covered), n < 50 or 100 * len(covered) > 50 * n,
    )


def components(docs, k, percent):
    """{(doc_id, text): (n_shingles, component)}, by all pairs."""
    lower = {}
    for doc_id, text in docs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(w) >= k:
            s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        else:
            s = {tuple(w)} if w else set()
        lower[(doc_id, text or "")] = s
    keys = list(lower)
    root = {key: key for key in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if lower[a] and 100 * len(lower[a] & lower[b]) >= percent * len(lower[a] | lower[b]):
                root[find(a)] = find(b)
    least = {}
    rank = lambda d: -(2**63) if d is None else d
    for key in keys:
        r = find(key)
        least[r] = min(least.get(r, key[0]), key[0], key=rank)
    return {key: (len(lower[key]), least[find(key)]) for key in keys}


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    out = []
    for place, (kind, expression) in enumerate(PII.items()):
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x.lstrip("0")[:4] or 0) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), place, m.end(), kind))
    out.sort()
    return [f"{kind}:{start}:{end}" for start, _, end, kind in out]


def bare(word):
    return re.sub(r"^[\W_]+", "", word.lower()) or word.lower()


def label_after(found, i):
    """The last word before the ``i``-th without a digit or @, and the number of words since."""
    k = 0
    while k < i and re.search("[0-9@]", found[i - 1 - k][0]):
        k += 1
    return (bare(found[i - 1 - k][0]), k) if k < i else None


def patterns(found, i):
    """The word before the ``i``-th of a text; after instances, also their label and number."""
    label = label_after(found, i)
    out = [bare(found[i - 1][0])] if i else []
    return out + [label] if label and label[1] else out


def contexts(docs, least=3, confident=0.5, accepted=0.7):
    """{(doc_id, start, end)} of context spans: the bootstrap over all words, to its fixed point."""
    total, pairs, seeds, inner, spots = Counter(), Counter(), set(), set(), []
    for doc_id, text in docs:
        base = [tuple(map(int, s.split(":")[1:])) for s in pii(text)]
        found = list(WORD.finditer(text or ""))
        total.update(bare(m[0]) for m in found)
        total.update(patterns([*found, "?"], i + 1)[-1] for i, m in enumerate(found) if (
            re.search("[0-9@]", m[0]) and label_after([*found, "?"], i + 1)
        ))
        for i, m in enumerate(found):
            value = re.sub(r"^[\W_]+|[\W_]+$", "", m[0].lower())
            if not value or not re.search("[0-9@]", m[0]):
                continue
            under = [a for a, b in base if a < m.end() and b > m.start()]
            covered, begins = bool(under), any(a >= m.start() for a in under)
            seeds |= {value} if begins else set()
            start = m.start() + len(re.match(r"[\W_]*", m[0])[0])
            for p in patterns(found, i):
                pairs[p, value] += 1
                inner |= {(p, value)} if covered and not begins else set()
                spots.append((doc_id, start, start + len(value), p, value, covered))
    score, sure = {v: float(v in seeds) for _, v in pairs}, {}
    while True:
        hits, values, odds = Counter(), Counter(), defaultdict(lambda: 1.0)
        for (p, v), n in pairs.items():
            mark = 1.0 if (p, v) in inner else score[v]
            if mark >= accepted:
                hits[p] += n * mark
                values[p] += 1
        sure = {
            p: min(hits[p] / total[p], 1 - 1e-9)
            for p in hits if values[p] >= least and hits[p] / total[p] >= confident
        }
        for p, v in pairs:
            odds[v] *= 1 - sure.get(p, 0.0)
        after = {v: 1.0 if v in seeds else 1 - odds[v] for v in score}
        if all(after[v] - score[v] < 1e-12 for v in score):
            break
        score = after
    return {
        (i, start, end) for i, start, end, p, v, covered in spots
        if not covered and p in sure and ((p, v) in inner or score[v] >= accepted)
    }


def word_repeats(docs, width=20):
    """[(doc_id, text, n_words, n_removed, sha)]; docs of one id are one document."""
    rank = lambda d: -(2**63) if d is None else d
    first = {}
    for doc_id, text in docs:
        w = words(text)
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            first[g] = min(first.get(g, (rank(doc_id), i)), (rank(doc_id), i))
    out = []
    for doc_id, text in docs:
        w, gone = words(text), set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (rank(doc_id), i):
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), sha(kept)))
    return out


def byte_repeats(docs, width=400):
    rank = lambda d: -(2**63) if d is None else d
    places = {}
    for doc_id, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - width + 1):
            places.setdefault(hashlib.md5(raw[i : i + width]).digest(), set()).add((rank(doc_id), i))
    out = []
    for doc_id, text in docs:
        raw = (text or "").encode()
        spans = []
        for i in range(len(raw) - width + 1):
            if len(places[hashlib.md5(raw[i : i + width]).digest()]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + width
                else:
                    spans.append([i, i + width])
        kept, at = b"", 0
        for start, end in spans:
            kept, at = kept + raw[at:start], end
        kept += raw[at:]
        out.append((doc_id, len(raw), len(raw) - len(kept), len(spans), sha(kept)))
    return out


def edit_distance(pattern, text):
    """The least edits between ``pattern`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        before, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (c != d)))
    return min(row)


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """{source: target} by sharing, capping and sharing the excess again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        rest = total - sum(held.values())
        shares = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if shares[s] > most * sizes[s]]
        if not over:
            return held | shares
        held |= {s: most * sizes[s] for s in over}
