"""Brute-force versions of the operators and the cases that every operator must bear."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def base_quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen3 = Counter(zip(w, w[1:], w[2:]))
    covered, lines, dup = set(), set(), 0
    for i in range(len(w) - 2):
        if seen3[tuple(w[i:i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def unigram(rows):
    """doc_id, tokens, known, train tokens and base score."""
    tokens = [words(t) + [None] for _, t in rows]
    count = Counter(w for (d, _), ws in zip(rows, tokens) if fold(d, 10) for w in ws)
    n, v = sum(count.values()), len(count)
    return [(d, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (d, _), ws in zip(rows, tokens)]


def suffixes(rows, length=100):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def n_digits(m):
    return len(re.sub("[^0-9]", "", m))


PII = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
       ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= n_digits(m) <= 19 and luhn(re.sub("[^0-9]", "", m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= n_digits(m) <= 15))


def personal(text):
    """Counts by kind and the spelled base spans."""
    found, counts = [], []
    for k, (_, regex, ok) in enumerate(PII):
        hits = [(m.start(), k, m.end()) for m in re.finditer(regex, text or "") if ok(m.group())]
        counts.append(len(hits))
        found += hits
    return (*counts, ",".join(f"{PII[k][0]}:{a}:{b}" for a, k, b in sorted(found)))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def jaccard_groups(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))
