"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def windows(w, n):
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def cover(starts, n):
    return {j for i in starts for j in range(i, i + n)}


def repetition(text):
    w = words(text)
    found = windows(w, 8)
    again = Counter(found)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(cover([i for i, x in enumerate(found) if again[x] > 1], 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w)


def longest_repeats(w):
    return [max((k for j in range(len(w)) if j != i for k in [next((k for k in range(len(w)) if i + k >= len(w) or j + k >= len(w) or w[i + k] != w[j + k]), 0)]), default=0) for i in range(len(w))]


def phrases(rows):
    seen, out = set(), {}
    for i, text in sorted((r for r in rows), key=lambda r: r[0]):
        w, gone = words(text), set()
        for at, x in enumerate(windows(w, 20)):
            if x in seen:
                gone |= cover([at], 20)
            seen.add(x)
        out[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def components(sets, percent=75):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    both = Counter((a, b) for ids in by.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {i: find(i) for i in sets}


def shingles(text):
    w = words(lower(text))
    return set(windows(w, 5)) or ({tuple(w)} if w else set())


def decontaminate(rows, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    known = defaultdict(set)
    for i, text in items:
        w = fold(text)
        if w and i is not None:
            for x in windows(w, min(13, len(w))):
                known[x].add(str(i))
    out = {}
    for i, text in rows:
        w, hit, found = fold(text), set(), set()
        for n in {len(x) for x in known}:
            for at, x in enumerate(windows(w, n)):
                if x in known:
                    hit |= cover([at], n)
                    found |= known[x]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), 0 < len(hit) and 20 * len(hit) >= len(w))
    return out


def luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", luhn),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= sum(c.isdigit() for c in x) <= 15),
}


def pii(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in PII.items() for m in re.finditer(p, text or "") if ok(m[0])]


def secrets(text):
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "") if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found)]


def line_shingles(line, width=12):
    """The shingles that start at every position of a line, fewer characters at its end."""
    return {line.lower()[i : i + width] for i in range(len(line.lower()))}


def lines(rows, percent=75):
    found = [(i, n, x) for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]) for n, x in enumerate(t.split("\n")) if WORD.search(x)]
    ids = {x: k for k, x in enumerate(dict.fromkeys(x for _, _, x in found))}
    part = components({k: line_shingles(x) for x, k in ids.items()}, percent)
    seen, gone = set(), defaultdict(list)
    for i, n, x in found:
        if part[ids[x]] in seen:
            gone[i].append(n)
        seen.add(part[ids[x]])
    return gone


def targets(sizes, weights=(1, 2, 3), rounds=3):
    """By resharing the excess until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = sum(sizes.values()) - sum(rounds * sizes[s] for s in full)
        share = {s: rounds * sizes[s] if s in full else left * w[s] / max(1, sum(w[x] for x in names if x not in full)) for s in names}
        over = {s for s in names if s not in full and share[s] > rounds * sizes[s]}
        if not over:
            return share
        full |= over
