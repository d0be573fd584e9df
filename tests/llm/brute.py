"""What the operators must give, in plain Python."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOW) if lower else text or "")


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicates(docs):
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    linked = Counter(x for pair in links for x in pair)
    return components(sets, links), {i: len(s) for i, s in sets.items()}, {i: linked[i] for i in sets}


def passages(docs, size=50, lower=True):
    """Words that go, per document."""
    own, text = {}, {}
    for i, t in sorted(docs):
        text[i] = words(t, lower)
        for j in range(len(text[i]) - size + 1):
            own.setdefault(tuple(text[i][j : j + size]), (i, j))
    out = {}
    for i, w in text.items():
        gone = set()
        for j in range(len(w) - size + 1):
            o = own[tuple(w[j : j + size])]
            if o != (i, j):
                gone |= set(range(max(j, o[1] + size) if o[0] == i else j, j + size))
        out[i] = gone
    return out


def rule_features(text):
    w = words(text, lower=False)
    grams = list(zip(w, w[1:], w[2:]))
    often = Counter(grams)
    spots = {i + d for i, g in enumerate(grams) if often[g] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(spots)


def boilerplate(docs, sites=8, least=4):
    """Text that is left, per document (id, text, source)."""
    seen = defaultdict(set)
    bare = lambda x: x.strip(" \t\n\r\x0b\x0c")
    for _, t, s in docs:
        for x in (t or "").split("\n"):
            if len(words(x)) >= least:
                seen[bare(x)].add(s or "")
    gone = {x for x, s in seen.items() if len(s) >= sites}
    out = {}
    for i, t, _ in docs:
        lines = (t or "").split("\n")
        cut = [bare(x) in gone for x in lines]
        n = sum(len(words(x)) for x, c in zip(lines, cut) if c)
        out[i] = t if not n or n == len(words(t)) else "\n".join(x for x, c in zip(lines, cut) if not c)
    return out
