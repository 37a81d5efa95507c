"""Plain versions of the contracts, on lists of (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WS = re.compile(r"[\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def words(t):
    return [w for w in WS.split(t or "") if w]


def secrets(docs):
    kinds = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    ]
    out = {}
    for d, t in docs:
        spans = [(m.start(), i, m.end()) for i, (_, p, f, ok) in enumerate(kinds) for m in re.finditer(p, t or "", f) if ok(m)]
        text = ",".join(f"{kinds[i][0]}:{s}:{e}" for s, i, e in sorted(spans))
        out[d] = (*[sum(x[1] == i for x in spans) for i in range(3)], sha(text), text)
    return out


def classes(rows, example_owners=5, least_bits=3.0, example_repos=1000):
    """doc_id to its spans (start, kind, end, class), from (doc_id, text, owner) rows."""
    found, owners, repos = {}, defaultdict(set), defaultdict(set)
    for d, t, o in rows:
        t = t or ""
        base = [(m.start(), 0, m.end(), m[2]) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        taken = {i for s, _, e, _ in base for i in range(s, e)}
        wide = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_-]+", t) if len(m[0]) >= 20 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not taken & set(range(m.start(), m.end()))]
        found[d] = sorted(base + wide)
        for x in found[d]:
            owners[x[3]].add(o or "")
            repos[x[3]].add(d)

    def random_looking(v):
        bits = -sum(v.count(c) / len(v) * math.log2(v.count(c) / len(v)) for c in set(v))
        return len(v) >= 12 and bool(re.search("[0-9]", v)) and bool(re.search("[A-Za-z]", v)) and bits >= least_bits

    out = {}
    for d, xs in found.items():
        out[d] = []
        for s, k, e, v in xs:
            n, live = len(owners[v]), random_looking(v)
            c = "example" if n >= example_owners or len(repos[v]) >= example_repos else "live" if n == 1 and live else "shared"
            if k < 3 or (live and c != "example"):
                out[d].append((s, k, e, c))
    return out


def masked(text, spans, mark="<SECRET>"):
    """Spans that are no examples, overlapping ones as one, replaced."""
    hide, at, out = sorted((s, e) for s, _, e, c in spans if c != "example"), 0, ""
    while hide:
        s, e = hide.pop(0)
        while hide and hide[0][0] < e:
            e = max(e, hide.pop(0)[1])
        out, at = out + text[at:s] + mark, e
    return out + text[at:]


def exact(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[WS.sub("", t or "")].append((-len(t or ""), d))
    return {d: (min(g)[1], len(g), d == min(g)[1], sha(n)) for n, g in groups.items() for _, d in g}


def lines(docs):
    key = lambda l: l.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = defaultdict(set)
    for d, t in docs:
        for l in (t or "").split("\n"):
            if len(key(l)) >= 10:
                holders[key(l)].add(d)
    out = {}
    for d, t in docs:
        ls = (t or "").split("\n")
        keep = [l for l in ls if not (len(holders.get(key(l), ())) >= 2 and min(holders[key(l)]) != d)]
        out[d] = (len(ls), len(ls) - len(keep), sha("\n".join(keep)))
    return out


def passages(docs, n=13):
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - n + 1):
            p = tuple(w[i : i + n])
            first[p] = min(first.get(p, d), d)
    out = {}
    for d, t in docs:
        w = words(t)
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d for j in range(i, i + n)}
        out[d] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def near(docs, k=3, num=85, den=100):
    sets = {}
    for d, t in docs:
        w = words((t or "").translate(LOW))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inverted[x].append(d)
    for d, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for e in inverted[x]:
                if e < d:
                    both[e] += 1
        for e, n in both.items():
            if den * n >= num * (len(s) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=20):
    """(item_id, rank, doc_id, score) of (doc_id, text) and (item_id, text) rows."""
    counts = [(d, Counter(TERM.findall((t or "").translate(LOW)))) for d, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in set(items):
        asked, hits = Counter(TERM.findall((text or "").translate(LOW))), []
        for d, c in counts:
            m = 100 - 25 + 25 * c.total() * n // max(1, total)
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, times in asked.items() if w in c)
            if score > 0:
                hits.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(hits)[:k])]
    return sorted(out)
