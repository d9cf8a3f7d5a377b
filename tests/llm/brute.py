"""Plain versions of the operators, one row at a time."""

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, size):
    w = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in (text or "").encode().split()]
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def near_duplicates(rows, size, percent):
    """rows: (doc_id, text).  Components by id, sets by row."""
    sets = [shingles(t, size) for _, t in rows]
    holders, overlap = defaultdict(list), Counter()
    for n, (i, _) in enumerate(rows):
        if i is not None:
            for s in sets[n]:
                for m in holders[s]:
                    overlap[m, n] += 1
                holders[s].append(n)
    links = [(rows[a][0], rows[b][0]) for (a, b), c in overlap.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    return components({i for i, _ in rows if i is not None}, links), [len(s) for s in sets]


def passages(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def close_vectors(vectors, least):
    """Number of links of each vector, and the linked pairs."""
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for v in vectors]
    x = [np.array(v, float) if k else None for v, k in zip(vectors, ok)]
    x = [None if v is None else v / np.abs(v).max() for v in x]
    degree, pairs = [0] * len(x), []
    for a in range(len(x)):
        for b in range(a):
            if ok[a] and ok[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= least - (1e-12 if np.array_equal(x[a], x[b]) else 0):
                degree[a] += 1
                degree[b] += 1
                pairs.append((a, b))
    return degree, pairs


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text):
    """Base spans (start, kind, end)."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def window_entropy(text, window):
    """Shannon entropy of every window, counted anew."""
    out = []
    for k in range(len(text) - window + 1):
        p = np.array(list(Counter(text[k : k + window]).values())) / window
        out.append(float(-(p * np.log2(p)).sum()))
    return out


def token_pieces(rows, vocabulary, capacity, end_id):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    out = Counter()
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, end_id], dtype="<u4")
        first = len(ids) % capacity or min(len(ids), capacity)
        at = [0, *range(first, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(at, at[1:])):
            out[i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    return out


def repaired(turns):
    """turns of one conversation in order: (role, text).  Cheapest edits by trying all, least in ASCII."""
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    seen, faults = set(), []
    for role, text in turns:
        bare = text.rstrip(space)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {}  # (turns done, state): (cost, audit, roles and texts)
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    todo = [(0, "", 0, "", ())]
    while todo:
        cost, audit, t, state, out = heapq.heappop(todo)
        if (t, state) in best:
            continue
        best[t, state] = True
        if t == len(turns) and state in ("", "a"):
            return faults, cost, audit, out
        for to in ("u", "a"):
            if follow[state].get(to):
                heapq.heappush(todo, (cost + 3, audit + "I", t, to, (*out, ({"u": "user", "a": "assistant"}[to], ""))))
        if t < len(turns):
            role, text = turns[t]
            heapq.heappush(todo, (cost + 4, audit + "D", t + 1, state, out))
            if faults[t] in ("", "truncated"):
                more = 3 * (faults[t] == "truncated")
                if role[:1] and follow[state].get(role[0]):
                    heapq.heappush(todo, (cost + more, audit + "K", t + 1, role[0], (*out, (role, text))))
                for to in ("u", "a"):
                    if follow[state].get(to):
                        heapq.heappush(todo, (cost + more + 3, audit + "R", t + 1, to, (*out, ({"u": "user", "a": "assistant"}[to], text))))


def shards(rows, shards, grain):
    """rows: (key, size), any order.  The shard of each key."""
    total = sum(n for _, n in rows)
    groups = defaultdict(list)
    for key, n in sorted(rows):
        groups[key[:32]].append((key, n))
    units = []
    for g, members in groups.items():
        if sum(n for _, n in members) * 4 * shards > total:
            units += [(key, n, [key]) for key, n in members]
        else:
            units.append((g, sum(n for _, n in members), [key for key, _ in members]))
    loads, place = [0] * shards, {}
    for key, n, members in sorted(units, key=lambda u: (-u[1], u[0])):
        if n * shards * grain > total:
            s = loads.index(min(loads))
            loads[s] += n
            place |= dict.fromkeys(members, s)
    rest = [u for u in sorted(units) if u[1] * shards * grain <= total]
    level = max(x for x in range(total + 1) if sum(max(0, x - load) for load in loads) <= sum(n for _, n, _ in rest))
    borders = np.cumsum([max(0, level - load) for load in loads])[:-1]
    before = 0
    for _, n, members in rest:
        place |= dict.fromkeys(members, int((2 * before + n >= 2 * borders).sum()))
        before += n
    return place


def hard_negatives(rows):
    """rows: (vec_id, vector, label), usable ones."""
    scaled = [(i, np.floor(256 * np.array(v, np.float64)), (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in rows]
    late = lambda i: float("inf") if i is None else i
    out = []
    for a, (anchor, q, own) in enumerate(scaled):
        if anchor is None or anchor % 100:
            continue
        all_scores = [(int(x @ q), i, label) for b, (i, x, label) in enumerate(scaled) if b != a and len(x) == len(q)]
        for p, positive, _ in sorted((r for r in all_scores if r[2] == own), key=lambda r: (-r[0], late(r[1])))[:5]:
            found = sorted((r for r in all_scores if r[2] != own and 30 * p <= 100 * r[0] <= 90 * p), key=lambda r: (-r[0], late(r[1])))[:10]
            out += [(anchor, positive, k, i, p, n) for k, (n, i, _) in enumerate(found, 1)]
    return sorted(out, key=str)
