"""Plain definitions that the operators are held against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def repeated_words(w, size=8):
    at = defaultdict(list)
    for i in range(len(w) - size + 1):
        at[tuple(w[i : i + size])].append(i)
    return len({j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + size)})


def statistics(text):
    text = text or ""
    w, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, repeated_words(w)


def exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id))
    out = {}
    for body, members in groups.items():
        keep = min(members)[1]
        for _, doc_id in members:
            out[doc_id] = (keep, len(members), doc_id == keep, hashlib.sha256(body.encode()).hexdigest())
    return out


def shingle_set(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def near(rows):
    """doc_id -> (set size, component)."""
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, shared = defaultdict(list), Counter()
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    for members in holders.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def substrings(rows, size=13):
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < d for j in range(i, i + size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def packed(rows, tokenizer, result, capacity=2048):
    """Check every piece of a packing against the tokenizer itself; gives the number of sequences."""
    want = {}
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[d, k] = (at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in result} == want
    bins = defaultdict(list)
    for r in result:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(v[1] for v in want.values())
