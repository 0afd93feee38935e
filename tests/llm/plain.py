"""Plain versions of the operators, to hold results against."""

import hashlib
import re
from collections import Counter, defaultdict


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normal(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            out.append((i, least, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    head = list(range(len(sets)))

    def top(k):
        while head[k] != k:
            k = head[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 75 * (len(sets[a][1]) + len(sets[b][1]) - both):
                head[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    out = [(i, len(s), least.get(top(k)), least.get(top(k)) == i) for k, (i, s) in enumerate(sets)]
    return sorted(out, key=repr)


def jump(key, shards):
    key, b, j = (key or 0) % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def repeats(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)
