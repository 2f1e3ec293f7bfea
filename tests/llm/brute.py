"""Plain-Python versions of the operators' contracts, quadratic where that is simplest."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda b: hashlib.sha256(b).hexdigest()


def words(text):
    return WORD.findall(text or "")


def near_classes(rows, threshold=0.8):
    """{doc_id: smallest id of its class} by comparing all pairs."""
    bags = {}
    for i, t in rows:
        w = words(t)
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    texts = {i: t or "" for i, t in rows}
    top = {i: i for i in bags}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    where = {}
    for i, bag in bags.items():
        for s in bag:
            where.setdefault(s, []).append(i)
    seen = set()
    for group in where.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    common = sum((bags[a] & bags[b]).values())
                    if common >= threshold * (sum(bags[a].values()) + sum(bags[b].values()) - common):
                        x, y = sorted((find(a), find(b)))
                        top[y] = x
    first = {}
    for i in sorted(texts):
        j = first.setdefault(texts[i], i)
        x, y = sorted((find(i), find(j)))
        top[y] = x
    return {i: find(i) for i in bags}


def substring_cut(rows, n=13):
    """{doc_id: (n_words, removed, kept words)}"""
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            s = tuple(w[k : k + n])
            least[s] = min(least.get(s, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if least[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out[i] = len(w), len(gone), [x for k, x in enumerate(w) if k not in gone]
    return out


def tokens(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def id_bytes(ids):
    return b"".join(int(x).to_bytes(4, "little") for x in ids)


def check_packing(rows, tokenizer, texts, limit=4096, end=1):
    """rows: dicts of the packing query's columns; raises if a piece is missing, wrong or misplaced. Number of sequences."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], {})[r["piece"]] = r
    assert sorted(by_doc) == sorted(texts)
    for i, t in texts.items():
        ids = [*tokens(tokenizer, t), end]
        cut = [ids[k : k + limit] for k in range(0, len(ids), limit)]
        assert sorted(by_doc[i]) == list(range(len(cut)))
        for k, part in enumerate(cut):
            r = by_doc[i][k]
            assert (r["start"], r["length"], r["ids_crc32"]) == (k * limit, len(part), zlib.crc32(id_bytes(part)))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)
