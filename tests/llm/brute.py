"""Plain versions of the operators' rules, for small inputs."""

import collections
import hashlib
import re
import zlib

import numpy as np

SPACE = b" \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def kept_lines(rows):
    """doc_id -> (lines, kept text)."""
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, t in rows.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    out = {}
    for i, t in rows.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out[i] = (lines, stay)
    return out


def shingles(t, n):
    w = [lower(x) for x in WORD.findall(t or "")]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard(rows, n, percent):
    """doc_id -> (set size, component)."""
    sets = {i: shingles(t, n) for i, t in rows.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def suffix_kept(rows, window=50):
    """doc_id -> (bytes, removed, spans, kept bytes)."""
    texts = {i: (t or "").encode() for i, t in rows.items()}
    owner = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - window + 1):
            owner.setdefault(texts[i][k : k + window], i)
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if owner[t[k : k + window]] < i:
                gone[k : k + window] = b"\1" * window
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone) if not g))
    return out


def quality(t):
    """The base counts of one text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = collections.Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def check_packing(rows, packed, tokenizer, capacity=1024, end=2):
    """packed (pandas) holds each document's ids once, cut and placed as agreed; gives the sequences and their least number."""
    for doc, g in packed.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(rows[doc] or "", add_special_tokens=False).ids, end], "<u4")
        g = g.sort_values("piece")
        assert list(g.piece) == list(range(len(g)))
        assert list(g.start) == list(np.cumsum([0, *g.length])[:-1]) and g.length.sum() == len(ids)
        assert all(g.length.iloc[1:] == capacity) and g.length.max() <= capacity
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(g.start, g.length)] == list(g.ids_crc32)
    assert set(packed.doc_id) == set(rows)
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == list(np.cumsum([0, *g.length])[:-1]) and g.length.sum() <= capacity
    return packed.sequence_id.nunique(), -(-int(packed.length.sum()) // capacity)
