"""Plain versions of the operators for small inputs."""

import hashlib
import re
from collections import defaultdict

from xxhash import xxh64_intdigest


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def simhash(docs):
    prints = {}
    for i, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxh64_intdigest(x.encode(), 42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def contamination(docs, items):
    grams = defaultdict(set)
    for item, text in items.items():
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[k : k + n])].add(item)
    sizes, out = {len(g) for g in grams}, {}
    for i, text in docs.items():
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if g := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= g
        ids = ",".join(sorted(map(str, found)))
        out[i] = (len(w), len(hit), len(found), sha(ids.encode()), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def repeats(docs, length=400):
    """docs: a list of (id, text); returns a list of (id, n_bytes, n_removed, n_spans, kept_sha256)."""
    seen = defaultdict(int)
    for _, text in docs:
        b = (text or "").encode()
        for k in range(len(b) - length + 1):
            seen[hash(b[k : k + length])] += 1
    out = []
    for i, text in docs:
        b = (text or "").encode()
        keep = bytearray(b"\1" * len(b))
        for k in range(len(b) - length + 1):
            if seen[hash(b[k : k + length])] > 1:
                keep[k : k + length] = bytes(length)
        runs = len(re.findall(rb"\0+", bytes(keep)))
        out.append((i, len(b), keep.count(0), runs, sha(bytes(c for c, k in zip(b, keep) if k))))
    return out


def edited_texts(docs):
    order = sorted(docs, reverse=True)
    out = {}
    for i, following in zip(order, order[1:] + order[:1]):
        t, n = docs[i] or "", docs[following] or ""
        out[i] = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
    return out


def edits(docs):
    order, texts, out = sorted(docs, reverse=True), edited_texts(docs), {}
    for i, following in zip(order, order[1:] + order[:1]):
        out[i] = (len(docs[i] or ""), sha(texts[i].encode()), following)
    return out


def licences(text):
    w, found = words(text), []
    for label, phrase in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")):
        p = phrase.split()
        found += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    at = [k for k, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}


def near_pairs(docs, least=0.8):
    """Pairs of ids whose shingles of five words are similar by least or more; texts without words are in none."""
    sets = {i: shingles(t) for i, t in docs.items() if (t or "").split()}
    ids = sorted(sets)
    return [(a, b) for k, b in enumerate(ids) for a in ids[:k] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
