"""Plain versions of the operators, a document or pair at a time."""

import hashlib
import math
import re
from collections import Counter, defaultdict


def quality(model, text, window=1000):
    """The score of a text by a fitted model: every window compressed with either dictionary."""
    import zstandard

    sizes = []
    for raw in (model.good, model.bad):
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(packer.compress(text[i : i + window].encode())) for i in range(0, len(text), window)))
    good, bad = sizes
    x = (bad - good) / max(1, bad + good)
    return 1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * (x - model.mean[0]) / model.scale[0])))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def passed_rules(docs, min_docs=10, percent=5, most=0.7):
    """{doc_id: text without common lines} of the [(doc_id, text, host)] that pass."""
    def norm(line):
        return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")

    has, of_host, out = defaultdict(set), defaultdict(set), {}
    for doc, text, host in docs:
        of_host[host].add(doc)
        for line in text.split("\n"):
            if words_of(line):
                has[host, norm(line)].add(doc)
    for doc, text, host in docs:
        words, rest, gone = words_of(text), [], 0
        threes = Counter(zip(words, words[1:], words[2:]))
        again = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if threes[t] > 1 for k in range(3)}
        for line in text.split("\n"):
            own = has.get((host, norm(line)), set()) if words_of(line) else set()
            if len(own) > min_docs and 100 * len(own) > percent * len(of_host[host]) and min(own) != doc:
                gone += len(words_of(line))
            else:
                rest.append(line)
        if len(words) >= 50 and 2 * len(again) <= len(words) and gone <= most * len(words):
            out[doc] = "\n".join(rest)
    return out


def similar_lines(docs):
    """{doc_id: places of removed lines} of [(doc_id, text)] with different ids: a line goes if an earlier one has Jaccard 0.8."""
    seen, out = [], {}
    for doc, text in sorted(docs):
        gone = []
        for k, line in enumerate((text or "").encode().split(b"\n")):
            s = frozenset(line.split())
            if not s:
                continue
            if any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
                gone.append(k)
            seen.append(s)
        out[doc] = gone
    return out


def shingles(text, n=5):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def near_classes(docs, threshold=0.8, margin=0.0):
    """{doc_id: smallest id of its class} by all pairs that share a shingle: weighted Jaccard, exact df."""
    sets = {d: shingles(t) for d, t in docs}
    df = Counter(s for c in sets.values() for s in c)
    n = len(docs)
    floor = max(1, sum(df.values()) / 2**20)
    idf = {s: 1 + math.log(n / max(k, floor)) / (4 * math.log(n / floor)) if n > floor else 1 for s, k in df.items()}
    w = {d: {s: (1 + math.log(k)) * idf[s] for s, k in c.items()} for d, c in sets.items()}
    by = defaultdict(list)
    for d, c in sets.items():
        for s in c:
            by[s].append(d)
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    pairs, border = set(), set()
    for ds in by.values():
        pairs.update((a, b) for i, a in enumerate(ds) for b in ds[i + 1 :])
    for a, b in pairs:
        low = sum(min(v, w[b][s]) for s, v in w[a].items() if s in w[b])
        weighted = low / (sum(w[a].values()) + sum(w[b].values()) - low)
        if abs(weighted - threshold) < margin:
            border.add((a, b))
        if weighted >= threshold:
            join(a, b)
    same = {}
    for d, t in docs:
        if not sets[d] and (t or "") in same:
            join(d, same[t or ""])
        same.setdefault(t or "", d)
    return {d: find(d) for d, _ in docs}, border


def nearest(vectors, queries, k=5):
    """{query: [(score, id)]} by exact cosine over all vectors but the query's own. vectors: {id: list of floats}."""
    import numpy as np

    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=float)
    norms = np.linalg.norm(x, axis=1)
    out = {}
    for q in queries:
        v = np.array(vectors[q], dtype=float)
        s = (x * v).sum(axis=1) / (norms * np.linalg.norm(v))
        out[q] = sorted(((-float(a), i) for a, i in zip(s, ids) if i != q))[:k]
    return out


def conversation_digests(rows):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)} of (conv_id, turn, role, text) rows."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        whole = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode())
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out
