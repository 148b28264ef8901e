"""Plain-Python definitions of the operators' results, for comparison."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring(rows):
    """rows: (doc_id, text) -> {doc_id: (n_words, n_removed, sha)}"""
    least = {}
    split = [(i, words(t)) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 49):
            key = tuple(w[k:k + 50])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if least[tuple(w[k:k + 50])] < i:
                gone[k:k + 50] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


def quality(text):
    """Base figures of one text."""
    w = words(text)
    n = len(w)
    seen = Counter(tuple(w[i:i + 8]) for i in range(n - 7))
    cover = np.zeros(n, bool)
    for i in range(n - 7):
        if seen[tuple(w[i:i + 8])] >= 2:
            cover[i:i + 8] = True
    lines = [x for x in (text or "").split("\n") if words(x)]
    rep = int(cover.sum())
    return (n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep,
            n < 20 or 100 * rep > 30 * n)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)}


def jaccard(rows):
    """rows: (doc_id, text) -> {doc_id: (n_shingles, component_id)}; all pairs through an inverted index."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    post = defaultdict(list)
    for i in sorted(sets):
        shared = Counter()
        for s in sets[i]:
            shared.update(post[s])
            post[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 90 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """Base spans of one text, (kind, start, end), by start, then kind as listed."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(out)]


def tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    if not hasattr(tokens, "t"):
        tokens.t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.t.encode(text or "", add_special_tokens=False).ids + [2]


def pieces(rows):
    """(doc_id, piece, start, length, crc) of all documents, sorted."""
    out = []
    for i, t in rows:
        ids = tokens(t)
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) % 1024 or 1024) if at == 0 else 1024
            out.append((i, k, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())))
            at, k = at + n, k + 1
    return sorted(out)


def top_products(vectors, every=100, k=10):
    """vectors: {vec_id: int list} -> sorted (query, rank, id, score)."""
    out = []
    for q, x in vectors.items():
        if q % every:
            continue
        score = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score)]
    return sorted(out)
