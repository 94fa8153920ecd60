"""Plain versions of the operators' contracts, for small tables: no hashing, no vectors, no Spark."""

import hashlib
import re
from collections import Counter


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def spaced(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def alnum(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def decontaminated(docs, items):
    windows = {}
    for item, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = alnum(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (t := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[t]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def stats(text):
    text = text or ""
    w = spaced(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if spaced(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def shingles(text):
    w = spaced(lower(text))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())


def components(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return [(d, len(s), find(d)) for d, s in sets]


def repeats(docs, n=100):
    first, out = set(), []
    for doc, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            s = raw[i : i + n]
            if s in first:
                gone[i : i + n] = b"\1" * n
            first.add(s)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), spans, sha(kept)))
    return out


def kept(docs):
    """docs (doc_id, text), each row by itself -> (doc_id, keep_id, group size, kept, digest)."""
    groups = {}
    for i, (doc, text) in enumerate(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, i))
    out = [None] * len(docs)
    for key, rows in groups.items():
        best = min(rows)
        for row in rows:
            out[row[3]] = (docs[row[3]][0], docs[best[3]][0], len(rows), row == best, sha(key))
    return out


def infilled(doc, text, seed=1, percent=90, spm_percent=20):
    text, h = text or "", sha(f"{seed}:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < spm_percent else "psm"
    return n, form, a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"


def tree(nodes):
    """Levels of a tree, the root's last."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, at, node):
    """The siblings on the way up, and the top that the node gives."""
    seen = []
    for level in levels[:-1]:
        low = at - at % 8
        run = level[low : low + 8]
        seen += [x for i, x in enumerate(run) if low + i != at]
        node = sha("".join(node if low + i == at else x for i, x in enumerate(run)))
        at //= 8
    return seen, node


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def manifest(docs):
    """docs (doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof, folded root)."""
    import zlib

    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append(d)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    order = {g: sorted(groups[g], key=lambda d: (d[0] is not None, d[0] or 0, leaf(*d))) for g in names}
    trees = {g: tree([leaf(*d) for d in order[g]]) for g in names}
    forest = tree([trees[g][-1][0] for g in names]) if names else []
    out = []
    for k, g in enumerate(names):
        for i, d in enumerate(order[g]):
            claim = trees[g][0][i]
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0:
                claim = leaf(*d[:4], None if d[4] is None else lower(d[4]))
            inside, top = climb(trees[g], i, claim)
            outside, root = climb(forest, k, top)
            out.append((d[0], trees[g][0][i], trees[g][-1][0], forest[-1][0], sha("".join(inside + outside)), root))
    return sorted(out, key=repr)
