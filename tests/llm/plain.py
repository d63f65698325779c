"""The contracts again in plain Python, for the tests."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

A_TO_Z = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def normal(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))


def decontaminated(docs, items, window=10):
    """(doc_id, text) and (item_id, text) to (doc_id, n_words, n_hit, n_items, sha, contaminated)."""
    windows = defaultdict(set)
    for item, text in items:
        w = normal(text)
        if item is None or not w:
            continue
        size = min(window, len(w))
        for i in range(len(w) - size + 1):
            windows[tuple(w[i : i + size])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = normal(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                names = windows.get(tuple(w[i : i + size]))
                if names:
                    found |= names
                    hit.update(range(i, i + size))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def deduplicated(docs, length=20):
    """(doc_id, text) to (doc_id, n_words, n_removed, sha, kept), in the order given."""
    first = {}
    rows = [(d, words(t)) for d, t in docs]
    for d, w in rows:
        if d is not None:
            for i in range(len(w) - length + 1):
                key = tuple(w[i : i + length])
                first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in rows:
        hit = set()
        if d is not None:
            for i in range(len(w) - length + 1):
                if first[tuple(w[i : i + length])] < (d, i):
                    hit.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in hit)
        out.append((d, len(w), len(hit), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def shingle_set(text, length=5):
    w = words((text or "").translate(A_TO_Z))
    return frozenset(tuple(w[i : i + length]) for i in range(len(w) - length + 1)) if len(w) >= length else frozenset([tuple(w)] if w else [])


def joined(docs):
    """(doc_id, text) to {doc_id: (n_shingles, component_id)}; doc_ids are distinct."""
    sets = {d: shingle_set(t) for d, t in docs}
    having = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            having[g].append(d)
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for e, o in Counter(e for g in s for e in having[g] if e > d).items():
            if 100 * o >= 75 * (len(s) + len(sets[e]) - o):
                a, b = top(d), top(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if count[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def base_spans(text):
    found = []
    for k, (kind, pattern, least) in enumerate((("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))):
        for m in re.finditer(pattern, text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return host.translate(A_TO_Z), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
