"""Plain single-process versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def kept_words(docs, width=20):
    """docs: [(doc_id, text)]; {index: (n_words, n_removed, kept_sha256)} in the order of ids, then texts."""
    seen, out = set(), []
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, docs[i][1] or ""))
    for i in order:
        words = SPACE_WORD.findall(docs[i][1] or "")
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            if window in seen:
                gone[k : k + width] = [True] * width
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((docs[i][0], len(words), sum(gone), sha(kept)))
    return out


def base_stats(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    lines = [line for line in text.split("\n") if SPACE_WORD.search(line)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)
    )


def fingerprint(text):
    words = SPACE_WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, distance=2):
    """{fingerprint: component number} by comparing all pairs of distinct fingerprints."""
    distinct, root = sorted(set(prints)), {}
    root = {p: p for p in distinct}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                root[top(a)] = top(b)
    return {p: top(p) for p in distinct}


def contamination(docs, items, width=13):
    """[(doc_id, n_words, n_hit, sorted items)]."""
    grams = {}
    for item, text in items:
        words = LETTER_WORD.findall(lower(text or ""))
        for k in range(max(1, len(words) - width + 1) if words else 0):
            grams.setdefault(tuple(words[k : k + width]), set()).add("" if item is None else str(item))
    widths = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        words, hit, found = LETTER_WORD.findall(lower(text or "")), set(), set()
        for n in widths:
            for k in range(len(words) - n + 1):
                owners = grams.get(tuple(words[k : k + n]))
                if owners:
                    found |= owners
                    hit.update(range(k, k + n))
        out.append((doc, len(words), len(hit), sorted(found)))
    return out


RULES = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def secret_spans(text):
    """Base spans as (start, kind number, end)."""
    out = []
    for k, (_, pattern, group, least) in enumerate(RULES):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(out)
