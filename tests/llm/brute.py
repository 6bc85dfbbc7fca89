"""Plain versions of the contracts of the registered queries, one row at a time."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def quality_base(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    inside = set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            inside.update(range(i, i + 5))
    n, r = len(words), len(inside)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 10 or 100 * r > 20 * n


def secret_base(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    out = []
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for rank, (kind, pattern, group, least) in enumerate((("assign", assign, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def url_parts(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return lower(host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def url_rule(host: str, path: str) -> tuple[str | None, str | None]:
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_base(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels."""
    words = LICENSE_WORD.findall(lower(text or ""))
    at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in at}))


def shingle_set(text: str | None, k: int) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near_components(texts: dict[int, str | None], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, component), by counting shared shingles of all pairs."""
    sets = {d: shingle_set(t, k) for d, t in texts.items()}
    classes: dict[frozenset, list[int]] = defaultdict(list)
    for d, s in sets.items():
        if s:
            classes[s].append(d)
    names = {s: min(ds) for s, ds in classes.items()}
    holders: dict[tuple, list[int]] = defaultdict(list)
    size = {}
    for s, d in names.items():
        size[d] = len(s)
        for x in s:
            holders[x].append(d)
    root = {d: d for d in names.values()}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    shared: dict[int, Counter] = defaultdict(Counter)
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[min(a, b)][max(a, b)] += 1
    for a, c in shared.items():
        for b, n in c.items():
            if 100 * n >= percent * (size[a] + size[b] - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(names[s]) if s else d) for d, s in sets.items()}


def archive(pages: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """page_id to payload_bytes, digest, record_type and refers_to."""
    data = {p: (h or "").encode() for p, h in pages}
    first: dict[bytes, int] = {}
    for p, b in data.items():
        first[b] = min(first.get(b, p), p)
    out = {}
    for p, b in data.items():
        revisit = len(b) >= 100 and first[b] != p
        out[p] = (len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None)
    return out


def mix_targets(sizes: dict[str | None, int], weights=(5, 2, 1), most: float = 3.0) -> dict[str | None, float]:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target: dict = {}
    left, free = float(sum(sizes.values())), set(order)
    while free:
        total = sum(w[s] for s in free)
        full = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not full:
            target |= {s: left * w[s] / total for s in free}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


def nearest(ids: np.ndarray, x: np.ndarray, every: int = 50, k: int = 5) -> dict[int, list[tuple[int, float]]]:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = unit @ unit[q]
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[q]), key=lambda j: (-score[j], ids[j]))[:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def auc(score: np.ndarray, label: np.ndarray) -> float:
    from pandas import Series

    rank = Series(score).rank().to_numpy()
    pos, neg = label.sum(), (1 - label).sum()
    return float((rank[label == 1].sum() - pos * (pos + 1) / 2) / (pos * neg))
