"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWERED)


def shingle_set(text: str | None, n: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def jaccard_components(rows: list[tuple], n: int, above: int, below: int) -> collections.Counter:
    """Counter of (doc_id, n_shingles, component_id) over rows (doc_id, text)."""
    sets = [shingle_set(text, n) for _, text in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if every and below * common >= above * every:
                root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (doc_id, _) in enumerate(rows):
        known = least.get(find(i))
        least[find(i)] = doc_id if known is None else known if doc_id is None else min(known, doc_id)
    return collections.Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def contamination(docs: list[tuple], items: list[tuple], window: int = 10) -> collections.Counter:
    """Counter of (doc_id, n_words, n_hit, item_ids) over rows (doc_id, text) and (item_id, text)."""
    windows = collections.defaultdict(set)
    for item, text in items:
        words = item_words(text)
        for start in range(max(len(words) - window + 1, min(len(words), 1))):
            windows[tuple(words[start : start + window])].add("" if item is None else str(item))
    out = collections.Counter()
    for doc_id, text in docs:
        words, hit, named = item_words(text), set(), set()
        for length in {len(w) for w in windows}:
            for start in range(len(words) - length + 1):
                found = windows.get(tuple(words[start : start + length]))
                if found:
                    hit.update(range(start, start + length))
                    named |= found
        out[doc_id, len(words), len(hit), tuple(sorted(named))] += 1
    return out


def deduplicated_lines(rows: list[tuple]) -> dict[tuple, str | None]:
    """(doc_id, text) to the text without later occurrences of three-line windows."""
    seen: set[tuple] = set()
    out: dict[tuple, str | None] = {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out[doc_id, text] = None
            continue
        lines, covered = text.split("\n"), set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if not "".join(window).strip(" \t\r"):
                continue
            if window in seen:
                covered.update((i, i + 1, i + 2))
            seen.add(window)
        out[doc_id, text] = "\n".join(x for i, x in enumerate(lines) if i not in covered)
    return out


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def periodic_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of 24 words and three periods or more, by trying all periods."""
    found: dict[tuple[int, int], int] = {}
    for period in range(1, len(words) // 3 + 1):
        begin = 0
        while begin + period < len(words):
            end = begin
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            length = end + period - begin
            if end > begin and length >= max(24, 3 * period):
                found.setdefault((begin, length), period)
            begin = max(end, begin + 1)
    return sorted((s, n, p) for (s, n), p in found.items())
