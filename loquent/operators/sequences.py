"""Operators on whole short sequences: repetition, alignment, punctuation, common substrings, snapping."""

from __future__ import annotations

import numpy as np


def trim_tail(values: list, window: int = 300, keep: int = 1) -> list:
    """Without the copies of a block that is repeated at the end, but `keep` of them; the longest stretch counts."""
    tail = values[-window:]
    best = (0, 0)
    for size in range(1, len(tail) // 2 + 1):
        copies = 1
        while (copies + 1) * size <= len(tail) and tail[-(copies + 1) * size : len(tail) - copies * size] == tail[-size:]:
            copies += 1
        if copies > 1 and copies * size > best[0] * best[1]:
            best = (size, copies)
    size, copies = best
    return values[: len(values) - max(0, copies - max(0, keep)) * size] if copies else values


def warp(cost: np.ndarray) -> np.ndarray:
    """Dynamic time warping (N9): pairs of row and column on the cheapest way; anti-diagonals are computed at once."""
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    way = np.zeros((n + 1, m + 1), np.int8)
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        before = np.stack([total[i - 1, j - 1], total[i - 1, j], total[i, j - 1]])
        diagonal = (before[0] < before[1]) & (before[0] < before[2])
        down = (before[1] < before[0]) & (before[1] < before[2])
        took = np.where(diagonal, 0, np.where(down, 1, 2))
        total[i, j] = cost[i - 1, j - 1] + before[took, np.arange(len(i))]
        way[i, j] = took
    way[0, :], way[:, 0] = 2, 1
    i, j, out = n, m, []
    while i or j:
        out.append((i - 1, j - 1))
        step = way[i, j]
        i, j = i - (step != 2), j - (step != 1)
    return np.array(out[::-1]).reshape(-1, 2)


def merge_marks(words: list[str], before: str = "\"'“¿([{-", after: str = "\"'.。,，!！?？:：”)]}、") -> list[str]:
    """Opening marks join the word after them and closing marks the word before; emptied places stay."""
    words = list(words)
    follow = len(words) - 1
    for k in range(len(words) - 2, -1, -1):
        if words[k].startswith(" ") and words[k].strip() and words[k].strip() in before:
            words[follow], words[k] = words[k] + words[follow], ""
        else:
            follow = k
    lead = 0
    for k in range(1, len(words)):
        if not words[lead].endswith(" ") and words[k] in after:
            words[lead], words[k] = words[lead] + words[k], ""
        else:
            lead = k
    return words


_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)


def _prefix_sums(text: str) -> np.ndarray:
    """Sums from which a hash of every stretch of the text follows; see common_substring."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = (codes ^ (codes << np.uint64(17)) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
    powers = np.full(len(codes), _BASE, np.uint64)
    powers[:1] = 1
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * np.multiply.accumulate(powers))])


def common_substring(a: str, b: str) -> str:
    """The longest common substring, the first of several in `a`.

    If two texts share a stretch of some length, they share a shorter one; so the length is found by halving. Stretches of a
    length are compared by hash, all at once, and what is taken is compared itself.
    """
    short, long, at = 0, min(len(a), len(b)), 0
    if not long:
        return ""
    sums, others = _prefix_sums(a), _prefix_sums(b)
    back = np.full(max(len(a), len(b)) + 1, _INVERSE, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    while short < long:
        n = (short + long + 1) // 2
        own, other = ((x[n:] - x[:-n]) * back[: len(x) - n] for x in (sums, others))
        found = next((int(i) for i in np.flatnonzero(np.isin(own, other)) if a[i : i + n] in b), None)
        if found is None:
            long = n - 1
        else:
            short, at = n, found
    return a[at : at + short]


def wrap_cues(words: list[tuple[float, float, str]], width: int = 42, lines: int = 2, pause: float = 3.0) -> list[tuple[float, float, str]]:
    """Subtitle cues from timed words: lines of at most `width`, `lines` lines a cue, a new cue after a pause."""
    cues: list[tuple[float, float, str]] = []
    text, used, rows, begin, last = "", 0, 1, 0.0, None
    for start, end, word in words:
        fits = used + len(word) <= width
        if last is None or start - last > pause or (not fits and rows >= lines):
            if text:
                cues.append((begin, last, text.strip()))
            text, used, rows, begin = word.lstrip(), len(word.lstrip()), 1, start
        elif fits:
            text, used = text + word, used + len(word)
        else:
            text, used, rows = text + "\n" + word.lstrip(), len(word.lstrip()), rows + 1
        last = end
    if text:
        cues.append((begin, last, text.strip()))
    return cues
