"""Words of whole texts as 64-bit numbers, Karp-Rabin numbers of runs of words, and distinct shingles.

Many texts are handled at a time, as arrays: a word's number is a polynomial
in its code points, mixed, so no word is looked up or hashed on its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from proxigraph.llm.common import worker_state

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters whose words are numbered at a time; a longer word is taken whole.
CHARS = 1 << 20


def _word_characters() -> np.ndarray:
    """By code point: letters, digits and the underscore, as ``\\w`` has them."""
    known = worker_state().__dict__
    if "word_characters" not in known:
        known["word_characters"] = np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(0x110000))), bool, 0x110000)
    return known["word_characters"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _numbers(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), BASE, np.uint64))
    terms = codes[place + np.repeat(starts, lengths)].astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers[place]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))


def numbers_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the lower-cased words (runs of letters, digits and underscores) of all texts in order, and the words of each text."""
    lows = [(t or "").lower() for t in texts]
    borders = np.cumsum([len(t) + 1 for t in lows])
    codes = np.frombuffer("\0".join(lows).encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _word_characters()[codes].view(np.int8)
    edges = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    out, at = [], 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + CHARS, "right")))
        out.append(_numbers(codes, starts[at:stop], ends[at:stop]))
        at = stop
    return np.concatenate(out), np.diff(np.searchsorted(starts, borders), prepend=0)


def word_numbers(text: str | None) -> np.ndarray:
    return numbers_of([text])[0]


def runs(numbers: np.ndarray, size: int) -> np.ndarray:
    """Numbers of all runs of ``size`` words, from left to right."""
    n = len(numbers) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = numbers[:n].copy()
    for i in range(1, size):
        out *= BASE
        out += numbers[i : i + n]
    return mix(out)


def runs_by_text(numbers: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs within each text, text after text, and the runs of each text."""
    per = np.maximum(words - size + 1, 0)
    first = np.cumsum(words) - words
    at = np.repeat(first - (np.cumsum(per) - per), per) + np.arange(per.sum())
    return runs(numbers, size)[at], per


def distinct(values: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of values that lie text by text: distinct ones of each text in order, how often each occurs, and how many each text has."""
    values = values.copy()
    ends = np.cumsum(per)
    for a, b in zip((ends - per).tolist(), ends.tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[(ends - per)[per > 0]] = True
    at = np.flatnonzero(new)
    return values[at], np.diff(at, append=len(values)), np.diff(np.searchsorted(at, ends), prepend=0)


def shingles_of(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles text by text, their counts, shingles of each text; then all words' numbers and the words of each text.

    A text of fewer than ``size`` words, if it has any, is one shingle of all of them.
    """
    numbers, words = numbers_of(texts)
    values, per = runs_by_text(numbers, words, size)
    if ((words > 0) & (words < size)).any():
        first, parts, at = np.cumsum(words) - words, [], 0
        for i in np.flatnonzero((words > 0) & (words < size)).tolist():
            before = int(per[:i].sum()) if not parts else before + int(per[last:i].sum())
            parts += [values[at:before], runs(numbers[first[i] : first[i] + words[i]], int(words[i]))]
            at, last = before, i
        values = np.concatenate([*parts, values[at:]])
        per = np.where((words > 0) & (words < size), 1, per)
    return *distinct(values, per), numbers, words


def grouped(texts: Iterable[str | None], most: int) -> Iterator[list[str | None]]:
    """Consecutive texts, of about ``most`` characters together or one longer one."""
    held: list[str | None] = []
    size = 0
    for text in texts:
        n = len(text or "")
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += n
    if held:
        yield held
