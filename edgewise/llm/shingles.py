"""64-bit hashes of words and of word shingles, vectorised over a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: bytes hashed at once (cut at white space; one longer word is taken whole)
WINDOW = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    table = _tables.get(name)
    if table is None or len(table) < n:
        table = np.ones(max(n, 1 << 16), np.uint64)
        done = 1
        while done < len(table):
            take = min(done, len(table) - done)
            table[done:done + take] = table[:take] * np.uint64(pow(base, done, 1 << 64))
            done += take
        if n <= 4 * WINDOW:
            _tables[name] = table
    return table


def _places(n: int) -> np.ndarray:
    """A random odd number for each place in a word: no structure of a long word can cancel it, as it can a power."""
    table = _tables.get("places")
    if table is None or len(table) < n:
        table = mix(mix(np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64)) + np.uint64(_BASE)) | np.uint64(1)
        if n <= 4 * WINDOW:
            _tables["places"] = table
    return table


def _window_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, start bytes) of the words of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], _SPACE[raw], [True]])
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    # a sum over a word's bytes, each times a random number of its place in the word; the length joins in
    each = np.diff(np.concatenate([starts, [len(raw)]]))
    at = np.arange(len(raw), dtype=np.int64)
    at[starts[0]:] -= np.repeat(starts, each)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * _places(int(at.max()) + 1)[at])])
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64)), starts


def _windows(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = min(len(data), at + WINDOW)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in order."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        hashes, starts = _window_hashes(b"\n".join(group))
        edges = np.cumsum([len(t) + 1 for t in group])
        yield from np.split(hashes, np.searchsorted(starts, edges[:-1]))

    for text in texts:
        if len(text) > WINDOW:
            if group:
                yield from flush()
                group, size = [], 0
            yield np.concatenate([_window_hashes(w)[0] for w in _windows(text)])
            continue
        if size + len(text) > WINDOW:
            yield from flush()
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group:
        yield from flush()


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; of the whole sequence if there are fewer words."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = words[:len(words) - n + 1].copy()
    for k in range(1, n):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k:len(words) - n + 1 + k])
    return np.unique(mix(h + np.uint64(n)))
