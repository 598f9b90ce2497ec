"""Words of many texts at once: places and hashes, by NumPy over the texts' bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)

#: Bytes of words: all but ASCII white space; digits, ASCII letters and all of non-ASCII characters.
NOT_SPACE = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_CODES = np.arange(256)
WORD = (_CODES >= 0x80) | np.isin(_CODES, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
_LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 0x20, _CODES).astype(np.uint8)

_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _up_to(count: int) -> list[np.ndarray]:
    """Powers of the factor and of its inverse, modulo 2^64."""
    if len(_powers[0]) < count:
        for place, base in enumerate((_FACTOR, _INVERSE)):
            steps = np.full(count + count // 4, base, np.uint64)
            steps[0] = 1
            _powers[place] = np.cumprod(steps)
    return _powers


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


class Words:
    """The words of a few texts. ``start`` and ``end`` are places in ``data``, ``hash`` the words'
    hashes, and ``count`` the number of words of each text."""

    def __init__(self, texts: Sequence[str], inside: np.ndarray, lower: bool = False):
        coded = [text.encode("utf-8", "surrogatepass") for text in texts]
        self.raw = b"\n".join(coded)
        data = np.frombuffer(self.raw, np.uint8)
        self.data = _LOWER[data] if lower else data
        marks = np.zeros(len(data) + 2, np.int8)
        marks[1:-1] = inside[self.data]
        edges = np.flatnonzero(np.diff(marks))
        self.start, self.end = edges[::2], edges[1::2]
        power, inverse = _up_to(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        self.hash = mixed((sums[self.end] - sums[self.start]) * inverse[self.start])
        bounds = np.cumsum([len(c) + 1 for c in coded])
        self.count = np.diff(np.searchsorted(self.start, bounds), prepend=0)

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct words, and for each word its number among them. Checked byte by byte."""
        _, first, number = np.unique(self.hash, return_index=True, return_inverse=True)
        length = self.end - self.start
        same = first[number]
        equal = length == length[same]
        if equal.all():
            ends = np.cumsum(length)
            own = np.repeat(self.start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
            equal = self.data[own] == self.data[own + np.repeat(self.start[same] - self.start, length)]
        raw, start, end = self.data.tobytes(), self.start, self.end
        if not equal.all():  # a collision: number the words themselves
            words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
            numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
            return list(numbers), np.array([numbers[w] for w in words], np.int64)
        return [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())], number


#: Text bytes that are looked at together, about.
BLOCK_BYTES = 2 << 20


def blocks(texts: list[str], most: int | None = None) -> Iterator[slice]:
    """Consecutive texts of about ``most`` bytes (``BLOCK_BYTES``) together; a longer text alone."""
    most = most or BLOCK_BYTES
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield slice(start, len(texts))
