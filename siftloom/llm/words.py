"""Words of a batch of texts as byte ranges and 64-bit hashes, computed with NumPy."""

from __future__ import annotations

import functools
import hashlib
from typing import NamedTuple

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def blanks() -> np.ndarray:
    """Bytes that separate words: \\x20 and \\x09-\\x0D."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


@functools.cache
def non_letters() -> np.ndarray:
    """ASCII bytes that are no letters; bytes of other characters count as letters."""
    out = np.zeros(256, bool)
    out[:128] = [not chr(i).isalpha() for i in range(128)]
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(0xD6E8FEB86659FD93 | 1), _Powers(0xA0761D6478BD642F | 1)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers = _BYTES) -> np.ndarray:
    """Hash of values[start:end] of each range, the same wherever the run stands."""
    up, down = powers.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] of each range; of ``size`` values it equals that of ``gram_hashes``."""
    return run_hashes(values, starts, ends, _WORDS)


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive values (may reach over text borders)."""
    n = max(0, len(values) - size + 1)
    at = np.arange(n)
    return span_hashes(values, at, at + size)


class Words(NamedTuple):
    start: np.ndarray  # byte where the word starts
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words


def words_of(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    """Maximal runs of bytes that are no separators, within each text."""
    inside = np.concatenate([[False], ~separators[data], [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return Words(start, end, np.searchsorted(start, offsets))


#: Bytes above which a word is hashed on its own.
LONG_WORD = 2048


def word_hashes(data: np.ndarray, words: Words, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word, the same wherever it stands; seeds give independent hashes.

    Eight bytes at a time are mixed in.  A mix is no linear map, so no two words collide by
    construction, as they do under a polynomial of the bytes modulo a power of two.
    """
    start, length = words.start, words.end - words.start
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    h = mix((length.astype(np.uint64) + np.uint64(seed + 1)) * _ODD)
    at, lane = np.flatnonzero(length <= LONG_WORD), 0
    while len(at):
        rest = np.minimum(length[at] - lane, 8)
        piece = pad[(start[at] + lane)[:, None] + np.arange(8)]
        piece[np.arange(8) >= rest[:, None]] = 0
        h[at] = mix((h[at] ^ piece.view(np.uint64)[:, 0]) * _ODD + np.uint64(lane + 1))
        lane += 8
        at = at[length[at] > lane]
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        body = data[start[i]: words.end[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(body, digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return h
