"""Vectorised pre-tokenisation: the matches of the public tokenizers' patterns as byte offsets.

Characters are letters, numbers, white space or others; a match starts where the class
changes, with the patterns' special cases applied afterwards.  Distinct matches of a step
are encoded once and remembered by the worker, up to ``MEMO`` matches.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

from siftloom.llm.arrays import ragged, strings

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
MEMO = 200_000
#: Bytes of text that are cut and encoded in one step.
TOKEN_BYTES = 3 << 20


@functools.cache
def character_classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    for block in range(0, 0x110000, 0x800):
        if 0xD800 <= block < 0xE000:  # surrogates
            continue
        points = "".join(map(chr, range(block, block + 0x800)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, points):
                table[block + m.start(): block + m.end()] = kind
    return table


def byte_classes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        b0, b1, b2, b3 = (pad[lead + i].astype(np.int32) for i in range(4))
        b1, b2, b3 = b1 & 63, b2 & 63, b3 & 63
        three, four = b0 >= 0xE0, b0 >= 0xF0
        point = np.where(four, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3,
                         np.where(three, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 31) << 6 | b1))
        kind = table[point]
        out[lead] = out[lead + 1] = kind
        out[lead[three] + 2] = kind[three]
        out[lead[four] + 3] = kind[four]
    return out


def _contractions(data: np.ndarray, start: np.ndarray, begins: np.ndarray, kinds: np.ndarray, at: np.ndarray) -> None:
    """Cut 's 't 're 've 'm 'll 'd at the apostrophes ``at`` that stand alone before letters of their text."""
    n = len(data)
    at = at[~begins[at + 1]]
    at = at[start[at + 1] & (kinds[at + 1] == LETTER)]
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    one, two = pad[at + 1], pad[at + 2]
    # the second letter must belong to the same text, so no text starts there
    pair = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    pair &= ~np.concatenate([begins, [True]])[at + 2]
    single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    for hit, size in ((at[single], 2), (at[pair & ~single], 3)):
        start[hit + 1] = False
        start[hit[hit + size < n] + size] = True


def word_matches(data: np.ndarray, offsets: np.ndarray, byte_level: bool, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each match, whether it is white space, and the index of each text's first match.

    ``byte_level``: one blank joins the run after it and number runs stay whole, as in the
    byte-level pattern; otherwise blanks separate and every number is a match.  White space
    is returned as matches too, so that the matches cover the bytes.
    """
    n = len(data)
    kinds = byte_classes(data, table)
    start = np.empty(n, bool)
    if n:
        start[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    start |= begins[:-1]
    lead = (data & 0xC0) != 0x80
    if not byte_level:
        start |= (kinds == NUMBER) & lead
    quotes = np.flatnonzero(start & (data == ord("'")))
    if byte_level:
        run = np.flatnonzero(start & (kinds != SPACE) & ~begins[:-1])
        run = run[kinds[run - 1] == SPACE]
        blank = data[run - 1] == 32
        last = run - 1
        for _ in range(2):
            last = last - ~lead[last]
        start[last] = True
        merged = run[blank]
        quotes = np.setdiff1d(quotes, merged, assume_unique=True)
        _contractions(data, start, begins, kinds, quotes)
        start[merged] = False
    else:
        _contractions(data, start, begins, kinds, quotes)
    at = np.flatnonzero(start)
    return at, kinds[at] == SPACE, np.searchsorted(at, offsets)


class Memo:
    """Ids of matches: each distinct match is encoded once per worker."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)

    def slots(self, words: list[str]) -> np.ndarray:
        if len(self.slot) > MEMO:
            self.clear()
        new = [w for w in words if w not in self.slot]
        if new:
            found = self.encode(new)
            base = len(self.slot)
            self.slot.update(zip(new, range(base, base + len(new)), strict=True))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            flat = np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum()))
            self.ids = np.concatenate([self.ids, flat])
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))


def encode_texts(data: np.ndarray, offsets: np.ndarray, byte_level: bool, memo: Memo, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and the index of each text's first id."""
    at, space, first = word_matches(data, offsets, byte_level, table)
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    coded = strings(data, np.append(at, len(data))).dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary.to_pylist()
    if byte_level:
        slots = memo.slots(words)[index]
    else:
        drop = np.zeros(len(words), bool)
        drop[index[space]] = True
        slots = np.full(len(words), -1, np.int64)
        slots[~drop] = memo.slots([w for w, d in zip(words, drop, strict=True) if not d])
        slots = slots[index]
        first = np.concatenate([[0], np.cumsum(~space)])[first]
        slots = slots[~space]
    begin = memo.first[slots]
    sizes = memo.first[slots + 1] - begin
    ids = memo.ids[ragged(begin, sizes)]
    return ids, np.concatenate([[0], np.cumsum(sizes)])[first]
