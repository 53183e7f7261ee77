"""Words and their 64-bit hashes, straight from Arrow string buffers.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D, after A-Z are
lower-cased; this equals ``[^\\x20\\x09-\\x0D]+`` over code points, as those bytes
occur in UTF-8 for these characters alone. A word's hash is a polynomial of one
random 64-bit value per byte, finished by a mixing step.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
SEGMENT = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators where punctuation doesn't count: all ASCII but letters and digits.
_MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_POW = np.array([pow(_BASE, i, 2**64) for i in range(256)], dtype=np.uint64)


class Words(NamedTuple):
    """Hashes of all words of a batch; row i has those from offsets[i] to offsets[i + 1].

    begins has, for each asked length, the hashes of the words' first so many bytes.
    """

    hashes: np.ndarray
    offsets: np.ndarray
    begins: tuple[np.ndarray, ...] = ()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _powers(n: int) -> np.ndarray:
    global _POW
    while len(_POW) < n:
        _POW = np.concatenate([_POW, _POW * U64(pow(_BASE, len(_POW), 2**64))])
    return _POW


def _cuts(raw: np.ndarray, space: np.ndarray) -> list[int]:
    """Ends of segments of about SEGMENT bytes, each right after a separator where there is one."""
    cuts, at = [], 0
    while len(raw) - at > SEGMENT:
        end = at + SEGMENT
        spaces = np.flatnonzero(space[raw[at:end]])
        if len(spaces):
            end = at + int(spaces[-1]) + 1
        else:
            while end < len(raw) and not space[raw[end]]:
                end += 1
        cuts.append(end)
        at = end
    return [*cuts, len(raw)]


def word_hashes(column: pa.Array, punctuation: bool = True, begins: tuple[int, ...] = ()) -> Words:
    """Hashes of the words of every row, whole texts. Without ``punctuation``, ASCII marks separate words as spaces do."""
    space = _SPACE if punctuation else _MARKS
    raw, offsets = text_buffers(column)
    starts_doc = np.zeros(len(raw) + 1, dtype=bool)
    starts_doc[offsets] = True
    found, firsts, at = [], [], 0
    short: list[list[np.ndarray]] = [[] for _ in begins]
    for end in _cuts(raw, space):
        part = raw[at:end]
        inside = ~space[part]
        before = np.empty(len(part), dtype=bool)  # the byte before belongs to the same word
        if len(part):
            before[0] = at > 0 and not space[raw[at - 1]] and not starts_doc[at]
            before[1:] = inside[:-1] & ~starts_doc[at + 1 : end]
        starts = np.flatnonzero(inside & ~before)
        if len(starts):
            own = part[inside]
            first = np.cumsum(inside)[starts] - 1
            place = np.arange(len(own))
            place -= np.repeat(first, np.diff(first, append=len(own)))
            value = _BYTE[own]
            value *= _powers(int(place.max()) + 1)[place]
            found.append(np.add.reduceat(value, first))
            for n, parts in zip(begins, short):
                parts.append(np.add.reduceat(np.where(place < n, value, U64(0)), first))
            firsts.append(starts + at)
        at = end
    if not found:
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), tuple(np.zeros(0, np.uint64) for _ in begins))
    rows = np.searchsorted(np.concatenate(firsts), offsets, side="left")
    return Words(mix(np.concatenate(found)), rows, tuple(mix(np.concatenate(x)) for x in short))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, those across rows included."""
    out = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
    for i in range(n):
        out *= U64(0xD6E8FEB86659FD93)
        out += hashes[i : i + len(out)]
    return mix(out)
