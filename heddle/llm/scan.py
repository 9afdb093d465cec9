"""Runs of characters found over whole Arrow buffers at a time.

Texts of a block are looked at as one array of code points; classes come from a
table, and where words begin and end from comparing neighbours. The words are
then slices of the texts' own UTF-8 bytes, without a Python string for each.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
#: White space as Unicode's property has it; str.isspace has four control characters more.
_BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_tables: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """The class of each code point: letter (L*), number (N*), white space or other; unassigned ones are other."""
    if "class" not in _tables:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
        table[_BLANKS] = BLANK
        _tables["class"] = table
    return _tables["class"]


def code_points(data: bytes | memoryview) -> np.ndarray:
    return np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)


def byte_offsets(points: np.ndarray) -> np.ndarray:
    """Where each code point begins in UTF-8, and the end."""
    out = np.zeros(len(points) + 1, np.int64)
    width = np.ones(len(points), np.uint8)
    if len(points) and points.max() >= 0x80:
        width += points >= 0x80
        width += points >= 0x800
        width += points >= 0x10000
    np.cumsum(width, out=out[1:])
    return out


def utf8(texts: pa.Array) -> tuple[pa.Buffer | bytes, np.ndarray]:
    """The bytes of a string array without nulls, and where its texts begin and end in them."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    first, last = int(offsets[0]), int(offsets[-1])
    return (data.slice(first, last - first) if data is not None else b""), offsets - first


def slices(data, starts: np.ndarray, ends: np.ndarray | None = None) -> pa.Array:
    """The byte ranges as strings. Without ``ends`` each reaches to the next start, and the last of ``starts`` is the end."""
    if ends is None:
        return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), pa.py_buffer(data))
    # what lies between the ranges becomes slices of its own, every second one is kept
    both = np.empty(2 * len(starts) + 1, np.int64)
    both[0:-1:2], both[1::2], both[-1] = starts, ends, ends[-1] if len(ends) else 0
    every = pa.LargeStringArray.from_buffers(2 * len(starts), pa.py_buffer(both), pa.py_buffer(data))
    return every.take(pa.array(np.arange(0, 2 * len(starts), 2)))


def word_runs(points: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (in code points) of the runs of letters and numbers; none goes across ``borders``."""
    kind = classes()[points]
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = (kind == LETTER) | (kind == NUMBER)
    change = inside[1:] != inside[:-1]
    inner = borders[(borders > 0) & (borders < len(points))]
    split = inner[inside[inner] & inside[inner + 1]]
    edge = np.flatnonzero(change)
    begins, ends = edge[0::2], edge[1::2]
    if len(split):
        begins, ends = np.sort(np.concatenate([begins, split])), np.sort(np.concatenate([ends, split]))
    return begins, ends


#: The endings that a byte-level BPE cuts off after an apostrophe.
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


def pre_tokens(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where (in code points) the pre-tokens of the byte-level BPE of 50,257 ids begin, and the end of the last.

    ``borders`` are the begins of the texts and the end of all; the rules look
    at nothing beyond a text: a run of letters, of numbers or of other signs is
    one pre-token together with one space before it; of several blanks before a
    text sign the last stands apart; an ending after an apostrophe that follows
    no space and no other sign stands apart.
    """
    n = len(points)
    if not n:
        return np.zeros(1, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[borders] = True
    blank = kind == BLANK
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start |= first
    # a space is part of what follows it
    space = points == 0x20
    after_space = np.zeros(n + 1, bool)
    after_space[1:n] = space[:-1] & ~blank[1:] & ~first[1:n]
    start &= ~after_space
    # the last blank of a run before a text sign begins a pre-token
    last = np.zeros(n + 1, bool)
    last[: n - 1] = blank[:-1] & ~blank[1:] & ~first[1:n]
    start |= last
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        before = marks - 1
        free = first[marks] | ((kind[before] != OTHER) & ~space[before])
        marks = marks[free]
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        fence = np.concatenate([first, np.ones(3, bool)])
        taken = np.zeros(len(marks), bool)
        for ending in _ENDINGS:
            hit = ~taken
            for i, ch in enumerate(ending, 1):
                hit &= (padded[marks + i] == ord(ch)) & ~fence[marks + i]
            taken |= hit
            at = marks[hit]
            start[at + 1] = False
            start[at + 1 + len(ending)] = True
    return np.flatnonzero(start)
