"""Texts as rows of units that a tokenizer treats each for itself, found in numpy, so that every different unit is tokenised once.

A unit ends between a letter and an ASCII character that is neither letter nor white space, in either direction, except
after an apostrophe (``'s`` and the like belong together), and at white space, in one of two ways: white space ends a
unit, or a space begins one while other white space and all but the last character of longer runs are units of their
own. Bytes of other characters than ASCII and two-byte Latin letters never make a border.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

WHITE, LETTER, MARK, OTHER = range(4)
APOSTROPHE, SPACE = 39, 32
_KIND = np.full(256, OTHER, np.uint8)
_KIND[:128] = MARK
_KIND[28:32] = OTHER
_KIND[[9, 10, 11, 12, 13, 32]] = WHITE
_KIND[65:91] = _KIND[97:123] = LETTER


def kinds(raw: np.ndarray) -> np.ndarray:
    """The kind of every byte of UTF-8 text."""
    out = _KIND[raw]
    lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC8))  # U+00C0 to U+023F: letters but for two signs
    lead = lead[(raw[lead] != 0xC3) | ((raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7))]
    out[lead] = out[lead + 1] = LETTER
    return out


def borders(raw: np.ndarray, ends: np.ndarray, leading: bool) -> np.ndarray:
    """Whether a unit begins at each byte but the first. ``ends`` are the last bytes of texts; a space begins units if ``leading``."""
    kind = kinds(raw)
    before, after = kind[:-1], kind[1:]
    out = (before == LETTER) & (after == MARK)
    out |= (before == MARK) & (after == LETTER) & (raw[:-1] != APOSTROPHE)
    white = kind == WHITE
    if not leading:
        return out | white[:-1] & ~white[1:]
    followed = np.append(~white[1:], False)
    followed[ends] = False
    out |= white[1:] & (~white[:-1] | followed[1:])
    return out | white[:-1] & ~white[1:] & (raw[:-1] != SPACE)


class Units:
    """The units of a batch of texts: different ones by number, and where each text's begin."""

    def __init__(self, texts: pa.Array, leading: bool, whole: Callable[[np.ndarray], np.ndarray] | None = None) -> None:
        """``texts`` is a string array without nulls. ``whole`` marks bytes; a text with a marked one is one unit."""
        packed = texts.cast(pa.large_binary())
        off = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
        raw = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        starts = np.zeros(len(raw) + 1, bool)
        if len(raw) > 1:
            starts[1:-1] = borders(raw, off[1:][np.diff(off) > 0] - 1, leading)
        if whole is not None:
            for i in np.unique(np.searchsorted(off, np.flatnonzero(whole(raw)), side="right") - 1):
                starts[off[i] : off[i + 1]] = False
        starts[off] = True
        cuts = np.flatnonzero(starts)
        if not len(raw):
            cuts = np.zeros(1, np.int64)
        self.raw, self.ends = raw, off[1:]
        units = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)])
        coded = units.dictionary_encode()
        self.different: list[bytes] = coded.dictionary.to_pylist()
        self.numbers: pa.Array = coded.indices
        self.first: np.ndarray = np.searchsorted(cuts, off)

    def joined(self, of_unit: list[bytes]) -> tuple[memoryview, list[int]]:
        """What stands for each unit, laid end to end, and where each text's begins."""
        laid = pa.array(of_unit, pa.large_binary()).take(self.numbers)
        if not len(laid):
            return memoryview(b""), [0] * len(self.first)
        ends = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset : laid.offset + len(laid) + 1]
        return memoryview(laid.buffers()[2] or b""), ends[self.first].tolist()
