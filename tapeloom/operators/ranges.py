"""Ranges that never meet, held in short sorted blocks.

Only a directory of the blocks' first starts is held at once; a question or a change opens the one
block next to the range. The blocks sit behind a mapping, which a stream backs with its state store.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right, insort

#: Ranges in a block before it is cut in two.
WIDTH = 256


def _pack(pairs) -> bytes:
    return array("q", [x for pair in pairs for x in pair]).tobytes()


def _unpack(data: bytes) -> list[tuple[int, int]]:
    flat = array("q", bytes(data))
    return list(zip(flat[::2], flat[1::2]))


class RangeBlocks:
    """``blocks`` maps a block's number to its packed ranges, ``directory`` is the packed (first start, number) list."""

    def __init__(self, blocks=None, directory: bytes = b"", width: int = WIDTH):
        self.blocks, self.width = {} if blocks is None else blocks, width
        pairs = _unpack(directory)
        self.firsts, self.numbers = [p[0] for p in pairs], [p[1] for p in pairs]
        self._number, self._held, self._changed = None, [], False

    def directory(self) -> bytes:
        """The directory to start from next time; what is open is put back first."""
        self._close()
        return _pack(zip(self.firsts, self.numbers))

    def _close(self) -> None:
        if self._changed:
            self.blocks[self._number] = _pack(self._held)
        self._changed = False

    def _open(self, at: int) -> list[tuple[int, int]]:
        if self.numbers[at] != self._number:
            self._close()
            self._number = self.numbers[at]
            self._held = _unpack(self.blocks.get(self._number))
        return self._held

    def meets(self, start: int, end: int) -> bool:
        """Whether a held range shares time with [start, end)."""
        at = bisect_right(self.firsts, start) - 1
        if at >= 0:
            held = self._open(at)
            i = bisect_left(held, (start,))
            if (i > 0 and held[i - 1][1] > start) or (i < len(held) and held[i][0] < end):
                return True
        return at + 1 < len(self.firsts) and self.firsts[at + 1] < end

    def add(self, start: int, end: int) -> None:
        if not self.numbers:
            self._close()
            self.firsts, self.numbers = [start], [0]
            self._number, self._held = 0, []
        at = max(0, bisect_right(self.firsts, start) - 1)
        held = self._open(at)
        insort(held, (start, end))
        self.firsts[at], self._changed = held[0][0], True
        if len(held) > self.width:
            middle, number = len(held) // 2, max(self.numbers) + 1
            self.blocks[number] = _pack(held[middle:])
            self.firsts.insert(at + 1, held[middle][0])
            self.numbers.insert(at + 1, number)
            del held[middle:]

    def remove(self, start: int, end: int) -> None:
        at = bisect_right(self.firsts, start) - 1
        held = self._open(at)
        del held[bisect_left(held, (start, end))]
        self._changed = True
        if held:
            self.firsts[at] = held[0][0]
            return
        self.blocks.pop(self._number, None)
        del self.firsts[at], self.numbers[at]
        self._number, self._changed = None, False


class SortedRanges:
    """The same for ranges that one list may hold."""

    def __init__(self):
        self.held: list[tuple[int, int]] = []

    def meets(self, start: int, end: int) -> bool:
        i = bisect_left(self.held, (start,))
        return (i > 0 and self.held[i - 1][1] > start) or (i < len(self.held) and self.held[i][0] < end)

    def add(self, start: int, end: int) -> None:
        insort(self.held, (start, end))

    def remove(self, start: int, end: int) -> None:
        del self.held[bisect_left(self.held, (start, end))]
