"""Texts cut into pieces that encode independently, and a table of the ids of pieces.

Byte-level BPE splits a text by a pattern whose matches take at most one leading blank and otherwise stay within a run of
one class. So no match crosses a single blank between two non-blank characters, and the ids of `` word`` don't depend on the
text around it. Texts are cut at those blanks; a piece keeps the blank before it. For the same reason they are cut, without a
blank, where an ASCII letter meets an ASCII mark other than the apostrophe (which may open a contraction), and around a
single line feed between two graphic characters. A piece without a blank before it is called *bare*.

Most pieces are short and recur. Their ids are kept in a table of bounded size that is looked up for all pieces of many
texts at once: pieces of up to 15 bytes are exact 128-bit keys (the bytes, the length, and whether the piece is bare).
Others are encoded one by one. Texts that hold a special token's string are cut at it, and its id stands for it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from string import ascii_letters, punctuation

import numpy as np

#: Two neighbouring white-space characters, or one at an end of the text: then cuts need a closer look.
_UNEVEN = re.compile(r"^\s|\s$| \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")

LONGEST = 15
#: log2 of the slots; a table that is fuller than FULL is emptied and fills up again.
BITS = 21
FULL = 0.6

_U = np.uint64
_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(LONGEST + 1)], _U)
_HIGH = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(LONGEST + 1)], _U)


def pieces(text: str) -> list[str]:
    """Parts of a text that encode independently; every one but the first has lost its leading blank."""
    return _CUT.split(text) if _UNEVEN.search(text) else text.split(" ")


#: Bytes that are ASCII white space (as Unicode has it, with the four separators) or begin other white space.
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
_OPENS = _SPACE.copy()
_OPENS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


#: Classes of bytes between which texts are cut besides blanks.
_LETTER, _MARK, _GRAPHIC, _LINE = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _GRAPHIC
_CLASS[list(ascii_letters.encode())] = _LETTER
_CLASS[[c for c in punctuation.encode() if c != ord("'")]] = _MARK
_CLASS[10] = _LINE


def _bare_starts(joined: np.ndarray) -> np.ndarray:
    """Places where a piece starts that has no blank before it."""
    kind = _CLASS[joined]
    a, b = kind[:-1], kind[1:]
    turn = (a == _LETTER) & (b == _MARK) | (a == _MARK) & (b == _LETTER)
    line = np.flatnonzero(kind[1:-1] == _LINE) + 1
    graphic = lambda at: (kind[at] >= _LETTER) & (kind[at] <= _GRAPHIC)
    line = line[graphic(line - 1) & graphic(line + 1)]
    return np.concatenate([np.flatnonzero(turn) + 1, line, line + 1])


def _uneven(texts: Sequence[str], joined: np.ndarray, blanks: np.ndarray, start_of_text: np.ndarray) -> list[int]:
    """Numbers of the texts that can't be cut at every blank. Most are told by the bytes around their blanks."""
    before, after = joined[blanks - 1], joined[np.minimum(blanks + 1, len(joined) - 1)]
    odd = _OPENS[after] | _SPACE[before]
    late = np.flatnonzero(before >= 128)  # what ends a character of two bytes after 0xC3 is a letter
    odd[late] |= joined[blanks[late] - 2] != 0xC3
    maybe = set((np.searchsorted(start_of_text, blanks[odd], "right") - 1).tolist())
    maybe |= {i for i, t in enumerate(texts) if t and (t[0].isspace() or t[-1].isspace())}
    return [i for i in sorted(maybe) if _UNEVEN.search(texts[i])]


class Memo(dict):
    """text -> value, two generations of bounded size: what is not used for a generation is forgotten."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, text: str) -> bytes:
        value = self.old.get(text)
        if value is None:
            value = self.make(text)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[text] = value
        return value


class PieceEncoder:
    """``make(pieces, bare)`` gives the ids of each piece, as little-endian unsigned 32-bit integers.

    Pieces come without their leading blank; ``bare`` says of all of them that they had none. ``special`` has the ids, in
    the same form, of strings that are tokens wherever they stand.
    """

    def __init__(self, make: Callable[[list[str], bool], list[bytes]], bits: int = BITS, special: Mapping[str, bytes] | None = None):
        self.make, self.bits, self.special = make, bits, dict(special or {})
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if special else lambda text: [text]
        self._empty()

    def _empty(self) -> None:
        n = 1 << self.bits
        self.keys = np.zeros((n, 2), _U)  # high word 0: a free slot
        self.place, self.count = np.zeros(n, np.int64), np.zeros(n, np.int32)
        self.ids = np.zeros(1024, np.uint32)
        self.n_ids = self.used = 0

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low * _U(0x9E3779B97F4A7C15)) ^ (high * _U(0xC2B2AE3D27D4EB4F))
        h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return (h >> _U(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        slot = self._slots(low, high)
        there = self.keys[slot]
        same = (there[:, 0] == low) & (there[:, 1] == high)
        out = np.where(same, slot, -1)
        at = np.flatnonzero(~same & (there[:, 1] != 0))
        last = (1 << self.bits) - 1
        while len(at):  # the few whose slot another key has
            slot[at] = (slot[at] + 1) & last
            there = self.keys[slot[at]]
            same = (there[:, 0] == low[at]) & (there[:, 1] == high[at])
            out[at[same]] = slot[at[same]]
            at = at[~same & (there[:, 1] != 0)]
        return out

    def _keep(self, low: np.ndarray, high: np.ndarray, values: list[bytes]) -> None:
        """Add distinct keys that aren't there."""
        counts = np.fromiter((len(v) // 4 for v in values), np.int32, len(values))
        new = np.frombuffer(b"".join(values), "<u4")
        while self.n_ids + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.n_ids : self.n_ids + len(new)] = new
        places = self.n_ids + np.cumsum(counts) - counts
        self.n_ids += len(new)
        self.used += len(values)
        slot, at, last = self._slots(low, high), np.arange(len(low)), (1 << self.bits) - 1
        while len(at):
            free = np.flatnonzero(self.keys[slot[at], 1] == 0)
            _, one = np.unique(slot[at[free]], return_index=True)  # of several for one slot the first gets it
            won = at[free[one]]
            self.keys[slot[won], 0], self.keys[slot[won], 1] = low[won], high[won]
            self.place[slot[won]], self.count[slot[won]] = places[won], counts[won]
            rest = np.ones(len(at), bool)
            rest[free[one]] = False
            at = at[rest]
            slot[at] = (slot[at] + 1) & last

    def one(self, text: str) -> bytes:
        """Ids of one text, without the table."""
        out = []
        for i, part in enumerate(self.parts(text)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                own = pieces(part)
                out += self.make(own[:1], True) + self.make(own[1:], False)
        return b"".join(out)

    def _made(self, joined: bytes, start: np.ndarray, size: np.ndarray, bare: np.ndarray) -> list[bytes]:
        """Ids of the pieces at these places."""
        parts = [joined[a : a + n].decode() for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        flags = bare.tolist()
        heads, others = iter(self.make([p for p, f in zip(parts, flags, strict=True) if f], True)), iter(self.make([p for p, f in zip(parts, flags, strict=True) if not f], False))
        return [next(heads if f else others) for f in flags]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        raw = [t.encode() for t in texts]
        joined, blanks, start_of_text = self._joined(raw)
        uneven = _uneven(texts, np.frombuffer(joined, np.uint8), blanks, start_of_text)
        if any(x.encode() in joined for x in self.special):
            uneven = sorted({*uneven, *(i for i, t in enumerate(texts) if any(x in t for x in self.special))})
        if uneven:  # they are encoded by themselves below
            for t in uneven:
                raw[t] = b""
            joined, blanks, start_of_text = self._joined(raw)
        padded = joined + bytes(32 - len(joined) % 8)
        bare_starts = _bare_starts(np.frombuffer(joined, np.uint8))
        start = np.concatenate([[0], blanks + 1, bare_starts])
        order = np.argsort(start, kind="stable")
        start, bare = start[order], order > len(blanks)
        size = np.append(start[1:] - ~bare[1:], len(joined)) - start
        text_at = np.searchsorted(start, start_of_text)  # a text's first piece
        bare[text_at] = True
        place, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)

        short = np.flatnonzero((size > 0) & (size <= LONGEST))
        low, high = self._key(padded, start[short], size[short], bare[short])
        slot = self._find(low, high)
        lost = np.flatnonzero(slot < 0)
        if self.used + len(lost) > FULL * (1 << self.bits):
            self._empty()
            slot[:] = -1
            lost = np.arange(len(short))
        loose = np.flatnonzero(size > LONGEST)  # pieces that aren't kept
        if len(lost):
            order = lost[np.lexsort((low[lost], high[lost]))]
            new = order[np.append(True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]))]
            if self.used + len(new) <= FULL * (1 << self.bits):
                self._keep(low[new], high[new], self._made(joined, start[short[new]], size[short[new]], bare[short[new]]))
                slot[lost] = self._find(low[lost], high[lost])
            else:  # more different ones at once than the table takes
                loose = np.sort(np.concatenate([loose, short[lost]]))
        held = slot >= 0
        place[short[held]], count[short[held]] = self.place[slot[held]], self.count[slot[held]]
        extra = self._made(joined, start[loose], size[loose], bare[loose]) + [self.one(texts[t]) for t in uneven]
        if extra:  # their ids lie after those of the table
            at = np.concatenate([loose, text_at[uneven]]).astype(np.int64)
            sizes = np.fromiter((len(x) // 4 for x in extra), np.int64, len(extra))
            place[at], count[at] = self.n_ids + np.cumsum(sizes) - sizes, sizes
        flat = np.concatenate([self.ids[: self.n_ids], np.frombuffer(b"".join(extra), "<u4")])
        ends = np.cumsum(count)
        ids = flat[np.repeat(place - (ends - count), count) + np.arange(int(ends[-1]))]
        return ids, np.add.reduceat(count, text_at)

    @staticmethod
    def _joined(raw: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Texts with blanks between them, where all blanks are, and where the texts start."""
        joined = b" ".join(raw)
        return joined, np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])

    @staticmethod
    def _key(padded: bytes, start: np.ndarray, size: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both words of the keys: eight bytes from a place on are put together from two aligned words."""
        words = np.frombuffer(padded, "<u8")
        word, shift = start >> 3, ((start & 7) << 3).astype(_U)
        a, b, c = words[word], words[word + 1], words[np.minimum(word + 2, len(words) - 1)]
        back = _U(63) - shift
        low = (a >> shift) | ((b << _U(1)) << back)
        high = (b >> shift) | ((c << _U(1)) << back)
        low, high = low & _LOW[size], high & _HIGH[size]
        return low, high | (size.astype(_U) << _U(56)) | (bare.astype(_U) << _U(63))
