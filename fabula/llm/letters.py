"""Words of texts as runs of letters (or letters and digits), lower-cased, in numpy arrays."""

from __future__ import annotations

import numpy as np

from .common import mix, span_hashes

_BMP = 1 << 16
_table: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """For the code points below 65536: lower case, letter, letter or digit, upper case."""
    if not _table:
        chars = [chr(i) if not 0xD800 <= i < 0xE000 else "�" for i in range(_BMP)]
        lower = [c.lower() for c in chars]
        _table["lower"] = np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(lower)], np.uint32)
        _table["alpha"] = np.array([c.isalpha() for c in chars])
        _table["alnum"] = np.array([c.isalnum() for c in chars])
        _table["upper"] = np.array([c.isupper() for c in chars])
    return _table


class Runs:
    """The runs of one kind of character in a chunk of texts; code points of 65536 or more are letters.

    points: lower-cased code points; offs: each text's first point; starts,
    ends, rows: of the runs; hashes(): a hash of each run."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: str = "alpha"):
        t = _tables()
        raw = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        self.offs = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offs]
        low = np.minimum(raw, _BMP - 1)
        high = raw >= _BMP
        self.raw = raw
        self.points = np.where(high, raw, t["lower"][low])
        n = len(raw)
        solid = t[kind][low] | high
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = self.offs[(self.offs > 0) & (self.offs < n)]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.offs, self.starts, "right") - 1
        self.values = mix(self.points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.values, self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)

    def word(self, i: int) -> str:
        return "".join(map(chr, self.points[self.starts[i] : self.ends[i]]))


class Lookup:
    """Positions of hashes in a sorted array of known ones, behind a bit table that turns away most others."""

    BITS = 20

    def __init__(self, known: np.ndarray):
        self.known = known
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(known >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """For each hash its position, or -1."""
        out = np.full(len(h), -1, np.int64)
        likely = np.flatnonzero(self.maybe[(h >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if len(likely):
            at = np.searchsorted(self.known, h[likely])
            at[at == len(self.known)] = 0
            hit = self.known[at] == h[likely]
            out[likely[hit]] = at[hit]
        return out
