"""Bounded cache of encoded text pieces, for tokenizers that cut a text into independent pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHARS = 1_000_000  #: bytes of text that a task works on at once
PIECES, IDS = 600_000, 6_000_000  #: when it holds more, the cache forgets the pieces it has seen only once


class Pieces:
    """Ids of pieces; encode_many turns an array of unseen pieces into their ids in one array and the number of ids of each."""

    def __init__(self, encode_many: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.encode_many = encode_many
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())  # by slot
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size, self.seen = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def forget(self) -> None:
        """Keep the pieces seen more than once since the last time, up to half the room."""
        n = len(self.known)
        keep = np.flatnonzero(self.seen[:n] > 1)
        keep = keep[np.argsort(-self.seen[keep], kind="stable")[: PIECES // 2]]
        if self.size[keep].sum() > IDS // 2:
            return self.clear()
        known = self.known.take(pa.array(keep))
        got = self.gather(keep)
        self.clear()
        self._add(known, *got)

    def _add(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.known), len(self.known) + len(pieces)
        self._room("flat", self.used + len(ids))[self.used : self.used + len(ids)] = ids
        self._room("size", m)[n:m] = sizes
        self._room("seen", m)
        self._room("start", m)[n:m] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.known = pa.concat_arrays([self.known, pieces])

    def _room(self, name: str, need: int) -> np.ndarray:
        a = getattr(self, name)
        if need > len(a):
            b = np.zeros(max(need, 2 * len(a)), a.dtype)
            b[: len(a)] = a
            setattr(self, name, b)
        return getattr(self, name)

    def slots(self, pieces: pa.Array) -> np.ndarray:
        """Slot of each piece; unseen ones are encoded."""
        if len(self.known) > PIECES or self.used > IDS:
            self.forget()
        found = pieces.dictionary_encode()
        at, each = found.indices.to_numpy(), found.dictionary
        slot = pc.index_in(each, value_set=self.known)
        new = each.filter(slot.is_null())
        slot = slot.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            slot[slot < 0] = len(self.known) + np.arange(len(new))
            self._add(new, *self.encode_many(new))
        self.seen[slot] += np.bincount(at, minlength=len(each))
        return slot[at]

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the slots' pieces in one array, and the number of ids of each."""
        size = self.size[slots]
        move = np.repeat(self.start[slots] - (np.cumsum(size) - size), size)
        return self.flat[move + np.arange(len(move))], size


def parts(batch: pa.RecordBatch, text: int, size: int = CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about size bytes (one text at least)."""
    length = np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)).astype(np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(length[lo:]), size)) + lo)
        yield batch.slice(lo, hi - lo)
        lo = hi
