"""Words and word shingles of text batches, as arrays inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of a hash over word positions and of its final mix (fixed values).
STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words of all texts as codes into their distinct words, offsets per text); null texts are empty.

    Words are what ASCII white space separates, with A-Z lower-cased.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten()
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py() and len(flat):
        mask = full.to_numpy(zero_copy_only=False)
        offsets = np.r_[0, np.cumsum(mask)][offsets]
        flat = flat.filter(full)
    return flat.dictionary_encode(), offsets


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_A)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_B)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of size words of each text.

    A text with fewer words, but one at least, has one shingle of all its words; one without words has none.
    """
    import xxhash

    words, at = split_words(texts)
    own = np.array([xxhash.xxh64_intdigest(w.encode()) for w in words.dictionary.to_pylist()], np.uint64)
    h = own[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(h) - size + 1, 0), np.uint64)
        for k in range(size):
            rolled = rolled * np.uint64(STEP) + h[k : k + len(rolled)]
        rolled = mixed(rolled)
        out = []
        for a, b in zip(at, at[1:]):
            if b - a >= size:
                out.append(np.unique(rolled[a : b - size + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for x in h[a:b]:
                    short = short * np.uint64(STEP) + x
                out.append(mixed(np.array([short])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def in_groups(batch: pa.RecordBatch, column: int, most: int = 2 << 20):
    """Slices of the batch with about most bytes of text each, so that very long texts don't meet in memory."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    group = np.cumsum(size) // most
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        yield batch.slice(at[0], len(at))


def give_back() -> None:
    """Returns memory that this process no longer uses: Python workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with its memory given back when the task ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def spread(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the lists of the codes one after another, offsets of each): list k is flat[starts[k] : starts[k] + sizes[k]]."""
    n = sizes[codes]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - (ends - n), n)
    return flat[at], np.r_[0, ends]


class IdCache:
    """Token ids of words that a worker has met, in one growing array; learn gives the id lists of new words.

    Over most words it starts anew, so that a worker's memory stays bounded.
    """

    def __init__(self, learn: Callable[[list[str]], list], most: int):
        self.learn, self.most = learn, most
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def codes(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words, for spread."""
        if len(self.code) > self.most:
            self.clear()
        new = [w for w in words if w not in self.code]
        if new:
            made = self.learn(new)
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            own = np.fromiter((i for x in made for i in x), np.int32, int(sizes.sum()))
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes]
            self.sizes, self.flat = np.r_[self.sizes, sizes], np.r_[self.flat, own]
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
        return np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))

    def lists(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return spread(self.flat, self.starts, self.sizes, codes)
