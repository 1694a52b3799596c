"""Hashed word shingles of whole texts, in numpy over chunks of documents. Words are `[^\\x20\\x09-\\x0D]+`, with A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20240607)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_HEADS = (np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)) - np.uint64(1)  # masks of the first 0 to 7 bytes
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text hashed at a time, at least one document.
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then those of the next."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    ends = np.cumsum(sizes)
    sizes, ends, starts = sizes[sizes > 0], ends[sizes > 0], starts[sizes > 0]
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(out)


def string_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty string of data: its lanes of eight bytes are mixed by place, summed and mixed with the length.
    No power of a base is in it, so strings that follow a pattern are no likelier to meet than others. data has 8 bytes behind the last string."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    wide = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    lanes = (lengths + 7) >> 3
    first = np.cumsum(lanes) - lanes
    lane = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
    value = wide[np.repeat(starts, lanes) + 8 * lane]
    tail = lengths & 7
    short = tail > 0
    value[(first + lanes - 1)[short]] &= _HEADS[tail[short]]
    value = mixed(value ^ mixed((lane + 1).astype(np.uint64) * _GOLDEN))
    return mixed(np.add.reduceat(value, first) + lengths.astype(np.uint64) * _GOLDEN)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= CHUNK:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word, in order."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)]
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    hashes = string_hashes(data, starts, ends - starts)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return hashes, np.searchsorted(begins, starts, "right") - 1


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: of `width` words each, or one of all words where there are fewer."""
    for begin, end in chunks(texts):
        part = texts[begin:end]
        words, doc = word_hashes(part)
        counts = np.bincount(doc, minlength=len(part))
        at = np.concatenate([[0], np.cumsum(counts)])
        n = max(0, len(words) - width + 1)
        total = np.zeros(n, np.uint64)
        for k in range(width):
            total += words[k : k + n] * _PLACE[k]
        total = mixed(total)
        for i, count in enumerate(counts):
            if count >= width:
                own = np.sort(total[at[i] : at[i + 1] - width + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif count:
                own = words[at[i] : at[i + 1]] * _PLACE[:count]
                yield mixed(own.sum(dtype=np.uint64, keepdims=True) + _PLACE[32 + count : 33 + count])
            else:
                yield np.zeros(0, np.uint64)
