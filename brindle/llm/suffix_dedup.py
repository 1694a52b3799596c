"""Repeated-passage removal by suffix arrays: bytes covered by a 50-byte string that also starts in a document with a smaller doc_id.

Building one suffix array over a corpus is what must be avoided, so only strings that can repeat reach one:

1. Every 50-byte window has a key, the least hash of its 27 grams of 24 bytes, so equal windows have equal keys. Windows
   of a document with one key form a run (14 windows on average). Per batch of documents distinct keys are counted, and
   one packed entry per key and batch is exchanged; keys that more than one document has are candidates. Keys that very many
   batches have are split: their runs are parted again by a second key, the least hash of 11 grams of 40 bytes, and dealt by
   that, so that a phrase that a third of all documents have, each among other words, is no task's alone. There are at most
   MOST_SPLIT such keys, as each takes its share of all entries, and every task knows them.
2. Documents meet their candidate keys in blocks of doc_id. Of each candidate run a block sends the bytes that hold its
   windows, once for each distinct run in the block, with the smallest doc_id that has it: a passage that a third of all
   documents share is one entry a block.
3. Entries are dealt into shards by key. A shard sorts the suffixes of its distinct runs by Larsson-Sadakane refinement
   (ranks by 8 bytes, then doubled, groups that are sorted being left out), takes common prefixes by Kasai's bound in
   lanes, and cuts the array where they are shorter than 50: windows between two cuts are equal, and their smallest
   doc_id is the owner. What the blocks sent is merged by binary search of their runs in the shard's sorted distinct runs,
   and a key that has one distinct run is settled by that: only keys with several make up the suffix array, which is
   refined until 50 bytes decide.
4. Blocks get back owners smaller than their own, by the place of the run in the block, and cover bytes of all documents
   that come later than the owner.

Hashes only choose what is compared: windows are equal if their bytes are, and runs that are merged, in a block or in a
shard, are compared by bytes. Numbers of blocks, shards and partitions grow with the bytes of the table.

Edge cases: null texts count as empty; texts under 50 bytes lose nothing; a repeat inside one document is no repeat; rows
with the same doc_id are never removed for each other; rows with a null doc_id come after all others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, lean_group, partitions, table
from .shingles import CHUNK, chunks, mixed, ragged, string_hashes

NAME = "op1_suffix_dedup"
WINDOW, GRAM = 50, 24
SPAN = WINDOW - GRAM + 1
LAST = 2**63 - 1  # stands for a null doc_id
#: Keys that are split at most, and batches that have one at the fewest.
MOST_SPLIT, LEAST_SPLIT = 1_000_000, 64
LONG_GRAM = 40
#: Bytes of runs that are hashed or compared at a time, about: each takes some 30 bytes of memory meanwhile.
PIECE = 1 << 20
#: Bytes of text whose grams are hashed at a time.
TILE = 1 << 14
_LOW, _MANY = np.uint64((1 << 40) - 1), (1 << 24) - 1
_rng = np.random.default_rng(19)
_K = _rng.integers(1, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, with room for reading past the end, and where each text begins."""
    begins = np.cumsum([0] + [len(t) for t in texts])
    return np.frombuffer(b"".join(texts) + bytes(64), np.uint8), begins


def gram_hashes(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hashes of grams of 24 bytes, given as three lanes."""
    out = a * _K[0]
    out += b * _K[1]
    out += c * _K[2]
    out ^= out >> np.uint64(29)
    out *= _K[3]
    out ^= out >> np.uint64(32)
    return out


def first_keys(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Keys of the windows that begin at start."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    least = np.full(len(start), 2**64 - 1, np.uint64)
    for k in range(SPAN):
        np.minimum(least, gram_hashes(words[start + k], words[start + k + 8], words[start + k + 16]), out=least)
    return least


def runs(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start, number of windows and key of each run of windows with one key."""
    n = int(begins[-1])
    none = np.zeros(0, np.int64)
    lengths = np.diff(begins)
    if not (lengths >= WINDOW).any():
        return none, none, none, none.view(np.uint64)
    words = np.ndarray((n + 32,), "<u8", data, strides=(1,))
    key, first = np.empty(n - SPAN + 1, np.uint64), np.ones(n - SPAN + 1, bool)
    for begin in range(0, len(key), TILE):  # what a tile needs stays in a core's cache
        end = min(begin + TILE, len(key))
        stop = end + SPAN - 1
        least = gram_hashes(words[begin:stop], words[begin + 8 : stop + 8], words[begin + 16 : stop + 16])
        reach = 1
        while reach < SPAN:  # the least of the next SPAN grams, by doubling
            step = min(reach, SPAN - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        key[begin:end] = least
        before = max(begin, 1)
        np.not_equal(key[before:end], key[before - 1 : end - 1], out=first[before:end])
    for_text = np.flatnonzero(lengths >= WINDOW)
    text_begin, text_end = begins[for_text], begins[for_text + 1] - WINDOW + 1  # where windows begin
    first[text_begin] = True
    for a, b in zip(text_end.tolist(), [*text_begin[1:].tolist(), len(first)]):
        first[a:b] = False
    first[: text_begin[0]] = False
    start = np.flatnonzero(first)
    text = np.repeat(np.arange(len(for_text)), np.diff(np.searchsorted(start, [*text_begin, len(first)])))
    return for_text[text], start, np.minimum(np.append(start[1:], len(first)), text_end[text]) - start, key[start]


def split_runs(data: np.ndarray, begins: np.ndarray, shards: int, split: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start, number of windows, token and shard of each run, those of `split` tokens (sorted) parted by their second key."""
    doc, start, n_windows, key = runs(data, begins)
    t = token(key, shards)
    shard = (t >> np.uint64(40)).astype(np.int64)
    if not len(split) or not len(t):
        return doc, start, n_windows, t, shard
    own = split[np.minimum(np.searchsorted(split, t), len(split) - 1)] == t
    if not own.any():
        return doc, start, n_windows, t, shard
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    window, run = ragged(start[own], n_windows[own]), np.repeat(np.flatnonzero(own), n_windows[own])
    least = np.full(len(window), 2**64 - 1, np.uint64)
    for k in range(WINDOW - LONG_GRAM + 1):
        gram = gram_hashes(words[window + k], words[window + k + 8], words[window + k + 16])
        np.minimum(least, mixed(gram ^ words[window + k + 24] * _K[1] + words[window + k + 32] * _K[2]), out=least)
    cut = np.ones(len(window), bool)
    cut[1:] = (least[1:] != least[:-1]) | (run[1:] != run[:-1])
    at = np.flatnonzero(cut)
    of, rest = run[at], np.flatnonzero(~own)
    starts, sizes = np.concatenate([start[rest], window[at]]), np.concatenate([n_windows[rest], np.diff([*at, len(window)])])
    order = np.argsort(starts, kind="stable")
    of = np.concatenate([rest, of])[order]
    shard = np.concatenate([shard[rest], (mixed(least[at]) % np.uint64(shards)).astype(np.int64)])[order]
    return doc[of], starts[order], sizes[order], t[of], shard


def pieces(size: np.ndarray) -> Iterator[slice]:
    """Consecutive runs of about PIECE bytes in all, one at least."""
    total, begin = np.cumsum(size), 0
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] - size[begin] + PIECE, "right")))
        yield slice(begin, end)
        begin = end


def gathered(data: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of runs, one after the other."""
    return np.concatenate([np.zeros(0, np.uint8), *(data[ragged(offset[some], size[some])] for some in pieces(size))])


def unlike(data: np.ndarray, size: np.ndarray, offset: np.ndarray, at: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Whether the runs `at` differ in their bytes from the runs `head`."""
    out = size[at] != size[head]
    even = np.flatnonzero(~out)
    for some in pieces(size[at[even]]):
        own = even[some]
        n = size[at[own]]
        other = data[ragged(offset[at[own]], n)] != data[ragged(offset[head[own]], n)]
        if other.any():
            out[own] = np.add.reduceat(other, np.cumsum(n) - n) > 0
    return out


def classes(data: np.ndarray, size: np.ndarray, offset: np.ndarray, first_by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each run the index of its class, and of each class its first run (by first_by): runs are one class if their bytes are equal.
    Each run's hash is looked up in the sorted distinct ones, and its bytes are compared with those of the first run that has it."""
    name = np.concatenate([np.zeros(0, np.uint64), *(string_hashes(data, offset[some], size[some]) for some in pieces(size))])
    order = np.argsort(name) if first_by is None else np.lexsort((first_by, name))
    new = np.ones(len(order), bool)
    new[1:] = name[order][1:] != name[order][:-1]
    distinct, first = name[order[new]], order[new]
    of = np.searchsorted(distinct, name)
    at = np.flatnonzero(first[of] != np.arange(len(of)))
    more = at[unlike(data, size, offset, at, first[of[at]])]
    if len(more):  # other runs with the same hash are classes of their own
        of[more] = len(first) + np.arange(len(more))
        first = np.concatenate([first, more])
    return of, first


_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()  # one of each a worker: making one takes longer than a small packet


def packed(x: np.ndarray) -> bytes:
    """What is exchanged of an array; doc_ids, places and text shrink further than an exchange's own codec makes them."""
    return _pack.compress(np.ascontiguousarray(x).data) if len(x) else _pack.compress(b"")


def unpacked(column: pa.ChunkedArray, kind, behind: int = 0) -> np.ndarray:
    """What packed() made of arrays, one after the other, and so many zero bytes behind them."""
    return np.frombuffer(b"".join([*map(_unpack.decompress, column.to_pylist()), bytes(behind)]), kind)


def token(key: np.ndarray, shards: int) -> np.ndarray:
    """What is exchanged of a key: its shard and its lower 40 bits."""
    return ((key >> np.uint64(40)) % np.uint64(shards)) << np.uint64(40) | (key & _LOW)


def order_of(values: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers from 0."""
    return np.argsort(values.astype(np.uint16) if len(values) and values.max() < 1 << 16 else values, kind="stable")


def stretches(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each distinct value of sorted ones and where it is."""
    if len(values):
        cuts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
        yield from zip(values[cuts].tolist(), map(slice, cuts.tolist(), [*cuts[1:].tolist(), len(values)]))


def tokens_by(block: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Each block and its distinct tokens; tokens are sorted. Blocks are many, so nothing is done with all tokens for each of them."""
    order = order_of(block)
    block, tokens = block[order], tokens[order]
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (tokens[1:] != tokens[:-1])
    block, tokens = block[new], tokens[new]
    for b, own in stretches(block):
        yield b, tokens[own].tobytes()


def refined(text: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, by Larsson-Sadakane refinement until every one has its place, or until `depth` bytes decide;
    and whether each place in it ties with the one before in so many bytes. A suffix that ends comes before one that goes on."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    left = np.minimum(n - np.arange(n), 7).astype(np.uint64)  # seven bytes, then how many of them are the text's
    head = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64) & ~np.uint64(255) | left
    order = np.argsort(head)
    value = head[order]
    new = np.ones(n, bool)
    new[1:] = value[1:] != value[:-1]
    rank = np.empty(n, np.int64)
    place = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is the place of its first
    rank[order] = place
    h = 7
    while depth is None or h < depth:
        same = ~new  # places in groups that are not sorted yet
        same[:-1] |= ~new[1:]
        at = np.flatnonzero(same)
        if not len(at):
            break
        own = order[at]
        behind = own + h
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        group = place[at]
        by = np.argsort(group * (n + 1) + second)
        own, second = own[by], second[by]
        order[at] = own
        fresh = np.ones(len(at), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        new[at] = fresh
        place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[at]] = place[at]
        h *= 2
    return order, ~new


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes."""
    return refined(text)[0]


def common_prefixes(text: np.ndarray, order: np.ndarray, tied: np.ndarray | None = None, most: int = WINDOW, lane: int = 64) -> np.ndarray:
    """Of each place in the order, bytes shared with the one before, at most `most`: Kasai's bound along lanes of the text.

    tied: places known to share at least `most`. The order among them is not that of the text, so the bound does not go on from them."""
    n = len(text)
    wide = np.ndarray((n + 1,), "<u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,))
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    full = np.zeros(n, bool)
    if tied is not None:
        full[order] = tied
    out = np.zeros(n, np.int64)
    begins = np.arange(0, n, lane)
    have, was_full = np.zeros(len(begins), np.int64), np.zeros(len(begins), bool)
    for step in range(lane):
        p = begins + step
        if p[-1] >= n:
            begins, have, was_full, p = begins[:-1], have[:-1], was_full[:-1], p[:-1]
            if not len(p):
                break
        q = before[p]
        have = np.where((q >= 0) & ~was_full, np.maximum(have - 1, 0), 0)
        was_full = full[p]
        have[was_full] = most
        live = np.flatnonzero((q >= 0) & (have < most))
        room = np.minimum(n - np.maximum(p, q), most)
        while len(live):  # eight bytes at a time
            differ = wide[p[live] + have[live]] ^ wide[q[live] + have[live]]
            even = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3
            have[live] = np.minimum(have[live] + even, room[live])
            live = live[(even == 8) & (have[live] < room[live])]
        out[p] = have
    return out[order]


def owners(data: np.ndarray, start: np.ndarray, n_windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each window of each run in data, one run after the other, the smallest doc of any equal window."""
    order, tied = refined(data, WINDOW)
    group = np.cumsum(common_prefixes(data, order, tied) < WINDOW)  # of each place in the order
    of = np.empty(len(data), np.int64)
    of[order] = group
    windows, owner = ragged(start, n_windows), np.repeat(doc, n_windows)
    of = of[windows]
    by = np.argsort(of)
    g = of[by]
    first = np.concatenate([[True], g[1:] != g[:-1]])
    least = np.minimum.reduceat(owner[by], np.flatnonzero(first))
    out = np.empty(len(windows), np.int64)
    out[by] = least[np.cumsum(first) - 1]
    return out


def _texts(batch) -> list[bytes]:
    column = batch.column("text").cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def _ids(batch) -> np.ndarray:
    return batch.column("doc_id").fill_null(LAST).to_numpy()


def _chunks(batch) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's texts of about CHUNK bytes."""
    size = pc.binary_length(batch.column("text").cast(pa.binary())).fill_null(0).to_numpy()
    total, begin = np.cumsum(size + 1), 0
    while begin < len(size):
        end = min(len(size), int(np.searchsorted(total, total[begin] - size[begin] - 1 + CHUNK)) + 1)
        yield begin, end
        begin = end


def _keys(shards: int):
    """Step 1: per batch and shard, packed entries of key and block; and, for keys that several documents of the batch have, tokens for their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, found = batch.column("block").to_numpy(), []
            for begin, end in _chunks(batch):
                data, begins = joined(_texts(batch.slice(begin, end - begin)))
                doc, _, _, key = runs(data, begins)
                found.append((token(key, shards), (doc + begin).astype(np.int32)))
            key = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in found)])
            doc = np.concatenate([np.zeros(0, np.int32), *(x for _, x in found)])
            del found
            order = np.argsort(key, kind="stable")  # documents stay in order
            key, doc = key[order], doc[order]
            del order
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            if not once.all():
                key, doc = key[once], doc[once]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            size = np.diff(np.concatenate([np.flatnonzero(first), [len(key)]]))
            several = np.repeat(size > 1, size)
            block = np.where(several, _MANY, blocks[doc])
            rows = []
            entry = (key & _LOW) << np.uint64(24) | block.astype(np.uint64)
            entry = entry[first]
            for s, own in stretches((key[first] >> np.uint64(40)).astype(np.int64)):
                rows.append((s, -1, entry[own].tobytes()))
            for b, data in tokens_by(blocks[doc[several]].astype(np.int64), key[several]):
                rows.append((-1 - b % shards, b, data))
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["shard", "block", "data"])

    return run


COUNTED = "block long, data binary, entries long, batches binary"


def _candidates(least_split: int):
    """Step 1, per shard: tokens for the blocks of keys that more than one batch has; tokens that have a block go through. And a row
    of block -1: how many entries there were, the tokens that `least_split` batches have, and how many batches each."""

    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        if shard < 0:
            return group.select(["block", "data"]).append_column("entries", pa.nulls(group.num_rows, pa.int64())).append_column("batches", pa.nulls(group.num_rows, pa.binary()))
        entry = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group["data"]])
        entry = np.sort(entry)
        key = entry >> np.uint64(24)
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff([*begins, len(key)])
        same = np.repeat(size > 1, size)
        block = (entry & np.uint64(_MANY)).astype(np.int64)
        same &= block != _MANY
        often = size >= least_split
        rows = [(-1, (key[begins[often]] | np.uint64(shard << 40)).tobytes(), len(entry), size[often].astype(np.int64).tobytes())]
        key, block = key[same] | np.uint64(shard << 40), block[same]
        for b, data in tokens_by(block, key):
            rows.append((b, data, None, None))
        columns = list(zip(*rows))
        return pa.table({x.split()[0]: pa.array(c, pa.binary() if i % 2 else pa.int64()) for i, (x, c) in enumerate(zip(COUNTED.split(", "), columns))})

    return run


def split_tokens(found: DataFrame, most: int = MOST_SPLIT) -> np.ndarray:
    """Tokens of keys that are split: all that LEAST_SPLIT batches have, and a share of 1 / most of all entries, so at most `most`."""
    counted = found.filter("block = -1")
    total = counted.agg(F.sum("entries")).first()[0] or 0
    each = counted.filter(F.octet_length("data") > 0)

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, n in zip(batch.column(0), batch.column(1)):
                out.append(np.frombuffer(data.as_py(), np.uint64)[np.frombuffer(n.as_py(), np.int64) * most >= total].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["data"])

    rows = each.select("data", "batches").mapInArrow(lean(enough), "data binary").filter(F.octet_length("data") > 0).toArrow()  # `most` tokens at most
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_py(), np.uint64) for x in rows["data"])]))


SENT = "shard long, block long, places binary, docs binary, sizes binary, data binary"


def _in_order(docs: pa.Table) -> pa.Table:
    """A block's documents in an order that every task finds again; equal rows are interchangeable."""
    return docs.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def _send(shards: int, split: np.ndarray):
    """Step 2, per block: its distinct candidate runs, by shard. A run's place is its number among all runs of the block."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows and found.num_rows:
            wanted = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in found["data"]]))
            docs = _in_order(docs)
            texts, ids, block = _texts(docs), _ids(docs), docs["block"][0].as_py()
            parts, done = [], 0
            for begin, end in chunks(texts):
                data, begins = joined(texts[begin:end])
                doc, start, n_windows, t, shard = split_runs(data, begins, shards, split)
                own = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, t), len(wanted) - 1)] == t)
                if len(own):
                    start, n_windows = start[own], n_windows[own]
                    parts.append((own + done, ids[doc[own] + begin], n_windows, shard[own], gathered(data, start, n_windows + WINDOW - 1)))
                done += len(t)
            if parts:
                place, doc, n_windows, shard, data = (np.concatenate(x) for x in zip(*parts))
                size = n_windows + WINDOW - 1
                offset = np.cumsum(size) - size
                _, own = classes(np.concatenate([data, np.zeros(8, np.uint8)]), size, offset, doc)  # of each distinct run, that of the smallest doc_id
                own = np.sort(own)
                own = own[order_of(shard[own])]
                place, doc, n_windows, shard = place[own].astype(np.uint32), doc[own], n_windows[own].astype(np.uint32), shard[own]
                data, ends = gathered(data, offset[own], size[own]), np.concatenate([[0], np.cumsum(size[own])])
                for s, at in stretches(shard):
                    rows.append((s, block, packed(place[at]), packed(doc[at]), packed(n_windows[at]), packed(data[ends[at.start] : ends[at.stop]])))
        columns = list(zip(*rows)) or [[]] * 6
        return pa.table({x.split()[0]: pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, (x, c) in enumerate(zip(SENT.split(", "), columns))})

    return run


BACK = "block long, places binary, begins binary, ends binary, owners binary"


def _resolve(group: pa.Table) -> pa.Table:
    """Step 3, per shard: owners of windows, for blocks whose own smallest doc_id is larger."""
    places = [_unpack.decompress(x) for x in group["places"].to_pylist()]
    block, place = np.repeat(group["block"].to_numpy(), [len(x) // 4 for x in places]), np.frombuffer(b"".join(places), np.uint32)
    doc, n_windows = unpacked(group["docs"], np.int64), unpacked(group["sizes"], np.uint32).astype(np.int64)
    data = unpacked(group["data"], np.uint8, 8)
    size = n_windows + WINDOW - 1
    offset = np.cumsum(size) - size
    of, first = classes(data, size, offset)  # merged by binary search in the sorted distinct runs
    least = np.full(len(first), LAST, np.int64)
    np.minimum.at(least, of, doc)
    # a key's only run meets itself alone; the runs of the others make up the suffix array
    _, key_of, n_key = np.unique(first_keys(data, offset[first]), return_inverse=True, return_counts=True)
    many = n_key[key_of] > 1
    alone, several = np.flatnonzero(~many), np.flatnonzero(many)
    s_run, s_begin, s_end, s_owner = alone, np.zeros(len(alone), np.int64), n_windows[first[alone]], least[alone]
    if len(several):
        runs_ = first[several]
        begin = np.cumsum(size[runs_]) - size[runs_]
        owner = owners(gathered(data, offset[runs_], size[runs_]), begin, n_windows[runs_], least[several])
        # stretches of one owner in each distinct run
        run_of = np.repeat(several, n_windows[runs_])
        at_window = ragged(np.zeros(len(runs_), np.int64), n_windows[runs_])
        cut = np.ones(len(owner), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (run_of[1:] != run_of[:-1])
        at = np.flatnonzero(cut)
        s_run, s_begin, s_owner = np.concatenate([s_run, run_of[at]]), np.concatenate([s_begin, at_window[at]]), np.concatenate([s_owner, owner[at]])
        s_end = np.concatenate([s_end, at_window[at[1:] - 1] + 1, at_window[-1:] + 1])
        by = np.argsort(s_run, kind="stable")
        s_run, s_begin, s_end, s_owner = s_run[by], s_begin[by], s_end[by], s_owner[by]
    n_of = np.bincount(s_run, minlength=len(first))
    s_first = np.cumsum(n_of) - n_of
    entry = np.repeat(np.arange(len(of)), n_of[of])
    stretch = ragged(s_first[of], n_of[of])
    less = s_owner[stretch] < doc[entry]
    entry, stretch = entry[less], stretch[less]
    by, rows = order_of(block[entry]), []
    entry, stretch = entry[by], stretch[by]
    sent = place[entry], s_begin[stretch].astype(np.uint32), s_end[stretch].astype(np.uint32), s_owner[stretch]
    for b, own in stretches(block[entry]):
        rows.append((b, *(packed(x[own]) for x in sent)))
    columns = list(zip(*rows)) or [[]] * 5
    return pa.table({x.split()[0]: pa.array(c, pa.binary() if i else pa.int64()) for i, (x, c) in enumerate(zip(BACK.split(", "), columns))})


def _remove(docs: pa.Table, back: pa.Table, shards: int, split: np.ndarray) -> pa.Table:
    """Step 4, per block: what is left of each document."""
    out: list[tuple] = []
    if docs.num_rows:
        docs = _in_order(docs)
        texts, ids, raw_ids = _texts(docs), _ids(docs), docs["doc_id"].to_pylist()
        parts = []
        for begin, end in chunks(texts):
            data, begins = joined(texts[begin:end])
            doc, start, n_windows, _, _ = split_runs(data, begins, shards, split)
            parts.append((begin, end, begins, start, n_windows, ids[doc + begin], data))
        start = np.concatenate([p[3] + at for p, at in zip(parts, np.cumsum([0] + [len(p[6]) for p in parts]))])
        n_windows, doc_ids = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
        of, first = classes(np.concatenate([p[6] for p in parts]), n_windows + WINDOW - 1, start, doc_ids)
        local = doc_ids[first][of] if len(of) else doc_ids  # the smallest doc_id of the block that has this run
        b_of = of[unpacked(back["places"], np.uint32)]
        by = np.argsort(b_of, kind="stable")
        b_of, b_begin, b_end, b_owner = b_of[by], unpacked(back["begins"], np.uint32)[by].astype(np.int64), unpacked(back["ends"], np.uint32)[by].astype(np.int64), unpacked(back["owners"], np.int64)[by]
        n_back = np.bincount(b_of, minlength=len(first))
        b_first = np.cumsum(n_back) - n_back
        done = 0
        for begin, end, begins, start, n_windows, own, _ in parts:
            edge = np.zeros(int(begins[-1]) + 1, np.int32)
            mine = slice(done, done + len(own))
            done += len(own)
            late = local[mine] < own
            np.add.at(edge, start[late], 1)
            np.add.at(edge, start[late] + n_windows[late] + WINDOW - 1, -1)
            sizes = n_back[of[mine]]
            run, s = np.repeat(np.arange(len(own)), sizes), ragged(b_first[of[mine]], sizes)
            less = b_owner[s] < own[run]
            run, s = run[less], s[less]
            np.add.at(edge, start[run] + b_begin[s], 1)
            np.add.at(edge, start[run] + b_end[s] + WINDOW - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            data = np.frombuffer(b"".join(texts[begin:end]), np.uint8)
            for i in range(end - begin):
                a, b = int(begins[i]), int(begins[i + 1])
                g = gone[a:b]
                n_gone = int(g.sum())
                kept = texts[begin + i] if not n_gone else data[a:b][~g].tobytes()
                spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if n_gone else 0
                out.append((raw_ids[begin + i], b - a, n_gone, spans, hashlib.sha256(kept).hexdigest(), kept))
    columns = list(zip(*out)) or [[]] * 6
    kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary())
    return pa.table({n: pa.array(c, k) for n, c, k in zip((*[x.split()[0] for x in RESULT.split(", ")], "kept_bytes"), columns, kinds)})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False, block_docs: int = 1024, block_bytes: int = 4 << 20, least_split: int = LEAST_SPLIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_bytes also kept_bytes, what is left.

    block_docs, block_bytes: documents and bytes in a block, about; blocks are what a task holds in memory. least_split: batches
    that have a key before it is split, at the fewest."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    n_docs, n_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = min(max(partitions(spark), n_docs // block_docs, n_bytes // block_bytes), _MANY - 1)
    shards = min(max(4 * partitions(spark), n_bytes // block_bytes), (1 << 23) - 1)
    parts = n_bytes // (32 * block_bytes)

    def dealt(df: DataFrame, by: str) -> DataFrame:
        """As many partitions as the bytes need, where the session's are too few."""
        return df.repartition(parts, by) if parts > partitions(spark) else df

    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))), F.lit(blocks)))
    found = rows.mapInArrow(lean(_keys(shards)), "shard long, block long, data binary")
    found = scratch.write(dealt(found, "shard").groupBy("shard").applyInArrow(lean_group(_candidates(least_split)), COUNTED), "found")
    split = split_tokens(found)
    found = found.filter("block >= 0").select("block", "data")
    by_block = dealt(rows, "block").groupBy("block")
    sent = scratch.write(by_block.cogroup(dealt(found, "block").groupBy("block")).applyInArrow(lean_group(_send(shards, split)), SENT), "sent")
    back = scratch.write(dealt(sent, "shard").groupBy("shard").applyInArrow(lean_group(_resolve), BACK), "back")
    scratch.keep("back")  # what the blocks sent, twice on disk until now, is gone before the documents are exchanged again
    kinds = RESULT + (", kept_bytes binary" if keep_bytes else "")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _remove(left, right, shards, split)
        return out if keep_bytes else out.drop_columns(["kept_bytes"])

    return by_block.cogroup(dealt(back, "block").groupBy("block")).applyInArrow(lean_group(finish), kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE_SQL = None  # every 50-byte string of every text is too slow in SQL: tests compare with brute force
