"""Packing by vector best-fit: every piece goes to the open sequence that it fits best under all of its capacities.

Tokenising runs in Arrow batches: the tokenizer drops blanks and never merges across them, so each distinct blank-free
word is encoded once per task and the rest is table look-up. Documents of more than `capacity` tokens are cut into full
pieces. Pieces are dealt at random into shards of about `shard_rows`, and each shard is packed by itself: items in the
order of decreasing tokens; residual capacities are vectors of tokens, documents and attention cost (the sum of squared
piece lengths), scaled by what a full sequence of such pieces holds; of the sequences that hold the item in every
dimension, the one with the least weighted norm of what would remain ("norm"), or the largest weighted dot product of item
and residual ("dot"), takes it. A shard wastes at
most about one open sequence of its thousand, so nothing larger than a shard ever meets in one task.

Edge cases: a null or empty text is one piece that holds only the end id; repeated rows are packed each; a null doc_id
stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, table

NAME = "op8_pack_sequences"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Distinct words in each of the two generations of a task's table.
MOST_WORDS = 500_000
#: Letters, then marks but no apostrophe: ASCII, and the precomposed letters U+00C0 to U+017F whose lower case is one letter too.
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]+)([!-&(-/:-@\\[-`{-~]*)")


#: Few ids as little-endian bytes, by their number.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def vocabulary() -> str:
    """The default tokenizer's file; callers may name another by path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, by a table of its blank-separated words.

    The table has two generations: a full one becomes the old one, whose words move back as they are met, so frequent
    words are never encoded again and memory is bounded. A new word of letters and the marks that end it is parted
    between them and lower-cased, as the tokenizer does, and its parts go to the tokenizer's model alone; so its many
    forms share their stem's ids. Other words go through the whole tokenizer."""

    def __init__(self, path: str, most: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.visible = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.young, self.old, self.stems = {}, {}, {}
        # only a tokenizer of this make may be parted into letters and marks
        probe = "Été, straße&&& x!! aBc ñandú."
        self.parts = b"".join(self._word(w) or b"" for w in probe.split()) == self._ids(self.tokenizer.encode(probe, add_special_tokens=False).ids)

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        words = text.split()  # bytes.split() parts at the six ASCII blanks only
        parts = list(map(self.young.get, words))
        if None in parts:
            new, at = [], -1
            for _ in range(parts.count(None)):
                new.append(at := parts.index(None, at + 1))
            fresh = self._learn({words[i] for i in new})
            for i in new:
                parts[i] = fresh[words[i]]
        return b"".join(parts)

    def _stem(self, stem: str) -> bytes:
        if not stem.isascii():
            stem = self.visible.pre_tokenize_str(stem)[0][0]
        return self._ids([t.id for t in self.model.tokenize(stem)])

    def _word(self, word: str) -> bytes | None:
        m = _WORD.fullmatch(word)
        if not m:
            return None
        out = b""
        for part in m.groups():
            if part:
                part = part.lower()
                if (x := self.stems.get(part)) is None:
                    x = self.stems[part] = self._stem(part)
                out += x
        return out

    def _learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        fresh, whole, stems, match = {}, [], self.stems, _WORD.fullmatch
        for w in new:
            x = self.old.get(w)
            if x is None and self.parts and (m := match(w.decode())):
                # _word(), with the parts that are known at hand
                x = b""
                for part in m.groups():
                    if part:
                        part = part.lower()
                        own = stems.get(part)
                        if own is None:
                            own = stems[part] = self._stem(part)
                        x += own
            if x is None:
                whole.append(w)
            else:
                fresh[w] = x
        if whole:
            for w, e in zip(whole, self.tokenizer.encode_batch_fast([w.decode() for w in whole], add_special_tokens=False)):
                fresh[w] = self._ids(e.ids)
        if len(self.stems) > self.most:
            self.stems = {}
        if len(self.young) + len(fresh) > self.most:
            self.young, self.old = {}, self.young
        self.young |= {w: x for w, x in fresh.items() if len(w) <= 64}
        return fresh


@functools.lru_cache(1)
def encoder_of(path: str) -> WordEncoder:
    """The encoder of this worker, which its tasks share one after the other."""
    return WordEncoder(path)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids = encoder.encode(text.as_py() or b"") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def vector_best_fit(tokens: np.ndarray, capacity: int, max_docs: int, max_attention: int, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item."""
    n, caps = len(tokens), np.array([capacity, max_docs, max_attention], float)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    demand = np.stack([tokens.astype(float), np.ones(n), tokens.astype(float) ** 2], 1)
    if n and (demand > caps).any():
        raise ValueError("a piece is larger than an empty sequence")
    # residuals count in shares of what a full sequence of these pieces holds, where that is less than the capacity
    usual = capacity / max(1.0, tokens.sum()) * demand.sum(0) if n else caps
    scale, w = 1 / np.minimum(caps, np.maximum(usual, 1.0)), np.array(weights)
    spare = np.maximum(caps - np.minimum(caps, np.maximum(usual, 1.0)), 0)
    room, ids, n_open, made = np.zeros((1024, 3)), np.zeros(1024, np.int64), 0, 0
    order = np.argsort(-tokens, kind="stable")
    least = demand[order[-1]] if n else None
    for i in order:
        need, best = demand[i], -1
        if n_open:
            fits = np.flatnonzero((room[:n_open] >= need).all(1))
            if len(fits):
                left = (room[fits] - spare) * scale
                score = (w * (left - need * scale) ** 2).sum(1) if rule == "norm" else -(w * left * (need * scale)).sum(1)
                best = fits[np.argmin(score)]
        if best < 0:
            if n_open == len(ids):
                room, ids = np.concatenate([room, np.zeros_like(room)]), np.concatenate([ids, np.zeros_like(ids)])
            best, room[n_open], ids[n_open] = n_open, caps, made
            n_open, made = n_open + 1, made + 1
        bins[i], offsets[i] = ids[best], capacity - room[best, 0]
        room[best] -= need
        if (room[best] < least).any():  # full: nothing that is left fits
            n_open -= 1
            room[best], ids[best] = room[n_open], ids[n_open]
    return bins, offsets


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, max_docs: int | None = None,
    max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm", shard_rows: int = 8192,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    max_docs and max_attention default to what `capacity` tokens can hold at most: then only tokens bind, and the other two
    choose among the sequences that hold a piece. shard_rows: pieces in a shard, about."""
    limits = (capacity, max_docs or capacity, max_attention or capacity**2)
    scratch = Scratch(docs.sparkSession)
    pieces = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(_pieces(tokenizer or vocabulary(), capacity, end_id)), PIECES)
    pieces = scratch.write(pieces, "pieces")  # tokenised once, and counted
    shards = max(1, -(-pieces.count() // shard_rows))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "ids_crc32"), F.lit(shards)))  # places in the written table part repeated rows

    def fill(group: pa.Table) -> pa.Table:
        bins, offsets = vector_best_fit(group["length"].to_numpy(), *limits, weights, rule)
        ids = (group["shard"].to_numpy() << 32) + bins
        return group.drop_columns(["shard"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return pieces.groupBy("shard").applyInArrow(fill, PACKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


ORACLE_SQL = None  # a tokenizer is not SQL: tests compare with direct encoding
