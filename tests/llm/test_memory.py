"""Python workers give back what a task freed."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import common, near_dedup, packing, quality, suffix_dedup


def test_a_task_gives_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    assert list(common.lean(lambda batches: batches)(iter([batch, batch]))) == [batch, batch] and calls == [1]

    def broken(batches):
        yield next(batches)
        raise ValueError("broken")

    with pytest.raises(ValueError):
        list(common.lean(broken)(iter([batch])))
    assert calls == [1, 1]


def test_stages_with_python_are_lean():
    for module in (near_dedup, packing, quality):
        text = open(module.__file__).read()
        assert text.count(".mapInArrow(") == text.count(".mapInArrow(lean(")
    common.give_back()


def test_runs_are_hashed_and_compared_in_pieces():
    text = np.random.default_rng(1).integers(0, 256, 80_000, dtype=np.uint8)
    size = np.full(2000, 8000)
    offset = np.arange(2000) % 9 * 8000  # 16 MB of runs, nine distinct ones
    tracemalloc.start()
    try:
        of, first = suffix_dedup.classes(text, size, offset)
        whole = suffix_dedup.gathered(text, offset, size)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(first) == 9 and (offset[first][of] == offset).all()
    assert (whole.reshape(2000, 8000) == text[: 9 * 8000].reshape(9, 8000)[np.arange(2000) % 9]).all()
    assert peak < 100 << 20


@pytest.mark.parametrize("n", [1, 2, 3])
def test_pieces_hold_every_run_once(monkeypatch, n):
    monkeypatch.setattr(suffix_dedup, "PIECE", 10)
    size = np.array([3, 7, 1, 30, 0, 10, 4, 4, 4])[: 3 * n]
    cuts = list(suffix_dedup.pieces(size))
    assert np.concatenate([np.arange(len(size))[x] for x in cuts]).tolist() == list(range(len(size)))
    assert all(size[x].sum() <= 10 or x.stop == x.start + 1 for x in cuts)


def test_repeated_passages_are_lean():
    text = open(suffix_dedup.__file__).read()
    assert text.count(".mapInArrow(") == text.count(".mapInArrow(lean(")
    assert text.count(".applyInArrow(") == text.count(".applyInArrow(lean_group(") == 4


def test_time_of_keys_does_not_grow_with_blocks_and_shards():
    """Nothing is done with all keys of a batch for each block or shard: both grow with the table."""
    letters = np.random.default_rng(2).integers(97, 123, (4000, 600), dtype=np.uint8)
    texts = [bytes(x) for x in np.concatenate([letters, letters[:, ::-1], letters])]

    def seconds(n: int) -> float:
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(np.arange(len(texts)) % n)], names=["doc_id", "text", "block"])
        took = []
        for _ in range(3):
            begin = time.process_time()
            list(suffix_dedup._keys(n)(iter([batch])))
            took.append(time.process_time() - begin)
        return min(took)

    assert seconds(3000) < 3 * seconds(10)


def test_tokens_of_blocks_are_distinct_and_sorted():
    block, tokens = np.array([3, 70_000, 3, 0, 3, 70_000]), np.array([1, 1, 1, 4, 9, 9], np.uint64)
    for many in (block, np.minimum(block, 9)):
        got = {b: np.frombuffer(x, np.uint64).tolist() for b, x in suffix_dedup.tokens_by(many, tokens)}
        assert got == {0: [4], 3: [1, 9], int(many.max()): [1, 9]}
    assert not list(suffix_dedup.tokens_by(block[:0], tokens[:0]))


def test_only_what_comes_back_is_kept(spark):
    docs = spark.createDataFrame([(i, "passage " * 20 + str(i)) for i in range(20)], "doc_id long, text string")
    with common.temporary():
        out = suffix_dedup.remove_repeats(docs)
        assert [x.names for x in common.Scratch.made] == [{"back"}]
        assert out.filter("n_removed > 0").count() == 19
