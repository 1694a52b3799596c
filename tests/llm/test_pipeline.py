"""The pipeline: shapes of the stages, and each stage's rows against brute force on its own input."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd

import corpus_pipeline
from brindle.llm import mixing, quality
from brindle.llm.common import Scratch, table

from .test_exactness import linked

BLANKS = re.compile(r"[\x20\x09-\x0D]")


def stages(spark, docs, sf_dir):
    scratch, out = Scratch(spark), [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(scratch.write(stage(spark, out[-1], sf_dir), name))
    return out


def refit(docs: pd.DataFrame, labels: pd.DataFrame) -> dict:
    """The classifier in plain numpy: pairs, gradient steps and quantile, on all labelled rows that may be learnt from."""
    known = labels.dropna(subset=["doc_id"]).groupby("doc_id").quality.min()
    known = known[[zlib.crc32(str(i).encode()) % 5 != 0 for i in known.index]]
    texts = docs.drop_duplicates("doc_id").set_index("doc_id").text
    at = [i for i in sorted(known.index) if i in texts.index]
    x = {q: quality.features([texts[i].encode() for i in at if known[i] == q]) for q in (0, 1)}
    model = quality.fit(x[1], x[0], (known == 0).mean())
    features = quality.features([(t or "").encode() for t in docs.text])
    return dict(zip(docs.doc_id, model.score(features)))


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    all_ = stages(spark, docs, sf_dir)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(d.columns == docs.columns for d in all_[:-1])
    given, good, distinct, apart, mixed, packed = (d.toPandas() for d in all_)
    assert packed.columns[:5].tolist() == ["doc_id", "piece", "start", "length", "ids_crc32"]

    scores = refit(given, pd.read_parquet(f"{sf_dir}/labels.parquet"))
    near_cut = {i for i, s in scores.items() if abs(s - 0.3) < 1e-6}
    assert set(good.doc_id) - near_cut == {i for i, s in scores.items() if s >= 0.3} - near_cut and 0 < len(good) < len(given)

    groups = defaultdict(list)
    for i, text in zip(good.doc_id, good.text):
        groups[BLANKS.sub("", text)].append((-len(text), i))
    assert set(distinct.doc_id) == {min(g)[1] for g in groups.values()}

    assert set(apart.doc_id) == {i for i, (_, c) in linked(distinct, 5).items() if i == c}

    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix(all_[3]).collect()}
    assert mixed.doc_id.value_counts().to_dict() == {i: n for i, n in taken.items() if n}
    words = lambda d: d.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))).sum()
    assert abs(words(mixed) / words(apart) - 1.5) < 0.2

    whole = packed[packed.piece == 0].doc_id.value_counts()
    assert whole.to_dict() == mixed.doc_id.value_counts().to_dict()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096


def test_run_is_the_last_stage(spark, sf_dir):
    key = lambda d: sorted(map(tuple, d.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages(spark, table(spark, sf_dir, "documents"), sf_dir)[-1])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size long, n long, key long, open boolean, label string, score double, comp long, rep long"


def odd(spark, rows, tmp_path, labels=()):
    path = tmp_path / "sf"
    spark.createDataFrame([(*r, *([None] * 10)) for r in rows], SCHEMA).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_odd_rows_pass(spark, tmp_path):
    long_ = " ".join(f"w{i % 991}" for i in range(30_000))
    rows = [(1, "one text of a few words here", "en", "a"), (1, "one text of a few words here", "en", "a"), (None, "a text without a name at all", "en", None), (None, "a text without a name at all", "en", None), (2, None, None, None), (3, "", "en", "b"), (4, long_, "en", "c")]
    sf = odd(spark, rows, tmp_path, [(1, 1, 0), (None, 0, 0)])
    all_ = stages(spark, table(spark, sf, "documents"), sf)
    assert all(d.columns == all_[0].columns for d in all_[:-1])
    counts = [d.count() for d in all_[:4]]
    assert counts == [7, 7, 4, 4]  # of the copies of 1 and of the nameless one stays each, and one empty text
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_no_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd(spark, [], tmp_path)).count() == 0


def test_only_empty_texts(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd(spark, [(1, None, None, "a"), (2, "", None, "a"), (3, " \n", None, None)], tmp_path)).count() == 0


def test_fit_is_the_mean_over_pairs():
    """Rows that one feature tells apart: the loss has its minimum where the gradient of the pairs is that of the penalty."""
    rng = np.random.default_rng(1)
    good, bad = rng.normal(size=(400, 3)) + [2.0, 0, 0], rng.normal(size=(400, 3))
    model = quality.fit(good, bad, 0.5)
    assert model.weights[0] > 5 * abs(model.weights[1:]).max()
    right = np.concatenate([model.score(good) >= 0.3, model.score(bad) < 0.3]).mean()
    assert right > 0.8 and abs((model.score(np.concatenate([good, bad])) < 0.3).mean() - 0.5) < 0.01
