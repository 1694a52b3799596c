"""Quality classifier: Bradley-Terry pairwise ranking on surface features of whole texts.

A labelled good document should beat a labelled bad one: P(i beats j) = sigmoid(w . (x_i - x_j)). w minimises the mean
logistic loss over such preference pairs, with an L2 term. The threshold is a quantile of the labelled scores, weighted
back to the whole labelled table: the level is the share of bad labels there. A slope fitted to the same pairs turns the
distance from the threshold into a score of 0 to 1, with the threshold at `cut`.

Fitting uses a bounded sample of labelled rows, at most `most_per_label` of each label by hash order of doc_id; scoring
covers every whole text, in Arrow batches, with weights of fixed size. Features: rates of single ASCII marks, character
classes, word lengths and endings, and shares of distinct words and four-word runs.

Edge cases: null texts count as empty and get a score like any other; rows with a null doc_id are scored and never
learnt from; of labels that repeat a doc_id the lowest counts; without labels of both kinds all scores are 0.5; repeated rows score alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table
from .shingles import chunks, mixed, word_hashes

NAME = "op5_quality_scores"
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 blank, 5 newline, 6 not ASCII, 7 mark
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[128:], _CLASS[_MARKS] = 1, 2, 3, 4, 5, 6, 7
_ENDS_WELL = np.zeros(256, bool)  # letters, digits and the marks that end words in prose
_ENDS_WELL[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b".,;:!?)\"'"]] = True
N_FEATURES = len(_MARKS) + 8 + 10


def features(texts: list[bytes]) -> np.ndarray:
    """One row of features per text."""
    out = np.zeros((len(texts), N_FEATURES))
    for begin, end in chunks(texts):
        part = texts[begin:end]
        words, doc = word_hashes(part)
        data = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        blank = (_CLASS[data] == 4) | (_CLASS[data] == 5)
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        lengths, last = (ends - starts).astype(float), _ENDS_WELL[data[ends - 1]]
        runs = mixed(words[:-3] * np.uint64(3) + words[1:-2] * np.uint64(5) + words[2:-1] * np.uint64(7) + words[3:] * np.uint64(11)) if len(words) > 3 else words[:0]
        at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(part)))])
        for i, text in enumerate(part):
            own = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            n, (a, b) = max(1, len(text)), at[i : i + 2]
            row, k = out[begin + i], b - a
            row[: len(_MARKS)] = np.log1p(1000 * own[_MARKS] / n)
            row[len(_MARKS) : len(_MARKS) + 8] = np.bincount(_CLASS, weights=own, minlength=8) / n
            if k:
                size = lengths[a:b]
                row[-10:-4] = size.mean(), size.std(), last[a:b].mean(), (size == 1).mean(), len(np.unique(words[a:b])) / k, np.log1p(k)
                row[-4] = len(np.unique(runs[a : b - 3])) / (k - 3) if k > 3 else 1
                row[-3:] = (size > 20).mean(), own[10] / k, len(np.unique(words[a:b])) / k**0.7
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.threshold) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(good: np.ndarray, bad: np.ndarray, share_bad: float, cut: float = 0.3, pairs: int = 40_000, l2: float = 1e-3, steps: int = 400, seed: int = 5) -> Model:
    """share_bad: of the whole labelled table, so that a sample that is balanced does not move the threshold."""
    both = np.concatenate([good, bad])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    rng = np.random.default_rng(seed)
    x, y = (np.clip((v - mean) / scale, -8, 8) for v in (good, bad))
    gap = x[rng.integers(0, len(x), pairs)] - y[rng.integers(0, len(y), pairs)]
    w, m, v = np.zeros(gap.shape[1]), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam on the whole set of pairs
        lost = 1 / (1 + np.exp(np.clip(gap @ w, -30, 30)))
        grad = -(lost @ gap) / pairs + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    s = np.concatenate([x @ w, y @ w])
    weight = np.concatenate([np.full(len(x), (1 - share_bad) / len(x)), np.full(len(y), share_bad / len(y))])
    order = np.argsort(s, kind="stable")
    k = min(int(np.searchsorted(np.cumsum(weight[order]), share_bad - 1e-9)), len(s) - 2)
    threshold = (s[order[k]] + s[order[k + 1]]) / 2
    slope = 4 / max(1e-6, np.median(gap @ w))
    return Model(mean, scale, w, float(threshold), float(slope), cut)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_per_label: int = 4000, cut: float = 0.3) -> Model | None:
    """None without labels of both kinds. docs: doc_id, text; labels: doc_id, quality."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").alias("of"), "quality").groupBy("of").agg(F.min("quality").alias("quality")).filter(~held_out("of"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    if len(counts) < 2:
        return None
    picked = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("of"), "of").limit(most_per_label) for q in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), F.col("doc_id") == F.col("of"))  # 2 * most_per_label rows at most

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["of", "quality", "x"])

    found = rows.select("doc_id", "text", "quality").mapInArrow(lean(measure), "of long, quality int, x array<double>").dropDuplicates(["of"]).toArrow().sort_by("of")
    x, q = np.array(found["x"].to_pylist()).reshape(-1, N_FEATURES), found["quality"].to_numpy()
    if not (q == 0).any() or not (q == 1).any():
        return None
    return fit(x[q == 1], x[q == 0], counts[0] / sum(counts.values()), cut)


def scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, carry: bool = False, **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted; with carry also `row`, the whole input row."""
    model = train(docs, labels, cut=cut, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            s = model.score(features(texts)) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(s)], names=[batch.schema.names[0], *batch.schema.names[2:], "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", *([F.struct(*docs.columns).alias("row")] if carry else []))
    scored = rows.mapInArrow(lean(run), rows.drop("text").schema.add("score", "double"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), *(["row"] if carry else []))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the model predicts to be good, with the columns of docs."""
    return scores(docs, labels, carry=True, **options).filter("predicted = 1").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = None  # a trained model is not SQL: tests hold the held-out accuracy
