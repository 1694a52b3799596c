"""Near-dedup by SetSketch registers: banded candidates, joint likelihood, verification on full shingle sets.

A document's sketch has m registers. Register j holds floor(1 - log_b h) of the smallest of its shingles' exponential
hashes h of rate a, cut to 0..q+1: exponentially spaced, truncated minima. Registers of a union are the elementwise
maxima, and with b near 1 two registers agree with a probability of at least the Jaccard similarity J. Bands of four
registers are exact 64-bit keys; with 32 bands a pair at J = 0.8 shares none with probability 5e-8.

Documents with the same shingle set are one class, found by a map-side combined group on the set's 128-bit hash, so
copies cost one row however many there are. Classes that share a band key form a bucket. All pairs of a bucket are never
formed. A bucket's hub is the member that meets most others over all bands (of a base and its edited copies that is the
base), and each member is compared with one hub only, the best of its buckets: one pair a member. Then only buckets whose
members still differ in component are left. Each takes the best hub that its members have, so that almost all buckets of
a family take the same, and an exact prefix filter on what differs from that hub finds the pairs that can be linked. So
every pair that shares a key is compared, known to be in one component, or proven not to be linked; no bucket is capped,
and small and large ones go the same way. A compared pair passes the ratio of set sizes, then the likelihood estimate of J
from the two sketches (six standard errors below the threshold), then exact counts on both full sets.

Where many members that are linked to no hub share differences, the pairs that the filter leaves still grow with the square
of their number, at a small share of all pairs: in a made family without its base, half of it beyond the threshold, about
one pair in a hundred was compared (12,594 among 1,500 members, 46,578 among 3,000).

Edge cases: null texts count as empty, and empty texts are linked with nothing, not even each other; texts with fewer
words than a shingle have one shingle; repeated rows and rows that repeat a doc_id are one document; a row with a null
doc_id takes the component of its copies, or stays by itself with a null component, and is kept only then; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, table
from .components import components
from .shingles import mixed, shingle_sets

NAME = "op10_near_dedup"
BANDS, ROWS = 32, 4
M = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65534
_FACTORS = np.random.default_rng(10).integers(1, 2**63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SKETCH = "doc_id long, n long, h1 long, h2 long, bands array<long>"


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of 64-bit hashes."""
    low = np.full(M, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 256):
        np.minimum(low, (shingles[i : i + 256, None] * _FACTORS).min(0), out=low)
    h = -np.log1p(-(low.astype(float) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood J of pairs of sketches (rows of a and b) of sets of known sizes, by golden-section search on the joint log-likelihood, which is concave."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j):
        x, y = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return more * np.log(x + tiny) + less * np.log(y + tiny) + same * np.log(np.maximum(1 - x - y, tiny))

    low, high, g = np.zeros(len(u)), np.minimum(u / v, v / u), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = high - g * (high - low), low + g * (high - low)
        left = score(c) > score(d)
        low, high = np.where(left, low, c), np.where(left, d, high)
    return (low + high) / 2


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            n, h1, h2, bands = [], [], [], []
            for own in shingle_sets(texts, width):
                n.append(len(own))
                h1.append(int(mixed(own).sum(dtype=np.uint64).astype(np.int64)))
                h2.append(int(mixed(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                bands.append(registers(own).view(np.int64) if len(own) else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SKETCH.split(", ")])

    return run


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = least - 6 * (least * (1 - least) / M) ** 0.5
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(k).flatten().to_numpy().view(np.uint16).reshape(-1, M) for k in (4, 5))
            n = [batch.column(k).to_numpy().astype(float) for k in (2, 3)]
            yield batch.select([0, 1]).filter(pa.array(likely_jaccard(x, y, *n) >= floor))

    return run


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()  # sets of hubs come again and again

        def full(key: int, text: bytes) -> np.ndarray:
            if key not in recent:
                recent[key] = next(shingle_sets([text], width))
                if len(recent) > 64:
                    recent.popitem(last=False)
            recent.move_to_end(key)
            return recent[key]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            x_text, y_text = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            keep = []
            for i in range(batch.num_rows):
                x, y = full(a[i], x_text[i].as_py()), full(b[i], y_text[i].as_py())
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int((large[at] == small).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _own_text(width: int):
    """Of rows that repeat a doc_id, those whose set is the class's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            h1 = np.array([mixed(s).sum(dtype=np.uint64).astype(np.int64) for s in shingle_sets(texts, width)], np.int64)
            yield batch.select([0, 1]).filter(pa.array(h1 == batch.column(2).to_numpy()))

    return run


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. Links are pairs with 100 * intersection >= percent * union."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    sketched = scratch.write(rows.mapInArrow(lean(_sketch(width)), SKETCH), "sketched")
    classes = sketched.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = scratch.write(classes, "classes")
    named = classes.filter("rep IS NOT NULL").select("rep", "n", "bands", "h1")

    # buckets: classes that share a band
    keyed = named.select("rep", F.posexplode("bands").alias("band", "value")).select("rep", F.xxhash64("band", "value").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = scratch.write(keyed.join(sizes, "key").select("rep", "key", "size"), "members")
    if members.isEmpty():
        labels = None
    else:
        labels = _link(scratch, rows, named, members, width, percent)
        if labels is not None:
            labels = scratch.write(labels, "labels")
    scratch.keep("sketched", "classes", "labels")

    found = classes.select("n", "h1", "h2", "rep")
    if labels is not None:
        found = found.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("n", "h1", "h2", F.coalesce("comp", "rep").alias("component"))
    else:
        found = found.withColumnRenamed("rep", "component")
    found = found.select(F.col("n").alias("g_n"), F.col("h1").alias("g_h1"), F.col("h2").alias("g_h2"), "component")
    same = (sketched["h1"] == found["g_h1"]) & (sketched["h2"] == found["g_h2"]) & (sketched["n"] == found["g_n"])
    out = sketched.select("doc_id", "n", "h1", "h2").join(found, same, "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.withColumn("kept", kept)


def _link(scratch: Scratch, rows: DataFrame, named: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame | None:
    ids = members.groupBy("rep").agg(F.sum("size").alias("met"))
    ids = scratch.write(ids.join(named, "rep"), "involved")
    texts = rows.join(ids.select(F.col("rep").alias("doc_id"), "h1"), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "h1")
    texts = scratch.write(texts.mapInArrow(lean(_own_text(width)), "doc_id long, text string"), "texts")
    order = F.struct("met", (-F.col("rep")).alias("minus"))
    members = scratch.write(members.join(ids.select("rep", "met", "n"), "rep").select("rep", "key", "n", order.alias("rank")), "ranked")

    def linked(pairs: DataFrame, tag: str) -> DataFrame:
        pairs = pairs.filter("a <> b").select("a", "b").distinct()
        x = ids.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("bands").alias("s_a"))
        y = ids.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("bands").alias("s_b"))
        near = pairs.join(x, "a").join(y, "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        near = scratch.write(near.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(lean(_likely(percent / 100)), "a long, b long"), f"{tag}-likely")
        x, y = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
        sure = near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lean(_verify(width, percent)), "a long, b long")
        return scratch.write(sure, f"{tag}-links")

    # every member with the best hub of its buckets
    hubs = members.groupBy("key").agg(F.max("rank").alias("hub"))
    first = members.join(hubs, "key").groupBy("rep", "n").agg(F.max("hub").alias("hub"))
    first = scratch.write(first, "first")
    links = linked(first.select(F.col("rep").alias("a"), (-F.col("hub.minus")).alias("b")), "hub")
    if links.isEmpty():
        own = first.withColumn("comp", F.col("rep"))
    else:
        own = first.join(components(links, scratch, "cc0").withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    # buckets that are not one component yet, by the best hub that a member has
    met = scratch.write(members.select("rep", "key").join(own, "rep"), "met")
    split = met.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("hub").alias("best")).filter("low <> high")
    rest = met.join(split.select("key", "best"), "key").select("rep", "n", "comp", (-F.col("best.minus")).alias("hub"))
    rest = scratch.write(rest.distinct(), "rest")
    if not rest.isEmpty():
        near, pairs = _differing(scratch, rest, texts, width, percent)
        links = links.unionByName(near).unionByName(linked(scratch.write(pairs, "pairs"), "rest"))
    return None if links.isEmpty() else components(links, scratch, "cc1")


def _deltas(width: int):
    """Of each pair of a member and its hub: the symmetric difference of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            out, sizes = [], []
            for hub, x, y in zip(batch.column("hub").to_pylist(), batch.column("x").cast(pa.binary()), batch.column("y").cast(pa.binary())):
                if hub not in recent:
                    recent[hub] = next(shingle_sets([y.as_py()], width))
                    if len(recent) > 64:
                        recent.popitem(last=False)
                recent.move_to_end(hub)
                out.append(np.setxor1d(next(shingle_sets([x.as_py()], width)), recent[hub], assume_unique=True).view(np.int64))
                sizes.append(len(recent[hub]))
            columns = [batch.column(c) for c in ("hub", "rep", "comp", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["hub", "rep", "comp", "n", "n_hub", "delta"])

    return run


def _differing(scratch: Scratch, rest: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """rest: rep, n, comp, hub, one row for each member and hub. Returns links of members and hubs, and pairs (a, b) of
    members of one hub, in other components, that may be linked: an exact prefix filter on differences from the hub.

    With X = hub + dX (symmetric differences), |X + Y| = |dX| + |dY| - 2 |dX & dY|, and a link means |X + Y| <= t (|X| + |Y|),
    t = (1 - J) / (1 + J). So linked members share at least o = (|dX| + |dY| - t (|X| + |Y|)) / 2 of their differences,
    and under one order of these by rarity they share one among the first |dX| - o + 1 and |dY| - o + 1. Where Y itself is
    not linked to the hub, o >= (|dX| + t (|hub| - |X|)) / 2 whatever Y is, so short prefixes do; a member that is not
    linked to the hub meets one that is with its long prefix, o >= |dX| - t |X| (1 + 1 / J). Two members that are linked
    to the hub need no pair. A difference that no other member has is shared with none, so a pair also needs o such items
    on both sides. Edits of copies are mostly their own, so few pairs are left, however many members a hub has."""
    j = percent / 100
    t = (1 - j) / (1 + j)
    ids = rest.filter("hub <> rep")
    x, y = texts.select(F.col("doc_id").alias("rep"), F.col("text").alias("x")), texts.select(F.col("doc_id").alias("hub"), F.col("text").alias("y"))
    deltas = ids.join(x, "rep").join(y, "hub").select("hub", "rep", "comp", "n", "x", "y").mapInArrow(lean(_deltas(width)), "hub long, rep long, comp long, n long, n_hub long, delta array<long>")
    deltas = scratch.write(deltas.withColumn("nd", F.size("delta").cast("long")), "deltas")
    near_hub = 100 * (F.col("n") + F.col("n_hub") - F.col("nd")) >= percent * (F.col("n") + F.col("n_hub") + F.col("nd"))
    near = deltas.filter(near_hub).select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    short = F.greatest(F.lit(1), F.ceil((F.col("nd") + t * (F.col("n_hub") - F.col("n"))) / 2 - 1e-6))
    long_ = F.greatest(F.lit(1), F.ceil(F.col("nd") - t * F.col("n") * (1 + 1 / j) - 1e-6))
    items = deltas.select("hub", "rep", "comp", "n", "nd", near_hub.alias("near"), short.alias("o_short"), long_.alias("o_long"), F.explode("delta").alias("item"))
    rare = items.groupBy("hub", "item").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    items = items.join(rare, ["hub", "item"])
    # items of one member only come first in the order and meet nothing: they only use up places of the prefix
    in_order = Window.partitionBy("hub", "rep").orderBy("df", "item")
    shared = Window.partitionBy("hub", "rep")
    items = items.withColumn("held", F.count(F.lit(1)).over(shared)).withColumn("place", F.row_number().over(in_order) + F.col("nd") - F.col("held"))
    items = items.withColumn("is_short", F.col("place") <= F.col("nd") - F.col("o_short") + 1).filter("is_short OR (NOT near AND place <= nd - o_long + 1)")
    items = scratch.write(items.select("hub", "item", "rep", "comp", "n", "nd", "held", "near", "is_short"), "prefixes")
    one = items.filter("NOT near").select("hub", "item", F.col("rep").alias("a"), F.col("comp").alias("c"), F.col("n").alias("m"), F.col("nd").alias("md"), F.col("held").alias("mh"), F.col("is_short").alias("s"))
    two = items.filter("is_short").select("hub", "item", F.col("rep").alias("b"), F.col("comp").alias("d"), "n", "nd", "held", "near")
    enough = f"2 * least(mh, held) >= md + nd - {t!r}D * (m + n) - 1e-6"
    pairs = one.join(two, ["hub", "item"]).filter(f"c <> d AND (near OR (s AND a < b)) AND least(m, n) * 100 >= greatest(m, n) * {percent} AND {enough}")
    return near, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without those near to a kept one, with the columns of docs."""
    gone = near_components(docs, id_col, text_col, **options).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = None  # all pairs are too slow in SQL: tests compare with brute force
