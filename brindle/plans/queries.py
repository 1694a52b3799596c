"""One registered query for each operator, on the shared tables, with the SQL that gives the same rows.

Shared views: `emb`, instances of the embeddings table; queries are its rows whose id is divisible by 50, the window all rows. `mixed`,
instances of the part table with two numeric and two nominal features. `events`, the stream, in the order of ts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves as C
from ..functions import vectors as V
from ..operators import decay, evaluation, kdtree, projections, rptree, sgd, sparse, votes, windows, zorder
from ..operators import knn as K
from ..operators.blocked import Metric
from ..operators.ranges import feature_ranges, widen, with_ranges
from ..operators.topk import top_k
from ..schema import Header, dense_index, instances
from ..sources import arff, generators

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIM, CLASSES = 64, 10
EMB, MIX = Header.numeric(DIM, CLASSES), Header((0, 0, 1, 1))
CURVE = Header.numeric(4)
#: The stated set of queries of a search.
ASKED = "id % 50 = 0"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instances(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries and window."""
    rows = emb(spark, sf_dir)
    return rows.filter(ASKED), rows


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = dense_index(dense_index(table(spark, sf_dir, "part"), "p_brand", "b"), "p_type", "t")
    return instances(part, "p_partkey", F.array(*[F.col(c).cast("double") for c in ("p_size", "p_retailprice", "b", "t")]))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, event_id, value and class (index of event_type) in the order of ts."""
    rows = windows.with_sequence(table(spark, sf_dir, "events"), "ts", "event_id")
    return dense_index(rows, "event_type", "class").select("seq", "event_id", "user_id", "value", "class")


def each(df: DataFrame, column: str, *keys: str, out: str = "value") -> DataFrame:
    """One row an element."""
    return df.select(*keys, F.posexplode(column).alias("attr", out))


# ---------------------------------------------------------------- SQL parts
R64, R4 = "range(1, 65)", "range(1, 5)"
S_EMB = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f, label FROM embeddings)"
S_MIX = "m AS (SELECT p_partkey AS id, [p_size::DOUBLE, p_retailprice, (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE, (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE] AS f FROM part)"
S_STREAM = "s AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, event_id, user_id, value, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS class FROM events)"


def s_ranges(of: str, where: str = "true", name: str = "r") -> str:
    return f"""{name}0 AS (SELECT i, min(x) AS mn, max(x) AS mx FROM (SELECT generate_subscripts(f, 1) AS i, unnest(f) AS x FROM {of} WHERE {where}) GROUP BY i),
{name} AS (SELECT list(mn ORDER BY i) AS lo, list(mx ORDER BY i) AS hi FROM {name}0)"""


def s_scaled(x: str = "f", count: str = R64, nominal_from: int = 99, floor: bool = False) -> str:
    one = f"CASE WHEN hi[i] - lo[i] > 0 THEN ({x}[i] - lo[i]) / (hi[i] - lo[i]) ELSE 0 END"
    one = f"greatest({one}, 0)" if floor else one
    return f"list_transform({count}, lambda i: CASE WHEN i >= {nominal_from} THEN {x}[i] ELSE {one} END)"


def s_sum(term: str, count: str = R64) -> str:
    return f"list_reduce(list_prepend(0::DOUBLE, list_transform({count}, lambda i: {term})), lambda s, v: s + v)"


S_NORM = f"{S_EMB}, {s_ranges('e')}, n AS (SELECT id, label, f, {s_scaled()} AS x FROM e, r)"
S_DIST = f"{S_NORM}, d AS (SELECT q.id AS query_id, w.id AS id, w.label, {s_sum('(q.x[i] - w.x[i]) * (q.x[i] - w.x[i])')} AS distance FROM n q, n w WHERE q.id % 50 = 0)"
S_KNN = f"{S_DIST}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place FROM d QUALIFY place <= 10)"


def placed(found: DataFrame) -> DataFrame:
    return found.select("query_id", "id", "label", "distance", F.col("place").cast("long").alias("place"))


# ---------------------------------------------------------------- ranges, scaling, scalars
def _bounds(df: DataFrame) -> DataFrame:
    return df.select(F.posexplode(F.arrays_zip("low", "high")).alias("attr", "b")).select("attr", "b.low", "b.high")


S_BOUNDS = "SELECT (i - 1)::INT AS attr, lo[i] AS low, hi[i] AS high FROM (SELECT *, unnest(range(1, len(lo) + 1)) AS i FROM r)"


@query(f"WITH {S_EMB}, {s_ranges('e')} {S_BOUNDS}")
def minmax_dense(spark, sf_dir):
    return _bounds(feature_ranges(emb(spark, sf_dir), DIM))


@query(f"WITH {S_EMB}, {s_ranges('e', 'id % 2 = 0')} {S_BOUNDS}")
def minmax_subset(spark, sf_dir):
    rows = emb(spark, sf_dir)
    return _bounds(feature_ranges(rows, DIM, rows.filter("id % 2 = 0").select("id")))


@query(f"WITH {S_EMB}, {s_ranges('e')} {S_BOUNDS}")
def minmax_update(spark, sf_dir):
    rows = emb(spark, sf_dir)
    return _bounds(widen(feature_ranges(rows.filter("id <> 3"), DIM), rows.filter("id = 3")))


@query("SELECT min(l_quantity) AS low_quantity, max(l_quantity) AS high_quantity, min(l_extendedprice) AS low_price, max(l_extendedprice) AS high_price, min(l_discount) AS low_discount, max(l_discount) AS high_discount, min(l_tax) AS low_tax, max(l_tax) AS high_tax FROM lineitem")
def minmax_lineitem(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"))
    names = ("quantity", "price", "discount", "tax")
    return feature_ranges(rows, 4).select(*[F.col(b)[i].alias(f"{b}_{n}") for i, n in enumerate(names) for b in ("low", "high")])


def _mixed_scaled(spark, sf_dir, **options):
    rows = mixed(spark, sf_dir)
    return with_ranges(rows, feature_ranges(rows, 4)).select("id", V.normalize("features", "low", "high", MIX.types, **options).alias("x"))


S_MIXN = f"{S_MIX}, {s_ranges('m')}, x AS (SELECT id, {s_scaled('f', R4, 3)} AS x FROM m, r)"
S_EACH = "SELECT id, (i - 1)::INT AS attr, x[i] AS value FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM x)"


@query(f"WITH {S_MIXN} {S_EACH}")
def normalize(spark, sf_dir):
    return each(_mixed_scaled(spark, sf_dir), "x", "id")


@query(f"WITH {S_MIXN}, y AS (SELECT id, list_transform(x, lambda v: v::FLOAT::DOUBLE) AS x FROM x) {S_EACH.replace('FROM x)', 'FROM y)')}")
def normalize_float(spark, sf_dir):
    return each(_mixed_scaled(spark, sf_dir).select("id", V.to_float(F.col("x")).cast("array<double>").alias("x")), "x", "id")


@query(f"WITH {S_MIX}, {s_ranges('m', 'id % 3 = 0')}, x AS (SELECT id, {s_scaled('f', R4, 3, True)} AS x FROM m, r) {S_EACH}")
def normalize_floor(spark, sf_dir):
    rows = mixed(spark, sf_dir)
    return each(with_ranges(rows, feature_ranges(rows.filter("id % 3 = 0"), 4)).select("id", V.normalize("features", "low", "high", MIX.types, floor=0.0).alias("x")), "x", "id")


S_QUANT = f"{S_MIXN}, q AS (SELECT id, [trunc(x[1] * 1000000)::BIGINT & 4294967295, trunc(x[2] * 1000000)::BIGINT & 4294967295, trunc(x[3])::BIGINT * 1000000 & 4294967295, trunc(x[4])::BIGINT * 1000000 & 4294967295] AS x FROM x)"


@query(f"WITH {S_QUANT} {S_EACH.replace('FROM x)', 'FROM q)')}")
def quantize(spark, sf_dir):
    return each(_mixed_scaled(spark, sf_dir).select("id", V.quantize("x", MIX.types).alias("q")), "q", "id")


@query(f"WITH {S_QUANT}, z AS (SELECT id, list_transform({R4}, lambda i: (x[i] + [123456, 987654, 4294900000, 777][i]) & 4294967295) AS x FROM q) {S_EACH.replace('FROM x)', 'FROM z)')}")
def shift(spark, sf_dir):
    q = _mixed_scaled(spark, sf_dir).select("id", V.quantize("x", MIX.types).alias("q"), F.expr("array(123456L, 987654L, 4294900000L, 777L)").alias("s"))
    return each(q.select("id", V.shift("q", "s", 4).alias("z")), "z", "id")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS key FROM customer")
def order_key(spark, sf_dir):
    return windows.with_sequence(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", out="key")


@query(f"WITH {S_EMB}, v AS (SELECT f AS g FROM e WHERE id = 0) SELECT id, {s_sum('f[i] * g[i]')} AS y FROM e, v")
def dense_matvec(spark, sf_dir):
    rows = emb(spark, sf_dir)
    return rows.crossJoin(F.broadcast(rows.filter("id = 0").select(F.col("features").alias("v")))).select("id", V.dot("features", "v", DIM).alias("y"))


@query(f"WITH {S_EMB}, x AS (SELECT id, list_transform(f, lambda v: CASE WHEN v < 0 OR v > 0.2 THEN 0 ELSE v END) AS x FROM e) {S_EACH}")
def nan_to_zero(spark, sf_dir):
    bad = F.transform("features", lambda v: F.when(v < 0, F.lit(float("nan"))).when(v > 0.2, F.lit(float("inf"))).otherwise(v))
    return each(emb(spark, sf_dir).select("id", V.nan_to_zero(bad).alias("x")), "x", "id")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::FLOAT AS price FROM lineitem")
def double_to_float(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("float").alias("price"))


@query(f"""WITH {S_EMB}, x AS (SELECT id, f[1] * 10 AS x, 1 / (1 + 0.3275911::DOUBLE * abs(f[1] * 10)) AS t FROM e)
SELECT id, round(sign(x) * (1 - (((((1.061405429::DOUBLE) * t + (-1.453152027)::DOUBLE) * t + 1.421413741::DOUBLE) * t + (-0.284496736)::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-x * x)), 9) AS y FROM x""")
def erf(spark, sf_dir):
    return emb(spark, sf_dir).select("id", F.round(V.erf(F.col("features")[0] * 10), 9).alias("y"))


@query("""SELECT i, (length(bin(i + 1)) - 1)::INT AS level, CASE WHEN i > 0 THEN (i - 1) // 2 END AS parent, 2 * i + 1 AS left_child, 2 * i + 2 AS right_child, i % 2 = 1 AS is_left,
CASE WHEN i <= 1 THEN 1 ELSE pow(2, ceil(log2(i)))::BIGINT END AS next_pow2, (2 * pow(2, (length(bin(i + 1)) - 1)) - 2)::BIGINT AS last_of_level FROM (SELECT unnest(range(2000)) AS i)""")
def tree_index(spark, sf_dir):
    i = F.col("i")
    return spark.range(2000).select(F.col("id").alias("i")).select(
        "i", V.tree_level(i).alias("level"), V.tree_parent(i).alias("parent"), V.tree_left(i).alias("left_child"), V.tree_right(i).alias("right_child"),
        V.is_left(i).alias("is_left"), V.next_pow2(i).alias("next_pow2"), V.max_level_id(V.tree_level(i)).alias("last_of_level"),
    )


# ---------------------------------------------------------------- distances
@query(f"WITH {S_DIST} SELECT query_id, id, distance FROM d")
def sqdist_numeric(spark, sf_dir):
    return K.distances(*sides(spark, sf_dir), EMB).select("query_id", "id", "distance")


@query(f"WITH {S_DIST} SELECT query_id, id, sqrt(distance) AS distance FROM d")
def euclidean(spark, sf_dir):
    return K.distances(*sides(spark, sf_dir), EMB).select("query_id", "id", F.sqrt("distance").alias("distance"))


S_MIXD = f"""{S_MIXN}, d AS (SELECT q.id AS query_id, w.id, {s_sum('CASE WHEN i >= 3 THEN CASE WHEN trunc(q.x[i])::INT <> trunc(w.x[i])::INT THEN 1 ELSE 0 END ELSE (q.x[i] - w.x[i]) * (q.x[i] - w.x[i]) END', R4)} AS distance FROM x q, x w WHERE q.id % 50 = 0)"""


@query(f"WITH {S_MIXD} SELECT * FROM d")
def sqdist_mixed(spark, sf_dir):
    rows = mixed(spark, sf_dir)
    return K.distances(rows.filter(ASKED), rows, MIX).select("query_id", "id", "distance")


@query(f"WITH {S_DIST} SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place FROM d WHERE id % 7 = query_id % 7 QUALIFY place <= 5")
def sqdist_candidates(spark, sf_dir):
    q, w = sides(spark, sf_dir)
    listed = w.select("id", (F.col("id") % 7).alias("c")).join(q.select(F.col("id").alias("query_id"), (F.col("id") % 7).alias("c")), "c")
    return K.refine(listed, q, w, EMB, 5, feature_ranges(w, DIM)).select("query_id", "id", "distance", F.col("place").cast("long").alias("place"))


def _cosine_sql(value: str) -> str:
    return f"""WITH {S_NORM}, p AS (SELECT q.id AS query_id, w.id, {s_sum('q.f[i] * w.f[i]')} AS dot, {s_sum('q.x[i] * w.x[i]')} AS ndot, {s_sum('q.f[i] * q.f[i]')} AS a, {s_sum('w.f[i] * w.f[i]')} AS b
FROM n q, n w WHERE q.id % 50 = 0) SELECT query_id, id, round({value}, 9) AS similarity FROM p"""


def _cosine(spark, sf_dir, similarity, scaled: bool = False) -> DataFrame:
    q, w = sides(spark, sf_dir)
    both = K.similarities(q, w, EMB, similarity, feature_ranges(w, DIM) if scaled else None, ("id",), digits=9)
    return both.select("query_id", "id", "similarity")


@query(_cosine_sql("CASE WHEN abs(dot / (a * b)) <= 1 THEN 1 - acos(dot / (a * b)) / pi() END"))
def cosine_ref(spark, sf_dir):
    return _cosine(spark, sf_dir, V.squared_norm_cosine)


@query(_cosine_sql("dot / (sqrt(a) * sqrt(b))"))
def cosine_true(spark, sf_dir):
    return _cosine(spark, sf_dir, V.true_cosine)


@query(_cosine_sql("2 - ndot / (a * b)"))
def cosine_norm(spark, sf_dir):
    return _cosine(spark, sf_dir, V.normalized_cosine_distance, True)


# ---------------------------------------------------------------- neighbours and votes
@query(f"WITH {S_KNN} SELECT query_id, id, label, distance, place FROM k")
def knn_linear(spark, sf_dir):
    return placed(K.knn(*sides(spark, sf_dir), EMB))


@query(f"""WITH {S_EMB.replace("embedding::DOUBLE[]", "list_transform(embedding, lambda v: v::FLOAT)::DOUBLE[]")}, {S_KNN.split(', ', 1)[1].split('FROM embeddings), ', 1)[1]} SELECT query_id, id, label, distance, place FROM k""")
def knn_float(spark, sf_dir):
    return placed(K.knn_float(*sides(spark, sf_dir), EMB))


@query(_cosine_sql("CASE WHEN abs(dot / (a * b)) <= 1 THEN 1 - acos(dot / (a * b)) / pi() END").replace("SELECT query_id, id, round(", "SELECT query_id, id, similarity, place FROM (SELECT query_id, id, round(") + " WHERE abs(dot / (a * b)) <= 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dot / (a * b) DESC, id) <= 10) JOIN (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY dot / (a * b) DESC, id) AS place FROM p WHERE abs(dot / (a * b)) <= 1) USING (query_id, id)")
def knn_cosine(spark, sf_dir):
    return K.knn_cosine(*sides(spark, sf_dir), EMB).select("query_id", "id", F.round("similarity", 9).alias("similarity"), F.col("place").cast("long").alias("place"))


S_TIES = f"{S_MIX}, {s_ranges('m')}, x AS (SELECT id, [(f[1]), f[3]] AS x FROM m), d AS (SELECT q.id AS query_id, w.id, (CASE WHEN q.x[1] <> w.x[1] THEN 1 ELSE 0 END + CASE WHEN q.x[2] <> w.x[2] THEN 1 ELSE 0 END)::DOUBLE AS distance FROM x q, x w WHERE q.id % 50 = 0)"


@query(f"WITH {S_TIES} SELECT query_id, id, distance, rank() OVER (PARTITION BY query_id ORDER BY distance) AS place FROM d QUALIFY place <= 3")
def knn_ties(spark, sf_dir):
    rows = mixed(spark, sf_dir).withColumn("features", F.array(F.col("features")[0], F.col("features")[2]))
    return K.knn(rows.filter(ASKED), rows, Header((1, 1)), 3, keep_ties=True).select("query_id", "id", "distance", F.col("place").cast("long").alias("place"))


def _votes_sql(weight: str) -> str:
    return f"""WITH {S_KNN}, c AS (SELECT unnest(range(10))::INT AS class), nw AS (SELECT count(*) AS n FROM e), w AS (SELECT query_id, label, {weight} AS w FROM k),
t AS (SELECT query_id, sum(w) AS total FROM w GROUP BY query_id), v AS (SELECT query_id, label, sum(w) AS w FROM w GROUP BY ALL)
SELECT t.query_id, c.class, round((coalesce(v.w, 0) + 1.0::DOUBLE / n) / (t.total + 10.0::DOUBLE / n), 9) AS p FROM t CROSS JOIN c CROSS JOIN nw LEFT JOIN v ON v.query_id = t.query_id AND v.label = c.class"""


def _votes(spark, sf_dir, scheme: str) -> DataFrame:
    q, w = sides(spark, sf_dir)
    found = votes.class_votes(K.knn(q, w, EMB), CLASSES, w.count(), DIM + 1, scheme)
    return found.select("query_id", "class", F.round("p", 9).alias("p"))


for _scheme, _weight in (("none", "1.0::DOUBLE"), ("inverse", "1 / (sqrt(distance / 65.0::DOUBLE) + 0.001::DOUBLE)"), ("similarity", "1 - sqrt(distance / 65.0::DOUBLE)")):
    query(_votes_sql(_weight), f"vote_{_scheme}")(lambda spark, sf_dir, s=_scheme: _votes(spark, sf_dir, s))


@query(f"WITH {S_KNN} SELECT query_id, label AS class, count(*) AS votes FROM k GROUP BY ALL")
def vote_raw(spark, sf_dir):
    return votes.raw_votes(K.knn(*sides(spark, sf_dir), EMB))


@query(f"WITH {S_KNN}, w AS (SELECT query_id, label, 1 / (sqrt(distance / 65.0::DOUBLE) + 0.001::DOUBLE) AS w FROM k) SELECT query_id, round(sum(w * label) / sum(w), 9) AS prediction FROM w GROUP BY query_id")
def vote_numeric(spark, sf_dir):
    found = votes.numeric_vote(K.knn(*sides(spark, sf_dir), EMB), DIM + 1, "inverse")
    return found.select("query_id", F.round("prediction", 9).alias("prediction"))


@query(f"WITH {S_KNN}, v AS (SELECT query_id, label, count(*) AS n FROM k GROUP BY ALL) SELECT query_id, arg_max(label, n * 100 - label)::INT AS predicted FROM v GROUP BY query_id")
def knn_linear_votes(spark, sf_dir):
    """The flagship: exact kNN classification."""
    q, w = sides(spark, sf_dir)
    return votes.predicted(votes.class_votes(K.knn(q, w, EMB), CLASSES, w.count(), DIM + 1))


@query(f"WITH {S_STREAM} SELECT seq, seq >= 500 AS ready, CASE WHEN seq >= 500 THEN NULL ELSE 0.2::DOUBLE END AS prior FROM s")
def prior_fallback(spark, sf_dir):
    ready = windows.is_ready(F.col("seq"), 500)
    return stream(spark, sf_dir).select("seq", ready.alias("ready"), F.when(~ready, F.lit(votes.uniform_prior(5)[0])).alias("prior"))


@query(f"""WITH {S_EMB}, {s_ranges('e')}, n AS (SELECT id, label, {s_scaled()} AS x FROM e, r),
d AS (SELECT q.id AS q, w.label, q.label AS truth, row_number() OVER (PARTITION BY q.id ORDER BY {s_sum('(q.x[i] - w.x[i]) * (q.x[i] - w.x[i])')}, w.id) AS place FROM n q, n w WHERE q.id <> w.id),
v AS (SELECT k, q, truth, label, count(*) AS n FROM d, (SELECT unnest(range(1, 11))::INT AS k) WHERE place <= k GROUP BY ALL),
g AS (SELECT k, q, truth, arg_max(label, n * 100 - label) AS guess FROM v GROUP BY ALL), s AS (SELECT k, count(*) FILTER (guess <> truth) AS errors FROM g GROUP BY k)
SELECT k, errors, row_number() OVER (ORDER BY errors, k) = 1 AS best FROM s""")
def loo_cv_k(spark, sf_dir):
    return K.best_k(emb(spark, sf_dir), EMB, 10)


def _loo_numeric_sql(error: str) -> str:
    return f"""WITH {S_MIX}, t AS (SELECT id, f[1:1] || f[3:4] AS f, f[2] AS label FROM m), {s_ranges('t')}, n AS (SELECT id, label, {s_scaled('f', 'range(1, 4)', 2)} AS x FROM t, r),
d AS (SELECT q.id AS q, w.label, q.label AS truth, row_number() OVER (PARTITION BY q.id ORDER BY {s_sum('CASE WHEN i >= 2 THEN CASE WHEN trunc(q.x[i])::INT <> trunc(w.x[i])::INT THEN 1 ELSE 0 END ELSE (q.x[i] - w.x[i]) * (q.x[i] - w.x[i]) END', 'range(1, 4)')}, w.id) AS place FROM n q, n w WHERE q.id <> w.id),
g AS (SELECT k, q, any_value(truth) AS truth, avg(label) AS guess FROM d, (SELECT unnest(range(1, 6))::INT AS k) WHERE place <= k GROUP BY k, q), s AS (SELECT k, {error} AS errors FROM g GROUP BY k)
SELECT k, round(errors, 9) AS errors, row_number() OVER (ORDER BY errors, k) = 1 AS best FROM s"""


def _loo_numeric(spark, sf_dir, squared: bool) -> DataFrame:
    """The retail price as a numeric class, from the size and two nominal features."""
    rows = mixed(spark, sf_dir).withColumn("label", F.col("features")[1]).withColumn("features", F.array(F.col("features")[0], F.col("features")[2], F.col("features")[3]))
    return K.best_k(rows, Header((0, 1, 1)), 5, numeric=True, squared=squared).withColumn("errors", F.round("errors", 9))


@query(_loo_numeric_sql("avg(abs(guess - truth))"))
def loo_cv_mae(spark, sf_dir):
    return _loo_numeric(spark, sf_dir, False)


@query(_loo_numeric_sql("sqrt(avg((guess - truth) * (guess - truth)))"))
def loo_cv_rmse(spark, sf_dir):
    return _loo_numeric(spark, sf_dir, True)


# ---------------------------------------------------------------- windows
@query(f"WITH {S_STREAM} SELECT seq, seq % 1000 AS slot, event_id FROM s WHERE seq > (SELECT max(seq) FROM s) - 1000")
def window_ring(spark, sf_dir):
    return windows.ring(stream(spark, sf_dir), 1000).select("seq", "slot", "event_id")


@query(f"WITH {S_STREAM} SELECT seq // 64 AS batch, count(*) AS n, round(sum(value), 6) AS total FROM s WHERE seq // 64 < (SELECT (max(seq) + 1) // 64 FROM s) GROUP BY ALL")
def minibatch(spark, sf_dir):
    return windows.mini_batches(stream(spark, sf_dir), 64).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(f"WITH {S_STREAM} SELECT (seq % 3)::INT AS worker, count(*) AS n, min(seq) AS first_seq FROM s GROUP BY ALL")
def worker_split(spark, sf_dir):
    return windows.worker_rows(stream(spark, sf_dir), 3).groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


DECAY = 40


@query(f"""WITH RECURSIVE {S_STREAM}, o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n FROM s),
rec AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS square, 0.0::DOUBLE AS total FROM o UNION ALL
SELECT o.user_id, o.n, mean * (1 - 1 / least(o.n, {DECAY})::DOUBLE) + value / least(o.n, {DECAY})::DOUBLE, square * (1 - 1 / least(o.n, {DECAY})::DOUBLE) + value * value / least(o.n, {DECAY})::DOUBLE, total + value FROM rec JOIN o ON o.user_id = rec.user_id AND o.n = rec.n + 1)
SELECT user_id, max(n) AS n, round(arg_max(mean, n), 7) AS mean, round(arg_max(square, n), 5) AS square, round(arg_max(total, n), 5) AS total FROM rec GROUP BY user_id""")
def decayed_means(spark, sf_dir):
    found = decay.decayed_means(stream(spark, sf_dir), "user_id", "seq", "value", DECAY)
    return found.select("user_id", "n", F.round("mean", 7).alias("mean"), F.round("square", 5).alias("square"), F.round("sum", 5).alias("total"))


_A, _B = f"(1 / least(o.n, {DECAY})::DOUBLE)", f"(1 / least(o.n - 49, {DECAY})::DOUBLE)"


@query(f"""WITH RECURSIVE {S_STREAM}, o AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n FROM s),
rec AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0.0::DOUBLE AS m, 0.0::DOUBLE AS q, list_transform(range(20), lambda i: 0.0::DOUBLE) AS h FROM o UNION ALL
SELECT user_id, n, m, q, CASE WHEN n <= 50 THEN h ELSE list_transform(range(20), lambda i: h[i + 1] * (1 - b) + CASE WHEN i = CASE WHEN abs(x - m) < d OR d = 0 THEN least(CASE WHEN d > 0 THEN trunc((x - m + d) * 8 / (2 * d)) ELSE 0 END, 7)
  ELSE 8 + 2 * least(greatest(trunc(abs(x - m) / d) - 1, 0), 5) + CASE WHEN x >= m THEN 1 ELSE 0 END END THEN b ELSE 0 END) END FROM (
  SELECT *, sqrt(abs(q - m * m)) AS d FROM (SELECT o.user_id, o.n, o.x, m * (1 - {_A}) + x * {_A} AS m, q * (1 - {_A}) + x * x * {_A} AS q, h, CASE WHEN o.n > 50 THEN {_B} END AS b FROM rec JOIN o ON o.user_id = rec.user_id AND o.n = rec.n + 1)))
SELECT user_id, (i - 1)::INT AS bin, round(h[i], 9) AS weight FROM (SELECT user_id, arg_max(h, n) AS h FROM rec GROUP BY user_id), (SELECT unnest(range(1, 21)) AS i)""")
def decaying_histogram(spark, sf_dir):
    return decay.decaying_histogram(stream(spark, sf_dir), "user_id", "seq", "value", DECAY).withColumn("weight", F.round("weight", 9))


# ---------------------------------------------------------------- curves
SHIFTS = zorder.curve_shifts(2, 4)


def s_curve(tag: str, source: str, dims: list[int], shifts: list[int]) -> str:
    """c_tag: id, code of all rows; p_tag: positions of the window; q_tag: positions of the queries."""
    n = len(dims)
    q = ", ".join(f"((trunc(greatest(CASE WHEN hi[{i + 1}] - lo[{i + 1}] > 0 THEN (f[{d}] - lo[{i + 1}]) / (hi[{i + 1}] - lo[{i + 1}]) ELSE 0 END, 0) * 1000000)::BIGINT & 4294967295) + {shifts[i]}) & 4294967295" for i, d in enumerate(dims))
    bits = " || ".join(f"substr(b[{d + 1}], {b + 1}, 1)" for b in range(21) for d in reversed(range(n)))
    return f"""b_{tag} AS (SELECT id, list_transform([{q}], lambda v: lpad(bin(v), 21, '0')) AS b FROM {source}),
c_{tag} AS (SELECT id, {bits} AS code FROM b_{tag}),
p_{tag} AS (SELECT id, code, row_number() OVER (ORDER BY code, id) - 1 AS position FROM c_{tag}),
q_{tag} AS (SELECT q.id AS query_id, (SELECT count(*) FROM p_{tag} w WHERE w.code < q.code) AS position FROM c_{tag} q WHERE q.id % 50 = 0)"""


def s_near(tag: str, half: int | str) -> str:
    return f"SELECT query_id, id FROM q_{tag} q, p_{tag} p WHERE p.position BETWEEN q.position - {half} AND q.position + {half} - 1"


S_FOUR = f"{S_EMB}, g AS (SELECT id, f[1:4] AS f FROM e), {s_ranges('g', 'true')}, h AS (SELECT g.id, g.f, lo, hi FROM g, r)"
S_C1, S_C2 = s_curve("a", "h", [1, 2, 3, 4], SHIFTS[0]), s_curve("b", "h", [1, 2, 3, 4], SHIFTS[1])


def four(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", F.slice("features", 1, 4))


def _curve(spark, sf_dir):
    q, w = (four(d) for d in sides(spark, sf_dir))
    ranges = feature_ranges(w.unionByName(q), 4)
    return zorder.codes(q, ranges, CURVE), zorder.codes(w, ranges, CURVE)


@query(f"WITH {S_FOUR}, {S_C1} SELECT id, code FROM c_a")
def morton(spark, sf_dir):
    rows = four(emb(spark, sf_dir))
    return zorder.codes(rows, feature_ranges(rows, 4), CURVE)


@query(f"WITH {S_FOUR}, {S_C1} SELECT id, position FROM p_a")
def zorder_sort(spark, sf_dir):
    return zorder.positions(_curve(spark, sf_dir)[1]).select("id", "position")


@query("""WITH q AS (SELECT p_partkey AS id, [p_size::BIGINT, p_partkey % 16] AS q FROM part), b AS (SELECT id, list_transform(q, lambda v: lpad(bin(v), 8, '0')) AS b FROM q),
c AS (SELECT id, array_to_string(list_transform(range(1, 9), lambda k: b[2][k] || b[1][k]), '') AS code FROM b)
SELECT id, row_number() OVER (ORDER BY code, id) - 1 AS place, row_number() OVER (ORDER BY substr(code, 9, 8) || substr(code, 1, 8), id) - 1 AS reversed_place FROM c""")
def sort_bytes(spark, sf_dir):
    """Byte keys in both orders of significance. Places are counted in ranges of the key."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 16).alias("q"))
    key = part.select("id", C.morton_bytes("q", 2, 8).alias("key"))
    back = F.concat(F.substring("key", 2, 1), F.substring("key", 1, 1))
    placed_ = lambda k, out: windows.with_sequence(key.select("id", F.conv(F.hex(k), 16, 10).cast("long").alias("k")), "k", "id", out=out).select("id", out)
    return placed_(F.col("key"), "place").join(placed_(back, "reversed_place"), "id")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS place FROM customer")
def sort_double(spark, sf_dir):
    """Places of rows by a double key, ties by the index."""
    return windows.with_sequence(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", out="place").select("c_custkey", "place")


@query(f"WITH {S_FOUR}, {S_C1} SELECT query_id, position FROM q_a")
def nary_search(spark, sf_dir):
    q, w = _curve(spark, sf_dir)
    return zorder.query_positions(w, q)


@query(f"WITH {S_FOUR}, {S_C1} {s_near('a', 10)}")
def zorder_candidates(spark, sf_dir):
    q, w = (four(d) for d in sides(spark, sf_dir))
    return zorder.zorder_candidates(q, w, CURVE, 10)


S_ALLN = f"{s_ranges('e', 'true', 'ra')}, na AS (SELECT id, label, {s_scaled()} AS x FROM e, ra)"
S_REFINE = f"""{S_ALLN}, dd AS (SELECT cand.query_id, w.id, w.label, {s_sum('(q.x[i] - w.x[i]) * (q.x[i] - w.x[i])')} AS distance FROM cand JOIN na q ON q.id = cand.query_id JOIN na w ON w.id = cand.id),
kk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place FROM dd QUALIFY place <= 10)"""


def _zorder(spark, sf_dir, n_curves: int) -> DataFrame:
    q, w = sides(spark, sf_dir)
    found = zorder.zorder_candidates(four(q), four(w), CURVE, 10, n_curves)
    return K.refine(found, q, w, EMB, 10, feature_ranges(w.unionByName(q), DIM))


@query(f"WITH {S_FOUR}, {S_C1}, cand AS ({s_near('a', 10)}), {S_REFINE} SELECT query_id, id, label, distance, place FROM kk")
def knn_zorder(spark, sf_dir):
    return placed(_zorder(spark, sf_dir, 1))


S_MULTI = f"{S_FOUR}, {S_C1}, {S_C2}, cand AS ({s_near('a', 10)} UNION {s_near('b', 10)}), {S_REFINE}"


@query(f"WITH {S_MULTI} SELECT query_id, id, label, distance, place FROM kk")
def knn_zorder_multi(spark, sf_dir):
    return placed(_zorder(spark, sf_dir, 2))


@query(f"""WITH {S_MULTI}, ex AS (SELECT q.id AS query_id, {s_sum('(q.x[i] - w.x[i]) * (q.x[i] - w.x[i])')} AS distance FROM na q, na w WHERE q.id % 50 = 0),
ek AS (SELECT query_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance) AS place FROM ex QUALIFY place = 10)
SELECT round(avg(CASE WHEN ek.distance > 0 THEN sqrt(kk.distance) / sqrt(ek.distance) WHEN kk.distance = 0 THEN 1 END), 9) AS epsilon, count(*) AS n FROM ek JOIN kk USING (query_id) WHERE kk.place = 10""")
def eps_error(spark, sf_dir):
    q, w = sides(spark, sf_dir)
    exact = K.knn(q, w, EMB, 10, ranges=feature_ranges(w.unionByName(q), DIM))
    return zorder.approximation_error(exact, _zorder(spark, sf_dir, 2), 10).select(F.round("epsilon", 9).alias("epsilon"), "n")


def _zorder_wide(spark, sf_dir) -> DataFrame:
    q, w = sides(spark, sf_dir)
    return zorder.knn_zorder(q, w, EMB, half=zorder.wide_half(w))


S_HALF = "half AS (SELECT greatest(512, (count(*) + 7) // 8) AS half FROM e)"
WIDE_SHIFTS = zorder.curve_shifts(10, DIM)
S_WIDE = f"""{S_EMB}, {s_ranges('e')}, {S_HALF}, z AS (SELECT id, list_transform({s_scaled()}, lambda v: trunc(greatest(v, 0) * 1000000)::BIGINT & 4294967295) AS z FROM e, r),
sh(curve, s) AS (VALUES {", ".join(f"({i}, {shifts})" for i, shifts in enumerate(WIDE_SHIFTS))}),
bt AS (SELECT curve, id, list_transform({R64}, lambda i: lpad(bin((z[i] + s[i]) & 4294967295), 21, '0')) AS b FROM z, sh),
cw AS (SELECT curve, id, array_to_string(list_transform(range(1, 22), lambda k: array_to_string(list_transform(range(64, 0, -1), lambda d: substr(b[d], k, 1)), '')), '') AS code FROM bt),
pw AS (SELECT curve, id, row_number() OVER (PARTITION BY curve ORDER BY code, id) - 1 AS position FROM cw),
qw AS (SELECT q.curve, q.id AS query_id, (SELECT count(*) FROM cw w WHERE w.curve = q.curve AND w.code < q.code) AS position FROM cw q WHERE q.id % 50 = 0),
cand AS (SELECT DISTINCT query_id, pw.id FROM qw JOIN pw USING (curve), half WHERE pw.position BETWEEN qw.position - half AND qw.position + half - 1), {S_REFINE}"""


@query(f"WITH {S_WIDE} SELECT query_id, id, label, distance, place FROM kk")
def knn_zorder_wide(spark, sf_dir):
    """Ten curves over all features, with a window that grows with the table; the queries above hold the operator against SQL on thin windows."""
    return placed(_zorder_wide(spark, sf_dir))


@query(f"""WITH {S_WIDE}, ex AS (SELECT q.id AS query_id, {s_sum('(q.x[i] - w.x[i]) * (q.x[i] - w.x[i])')} AS distance FROM na q, na w WHERE q.id % 50 = 0),
ek AS (SELECT query_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance) AS place FROM ex QUALIFY place = 10)
SELECT round(avg(CASE WHEN ek.distance > 0 THEN sqrt(kk.distance) / sqrt(ek.distance) WHEN kk.distance = 0 THEN 1 END), 9) AS epsilon, count(*) AS n FROM ek JOIN kk USING (query_id) WHERE kk.place = 10""")
def eps_error_wide(spark, sf_dir):
    q, w = sides(spark, sf_dir)
    exact = K.knn(q, w, EMB, 10, ranges=feature_ranges(w.unionByName(q), DIM))
    return zorder.approximation_error(exact, _zorder_wide(spark, sf_dir), 10).select(F.round("epsilon", 9).alias("epsilon"), "n")


# ---------------------------------------------------------------- projections
MATRICES = [projections.sign_matrix(4, DIM, 1 + c) for c in range(2)]


def s_matrix(matrix, x: str = "f") -> str:
    return "[" + ", ".join(" + ".join(["0::DOUBLE", *[f"({float(w)!r})::DOUBLE * {x}[{i + 1}]" for i, w in enumerate(row) if w]]) for row in matrix) + "]"


@query(f"WITH {S_EMB}, x AS (SELECT id, {s_matrix(MATRICES[0])} AS x FROM e) {S_EACH}")
def project(spark, sf_dir):
    return each(projections.project(emb(spark, sf_dir), MATRICES[0]), "projected", "id")


def _projected_sql(matrices: list, half: int | str, *more: str) -> str:
    parts, tags = [S_EMB, *more], "abcdefghij"[: len(matrices)]
    for tag, matrix in zip(tags, matrices):
        parts += [f"g{tag} AS (SELECT id, {s_matrix(matrix)} AS f FROM e)", s_ranges(f"g{tag}", "true", f"r{tag}_"), f"h{tag} AS (SELECT id, f, lo, hi FROM g{tag}, r{tag}_)", s_curve(tag, f"h{tag}", [1, 2, 3, 4], [0] * 4)]
    return f"WITH {', '.join(parts)}, cand AS ({' UNION '.join(s_near(tag, half) for tag in tags)}), {S_REFINE} SELECT query_id, id, label, distance, place FROM kk"


@query(_projected_sql(MATRICES, 64))
def knn_projected(spark, sf_dir):
    return placed(zorder.knn_projected(*sides(spark, sf_dir), EMB, n_curves=2, half=64))


@query(_projected_sql([projections.sign_matrix(4, DIM, 1 + c) for c in range(10)], "(SELECT half FROM half)", S_HALF))
def knn_projected_wide(spark, sf_dir):
    """Ten curves, with a window that grows with the table."""
    q, w = sides(spark, sf_dir)
    return placed(zorder.knn_projected(q, w, EMB, half=zorder.wide_half(w)))


def _fjlt_sql() -> str:
    import numpy as np

    padded, signs, places = projections.fjlt_parts(DIM, 8)
    return f"WITH {S_EMB}, y AS (SELECT id, {s_matrix(projections.hadamard(np.diag(signs)).T[places] / 8**0.5)} AS y FROM e), x AS (SELECT id, list_transform(y, lambda v: round(v, 9)) AS x FROM y) {S_EACH}"


@query(_fjlt_sql())
def fjlt(spark, sf_dir):
    rows = projections.fjlt(emb(spark, sf_dir), DIM, 8)
    return each(rows, "projected", "id").select("id", "attr", F.round("value", 9).alias("value"))


@query(_fjlt_sql().replace("round(v, 9)", "round(v::FLOAT::DOUBLE, 4)"))
def fjlt_float(spark, sf_dir):
    rows = projections.fjlt(emb(spark, sf_dir), DIM, 8, single=True)
    return each(rows, "projected", "id").select("id", "attr", F.round(F.col("value").cast("double"), 4).alias("value"))


# ---------------------------------------------------------------- sparse algebra
S_ENT = f"{S_EMB}, t AS (SELECT row_id, col, val FROM (SELECT id AS row_id, (generate_subscripts(f, 1) - 1)::INT AS col, unnest(f) AS val FROM e) WHERE abs(val) > 0.1)"
S_W = "wt AS (SELECT c::INT AS class, j::INT AS col, ((c * 64 + j) * 37 % 101 - 50) / 100.0::DOUBLE AS w FROM (SELECT unnest(range(10)) AS c), (SELECT unnest(range(64)) AS j)), bt AS (SELECT c::INT AS class, (c * 31 % 11 - 5) / 10.0::DOUBLE AS bias FROM (SELECT unnest(range(10)) AS c))"


def entries(spark, sf_dir) -> DataFrame:
    return sparse.sparsify(emb(spark, sf_dir), 0.1)


def weights(spark) -> DataFrame:
    w = spark.range(640).select((F.expr("id div 64")).cast("int").alias("class"), (F.col("id") % 64).cast("int").alias("attr"), ((F.col("id") * 37 % 101 - 50) / 100.0).alias("w"))
    b = spark.range(10).select(F.col("id").cast("int").alias("class"), F.lit(sgd.BIAS).alias("attr"), ((F.col("id") * 31 % 11 - 5) / 10.0).alias("w"))
    return w.unionByName(b)


@query(f"WITH {S_ENT}, c AS (SELECT row_id, count(*) AS nnz FROM t GROUP BY row_id) SELECT row_id, nnz, coalesce(sum(nnz) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM c")
def csr_build(spark, sf_dir):
    return sparse.row_pointers(entries(spark, sf_dir))


@query(f"WITH {S_ENT} SELECT row_id, round(sum(val * (col + 1)), 9) AS y FROM t GROUP BY row_id")
def csr_spmv(spark, sf_dir):
    x = spark.range(DIM).select(F.col("id").cast("int").alias("col"), (F.col("id") + 1).cast("double").alias("x"))
    return sparse.multiply(entries(spark, sf_dir), x).select("row_id", F.round("y", 9).alias("y"))


@query(f"WITH {S_ENT} SELECT col, round(sum(CASE WHEN val > 0 THEN val ELSE 0 END), 9) AS total FROM t GROUP BY col")
def column_sum(spark, sf_dir):
    return sparse.positive_column_sums(entries(spark, sf_dir)).select("col", F.round("total", 9).alias("total"))


@query(f"WITH {S_ENT}, {S_W} SELECT row_id, class, round(sum(val * w), 9) AS dot FROM t JOIN wt USING (col) GROUP BY ALL")
def dot_products(spark, sf_dir):
    w = weights(spark).filter("attr >= 0").withColumnRenamed("attr", "col")
    return sparse.dot_products(entries(spark, sf_dir), w).select("row_id", "class", F.round("dot", 9).alias("dot"))


# ---------------------------------------------------------------- gradients and updates
def _labels(spark, sf_dir) -> DataFrame:
    return emb(spark, sf_dir).select(F.col("id").alias("row_id"), "label")


@query(f"""WITH {S_ENT}, sc AS (SELECT row_id, sum(val * (col % 7 - 3)) AS score FROM t GROUP BY row_id), l AS (SELECT id AS row_id, (label % 2)::INT AS label, coalesce(score, 0) AS score FROM e LEFT JOIN sc ON e.id = sc.row_id)
SELECT row_id, round(greatest(0, 1 - (2 * label - 1) * score), 9) AS loss, CASE WHEN (2 * label - 1) * score < 1 THEN -(2 * label - 1)::DOUBLE ELSE 0 END AS factor FROM l""")
def hinge_binary(spark, sf_dir):
    w = spark.range(DIM).select(F.col("id").cast("int").alias("col"), (F.col("id") % 7 - 3).cast("double").alias("w"))
    labels = _labels(spark, sf_dir).withColumn("label", (F.col("label") % 2).cast("int"))
    return sgd.binary_hinge(entries(spark, sf_dir), labels, w).select("row_id", F.round("loss", 9).alias("loss"), "factor")


S_SCORES = f"""{S_ENT}, {S_W}, dt AS (SELECT row_id, class, sum(val * w) AS dot FROM t JOIN wt USING (col) GROUP BY ALL),
sc AS (SELECT e.id AS row_id, e.label, bt.class, coalesce(dot, 0) + bias AS score FROM e CROSS JOIN bt LEFT JOIN dt ON dt.row_id = e.id AND dt.class = bt.class),
up AS (SELECT row_id, class, score, CASE WHEN class = label THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y, CASE WHEN y * score < 1 THEN y ELSE 0 END AS u FROM sc)"""


def _updates(spark, sf_dir) -> DataFrame:
    return sgd.one_vs_all(sgd.class_scores(entries(spark, sf_dir), _labels(spark, sf_dir), weights(spark)))


@query(f"WITH {S_SCORES} SELECT row_id, class, round(score, 9) AS score, u AS update_ FROM up")
def hinge_ovr(spark, sf_dir):
    return _updates(spark, sf_dir).select("row_id", "class", F.round("score", 9).alias("score"), F.col("update").alias("update_"))


@query(f"WITH {S_SCORES} SELECT row_id, class, CASE WHEN score <= 0 THEN 0 ELSE 1 END AS vote FROM up")
def sgd_predict(spark, sf_dir):
    return sgd.predict(_updates(spark, sf_dir))


def s_gradient(of: str) -> str:
    return f"SELECT class, col AS attr, sum(u / 500.0::DOUBLE * val) AS g FROM {of} JOIN up USING (row_id) WHERE u <> 0 GROUP BY ALL UNION ALL SELECT class, -1, sum(u / 500.0::DOUBLE) FROM up WHERE u <> 0 GROUP BY ALL"


@query(f"WITH {S_SCORES}, al AS (SELECT id AS row_id, (generate_subscripts(f, 1) - 1)::INT AS col, unnest(f) AS val FROM e), g AS ({s_gradient('al')}) SELECT class, attr, round(g, 9) AS g FROM g")
def grad_dense(spark, sf_dir):
    return sgd.dense_gradient(emb(spark, sf_dir), _updates(spark, sf_dir), 500).select("class", "attr", F.round("g", 9).alias("g"))


@query(f"WITH {S_SCORES}, g AS ({s_gradient('t')}) SELECT class, attr, round(g, 9) AS g FROM g")
def grad_sparse(spark, sf_dir):
    return sgd.gradient(entries(spark, sf_dir), _updates(spark, sf_dir), 500).select("class", "attr", F.round("g", 9).alias("g"))


@query(f"WITH {S_SCORES}, g AS ({s_gradient('t')}), wa AS (SELECT class, col AS attr, w FROM wt UNION ALL SELECT class, -1, bias FROM bt) SELECT class, attr, round(w + 0.0001::DOUBLE * coalesce(g, 0), 12) AS w FROM wa LEFT JOIN g USING (class, attr)")
def direct_update(spark, sf_dir):
    g = sgd.gradient(entries(spark, sf_dir), _updates(spark, sf_dir), 500)
    return sgd.direct_update(weights(spark), g).select("class", "attr", F.round("w", 12).alias("w"))


S_STATE = "st AS (SELECT (i // 64)::INT AS class, (i % 64)::INT AS attr, ((i * 37) % 101 - 50) / 100.0::DOUBLE AS g, ((i * 13) % 17 - 8) / 100.0::DOUBLE AS es, ((i * 7) % 11 - 5) / 100.0::DOUBLE AS el, 0.25::DOUBLE AS tau, (i % 3 - 1)::INT AS delta, i / 1000.0::DOUBLE AS w FROM (SELECT unnest(range(640)) AS i))"


def _state(spark) -> DataFrame:
    i = F.col("id")
    return spark.range(640).select(
        F.expr("id div 64").cast("int").alias("class"), (i % 64).cast("int").alias("attr"), ((i * 37 % 101 - 50) / 100.0).alias("g"), ((i * 13 % 17 - 8) / 100.0).alias("es"),
        ((i * 7 % 11 - 5) / 100.0).alias("el"), F.lit(0.25).alias("tau"), (i % 3 - 1).cast("int").alias("delta"), (i / 1000.0).alias("w"),
    )


@query(f"""WITH {S_STATE}, s AS (SELECT *, g + es + el AS v, abs(g + es + el) + 1e-12::DOUBLE >= tau AS sent, CASE WHEN g + es + el < 0 THEN -1 ELSE 1 END AS sg FROM st)
SELECT class, attr, round(CASE WHEN sent THEN 0 ELSE v END, 12) AS es, round(CASE WHEN sent THEN sg * (abs(v) - tau) ELSE 0 END, 12) AS el, (delta + CASE WHEN sent THEN sg ELSE 0 END)::INT AS delta FROM s""")
def onebit_step(spark, sf_dir):
    return sgd.one_bit_step(_state(spark)).select("class", "attr", F.round("es", 12).alias("es"), F.round("el", 12).alias("el"), "delta")


@query(f"WITH {S_STATE} SELECT attr, round((avg(tau + abs(el)) - avg(abs(es))) / 2, 12) AS tau FROM st GROUP BY attr")
def tau_update(spark, sf_dir):
    return sgd.tau_update(_state(spark), "attr").select("attr", F.round("tau", 12).alias("tau"))


@query(f"WITH {S_STATE} SELECT class, attr, round(w + 0.0001::DOUBLE * tau * delta, 12) AS w, 0 AS delta FROM st")
def apply_delta(spark, sf_dir):
    return sgd.apply_delta(_state(spark)).select("class", "attr", F.round("w", 12).alias("w"), "delta")


def _training(spark, sf_dir, size: int, workers: int) -> DataFrame:
    rows = windows.with_sequence(emb(spark, sf_dir), "id")
    return windows.worker_rows(windows.mini_batches(rows, size), workers)


def _full_batches(rows: DataFrame) -> list[int]:
    """Every mini-batch that is full, in order."""
    last = rows.agg(F.max("batch").alias("last")).first()["last"]
    return [] if last is None else list(range(last + 1))


def _weight_rows(spark, w) -> DataFrame:
    dim = w.shape[1] - 1
    return spark.createDataFrame([(c, a if a < dim else sgd.BIAS, float(w[c, a])) for c in range(len(w)) for a in range(dim + 1)], "class int, attr int, w double")


def _trained(spark, sf_dir, **options) -> DataFrame:
    rows = _training(spark, sf_dir, 64, 2).withColumn("batch", F.col("batch").cast("int")).persist()
    try:
        return _weight_rows(spark, sgd.train(rows, DIM, CLASSES, _full_batches(rows), workers=2, rate=0.01, **options))
    finally:
        rows.unpersist()


# Rounds in SQL: one row a step, whose weights are lists by class, the bias last.
_X, _ZERO = "list_append(embedding::DOUBLE[], 1.0::DOUBLE)", f"list_transform(range({CLASSES}), lambda k: list_transform(range({DIM + 1}), lambda a: 0.0::DOUBLE))"
_SIGN = "CASE WHEN t.label = c.class THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
_UPDATE = f"CASE WHEN ({_SIGN}) * list_dot_product(r.w[c.class + 1], t.x) < 1 THEN ({_SIGN}) ELSE 0.0::DOUBLE END"
S_SGD = f"""t AS (SELECT *, seq // 64 AS batch, (seq % 2)::INT AS worker FROM (SELECT {_X} AS x, label, row_number() OVER (ORDER BY vec_id) - 1 AS seq FROM embeddings)),
kept AS (SELECT * FROM t WHERE batch < (SELECT (max(seq) + 1) // 64 FROM t)), c AS (SELECT unnest(range({CLASSES}))::INT AS class)"""


def s_weights(of: str, keys: str = "") -> str:
    return f"SELECT {keys}class::INT AS class, CASE WHEN a = {DIM} THEN -1 ELSE a::INT END AS attr, round(w[class + 1][a + 1], 9) AS w FROM {of}, (SELECT unnest(range({CLASSES})) AS class), (SELECT unnest(range({DIM + 1})) AS a)"


_GRADIENT = "[" + ", ".join(f"sum(u * x[{i + 1}])" for i in range(DIM + 1)) + "]"


@query(f"""WITH RECURSIVE {S_SGD}, rec(step, w) AS (SELECT 0::BIGINT, {_ZERO} UNION ALL SELECT r.step + 1, n.w FROM (SELECT * FROM rec WHERE step <= (SELECT max(batch) FROM kept)) r, LATERAL (
  SELECT list(v ORDER BY class) AS w FROM (SELECT class, list_transform(range(1, {DIM + 2}), lambda a: r.w[class + 1][a] + 0.01::DOUBLE * g[a] / 32.0::DOUBLE) AS v FROM (
    SELECT class, {_GRADIENT} AS g FROM (SELECT c.class, t.x, {_UPDATE} AS u FROM kept t, c WHERE t.batch = r.step) GROUP BY class))) n)
{s_weights("(SELECT w FROM rec ORDER BY step DESC LIMIT 1)")}""")
def sgd_train(spark, sf_dir):
    return _trained(spark, sf_dir).withColumn("w", F.round("w", 9))


@query()
def sgd_onebit(spark, sf_dir):
    return _trained(spark, sf_dir, one_bit=True, tau=0.05, stagger=2)


@query(f"""WITH RECURSIVE {S_SGD}, o AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY seq) - 1 AS turn FROM kept),
rec(worker, step, w) AS (SELECT worker, 0::BIGINT, {_ZERO} FROM (SELECT DISTINCT worker FROM o) UNION ALL SELECT r.worker, r.step + 1, n.w FROM rec r, LATERAL (
  SELECT list(v ORDER BY class) AS w FROM (SELECT class, list_transform(range(1, {DIM + 2}), lambda a: r.w[class + 1][a] + 0.01::DOUBLE * u * x[a]) AS v FROM (
    SELECT c.class, t.x, {_UPDATE} AS u FROM o t, c WHERE t.turn = r.step AND t.worker = r.worker))) n WHERE n.w IS NOT NULL)
{s_weights("(SELECT worker, arg_max(w, step) AS w FROM rec GROUP BY worker)", "worker, ")}""")
def sgd_sequential(spark, sf_dir):
    return sgd.sequential(_training(spark, sf_dir, 64, 2), DIM, CLASSES, rate=0.01).withColumn("w", F.round("w", 9))


# ---------------------------------------------------------------- trees
@query(f"""WITH {S_EMB}, {s_ranges('e')}, a0 AS (SELECT id, f, 0 AS node FROM e), sh0 AS (SELECT i - 1 AS d, (lo[i] + hi[i]) / 2 AS mid FROM (SELECT lo, hi, unnest(range(1, 65)) AS i FROM r) WHERE hi[i] > lo[i] ORDER BY d LIMIT 1),
a1 AS (SELECT id, f, CASE WHEN f[d + 1] > mid THEN 2 ELSE 1 END AS node FROM a0, sh0), b1 AS (SELECT node, i, min(x) AS l, max(x) AS h FROM (SELECT node, generate_subscripts(f, 1) AS i, unnest(f) AS x FROM a1) GROUP BY ALL),
c1 AS (SELECT node, count(*) AS n FROM a1 GROUP BY node), sh1 AS (SELECT node, i - 1 AS d, (l + h) / 2 AS mid, row_number() OVER (PARTITION BY node ORDER BY (h - l) / (hi[i] - lo[i]) DESC, i) AS place FROM b1, r QUALIFY place = 1)
SELECT 0::BIGINT AS node, d::INT AS split_dim, mid AS split_val FROM sh0 UNION ALL SELECT node, d::INT, mid FROM sh1 JOIN c1 USING (node) WHERE n > 50""")
def kd_level_split(spark, sf_dir):
    return kdtree.split_table(spark, kdtree.build(emb(spark, sf_dir), Metric((0,) * DIM), leaf=50, depth=2))


@query(ORACLE["knn_linear"])
def knn_kdtree(spark, sf_dir):
    return placed(kdtree.knn_kdtree(*sides(spark, sf_dir), EMB, leaf=64))


S_PLAIN = f"{S_EMB}, d AS (SELECT q.id AS query_id, w.id, w.label, {s_sum('(q.f[i] - w.f[i]) * (q.f[i] - w.f[i])')} AS distance FROM e q, e w WHERE q.id % 50 = 0)"


@query(f"WITH {S_PLAIN} SELECT query_id, id, label, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place FROM d QUALIFY place <= 5")
def knn_rptree(spark, sf_dir):
    q, w = sides(spark, sf_dir)
    tree = rptree.fit(w.withColumn("seq", F.col("id")), DIM)
    return placed(rptree.knn_rptree(q, w, tree, DIM))


@query()
def knn_rptree_defeatist(spark, sf_dir):
    q, w = sides(spark, sf_dir)
    tree = rptree.fit(w.withColumn("seq", F.col("id")), DIM)
    return placed(rptree.knn_rptree(q, w, tree, DIM, defeatist=True))


@query()
def kd_work(spark, sf_dir):
    """What the exact search by boxes does for each query."""
    return kdtree.work_log(*sides(spark, sf_dir), EMB, leaf=64)


@query()
def rptree_work(spark, sf_dir):
    """Means over the log of the exact search in the leaves of a random-projection tree."""
    q, w = sides(spark, sf_dir)
    tree = rptree.fit(w.withColumn("seq", F.col("id")), DIM)
    return evaluation.work_statistics(rptree.work_log(q, w, tree, DIM))


# ---------------------------------------------------------------- evaluation
@query(f"""WITH {S_STREAM}, p AS (SELECT seq // 2500 AS checkpoint, seq, class AS actual, (event_id * 7 % 5)::INT AS predicted FROM s), l AS (SELECT *, lag(actual) OVER (PARTITION BY checkpoint ORDER BY seq) AS before FROM p),
b AS (SELECT checkpoint, count(*) AS n, avg((actual = predicted)::INT) AS accuracy, count(*) FILTER (before = actual) AS repeats FROM l GROUP BY ALL),
a AS (SELECT checkpoint, actual AS c, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT checkpoint, predicted AS c, count(*) AS n FROM p GROUP BY ALL), ch AS (SELECT checkpoint, sum(a.n * g.n)::DOUBLE AS x FROM a JOIN g USING (checkpoint, c) GROUP BY ALL)
SELECT checkpoint, n, round(accuracy, 9) AS accuracy, round((accuracy - x / (n * n)) / (1 - x / (n * n)), 9) AS kappa, round((accuracy - repeats::DOUBLE / n) / (1 - repeats::DOUBLE / n), 9) AS kappa_temporal FROM b JOIN ch USING (checkpoint)""")
def eval_metrics(spark, sf_dir):
    rows = stream(spark, sf_dir).select(F.expr("seq div 2500").alias("checkpoint"), "seq", F.col("class").alias("actual"), (F.col("event_id") * 7 % 5).cast("int").alias("predicted"))
    return evaluation.metrics(rows, "checkpoint").select("checkpoint", "n", *[F.round(c, 9).alias(c) for c in ("accuracy", "kappa", "kappa_temporal")])


@query(f"WITH {S_STREAM} SELECT seq // 1300 AS checkpoint, CASE WHEN seq % 1300 < 1000 THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM s WHERE seq // 1300 < (SELECT (max(seq) + 1) // 1300 FROM s) GROUP BY ALL")
def hold_out(spark, sf_dir):
    return evaluation.hold_out(stream(spark, sf_dir), 1000, 300).groupBy("checkpoint", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S_STREAM} SELECT CASE WHEN seq >= 300 THEN (seq - 300) // 1000 END AS checkpoint, CASE WHEN seq < 300 THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM s GROUP BY ALL")
def hold_out_cached(spark, sf_dir):
    return evaluation.hold_out(stream(spark, sf_dir), 1000, 300, cached=True).groupBy("checkpoint", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S_KNN}, v AS (SELECT query_id, label, count(*) AS n FROM k GROUP BY ALL), g AS (SELECT query_id, arg_max(label, n * 100 - label) AS guess FROM v GROUP BY ALL)
SELECT count(*) AS n, round(avg((guess = label)::INT), 9) AS accuracy FROM g JOIN e ON e.id = g.query_id""")
def eval_knn(spark, sf_dir):
    """The evaluated learner end to end: window, neighbours, votes, accuracy."""
    q, w = sides(spark, sf_dir)
    got = votes.predicted(votes.class_votes(K.knn(q, w, EMB), CLASSES, w.count(), DIM + 1)).join(q.select(F.col("id").alias("query_id"), F.col("label").alias("actual")), "query_id")
    return evaluation.metrics(got.withColumn("seq", F.col("query_id"))).select("n", F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {S_EMB}, c AS (SELECT q.id AS query_id, count(*) AS compared FROM e q JOIN e w ON q.id % 7 = w.id % 7 WHERE q.id % 50 = 0 GROUP BY ALL) SELECT round(avg(compared), 9) AS avg_compared, round(avg(compared), 9) AS avg_leaf_size, 1.0::DOUBLE AS avg_leaves FROM c")
def work_statistics(spark, sf_dir):
    q, w = sides(spark, sf_dir)
    sizes = w.groupBy((F.col("id") % 7).alias("leaf")).agg(F.count(F.lit(1)).alias("compared"))
    log = q.select(F.col("id").alias("query_id"), (F.col("id") % 7).alias("leaf")).join(sizes, "leaf").select("query_id", "compared", F.col("compared").alias("leaf_size"), F.lit(1).alias("leaves"))
    return evaluation.work_statistics(log).select(F.round("avg_compared", 9).alias("avg_compared"), F.round("avg_leaf_size", 9).alias("avg_leaf_size"), "avg_leaves")


# ---------------------------------------------------------------- sources
@query("WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place, count(*) OVER () AS total FROM customer), s AS (SELECT unnest(range(4000)) AS seq) SELECT s.seq, c.c_custkey FROM s JOIN c ON s.seq % c.total = c.place")
def arff_cycle(spark, sf_dir):
    return arff.cycle(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), 4000).select("seq", F.col("id").alias("c_custkey"))


def s_uniform(row: str, place: int, seed: int = 1) -> str:
    return f"(('0x' || substr(md5('{seed}:{place}:' || {row}), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


@query(f"WITH c AS (SELECT id, floor({s_uniform('id', 1000)} * 2)::INT AS label FROM (SELECT unnest(range(1000)) AS id)), x AS (SELECT id, label, [{', '.join(f'label + {s_uniform("id", i)} / 10' for i in range(7))}] AS x FROM c) SELECT id, label, (i - 1)::INT AS attr, x[i] AS value FROM (SELECT *, unnest(range(1, 8)) AS i FROM x)")
def two_clusters(spark, sf_dir):
    return each(generators.two_clusters(spark, 1000), "features", "id", "label")


@query(f"WITH x AS (SELECT id, [{', '.join([*[f'floor({s_uniform("id", i)} * 5)' for i in range(5)], *[s_uniform('id', 5 + i) for i in range(5)]])}] AS x FROM (SELECT unnest(range(1000)) AS id)) {S_EACH}")
def random_tree_features(spark, sf_dir):
    return each(generators.random_tree(spark, 1000), "features", "id")


S_TREE = f"x AS (SELECT id, [{', '.join([*[f'floor({s_uniform("id", i)} * 5)' for i in range(5)], *[s_uniform('id', 5 + i) for i in range(5)]])}] AS x FROM (SELECT unnest(range(1000)) AS id))"


@query(f"WITH {S_TREE}, l AS (SELECT id, {generators.tree_sql()} AS label FROM x) SELECT label, count(*) AS n FROM l GROUP BY label")
def random_tree(spark, sf_dir):
    return generators.random_tree(spark, 1000).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _radial_sql() -> str:
    at, spread, label, edge = generators.centres(10, 50, 2)
    table_ = ", ".join(f"({c}, {[float(v) for v in at[c]]}::DOUBLE[], {float(spread[c])!r}::DOUBLE, {int(label[c])})" for c in range(len(at)))
    pick = "CASE " + " ".join(f"WHEN u < {float(e)!r}::DOUBLE THEN {c}" for c, e in enumerate(edge[:-1])) + f" ELSE {len(edge) - 1} END"
    direction = ", ".join(f"{s_uniform('id', 1 + i)} * 2 - 1" for i in range(10))
    return f"""WITH c(c, centre, spread, label) AS (VALUES {table_}), u AS (SELECT id, {s_uniform('id', 0)} AS u, [{direction}] AS d, sqrt(-2 * ln(1 - {s_uniform('id', 500)})) * cos(2 * pi() * {s_uniform('id', 501)}) AS z FROM (SELECT unnest(range(1000)) AS id)),
x AS (SELECT u.id, c.label, list_transform(range(1, 11), lambda i: centre[i] + d[i] / sqrt(list_sum(list_transform(d, lambda v: v * v))) * z * spread) AS x FROM (SELECT *, {pick} AS c FROM u) u JOIN c USING (c))
SELECT id, label, (i - 1)::INT AS attr, round(x[i], 9) AS value FROM (SELECT *, unnest(range(1, 11)) AS i FROM x)"""


@query(_radial_sql())
def radial_basis(spark, sf_dir):
    return each(generators.radial_basis(spark, 1000), "features", "id", "label").withColumn("value", F.round("value", 9))


@query("SELECT c_custkey AS id, c_acctbal AS balance, (dense_rank() OVER (ORDER BY c_nationkey) - 1)::DOUBLE AS nation, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS label FROM customer")
def arff_file(spark, sf_dir):
    """Customers written as an ARFF file, with a nominal feature and a nominal class, and read again."""
    from ..session import scratch_path

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_nationkey", "c_mktsegment")
    nations, segments = ([str(r[0]) for r in rows.select(c).distinct().orderBy(c).collect()] for c in ("c_nationkey", "c_mktsegment"))  # 25 and 5 values
    index = lambda c, values: (F.array_position(F.array(*map(F.lit, values)), F.col(c).cast("string")) - 1).cast("double")
    made = rows.select("id", F.array(F.col("id").cast("double"), "c_acctbal", index("c_nationkey", nations)).alias("features"), index("c_mktsegment", segments).alias("label"))
    path = f"{scratch_path(spark)}/customer.arff"
    arff.write_arff(made, path, "customer", [("id", None), ("balance", None), ("nation", nations), ("digit", segments)])
    f = F.col("features")
    return arff.read_arff(spark, path)[0].select(f[0].cast("long").alias("id"), f[1].alias("balance"), f[2].alias("nation"), "label")


@query(f"""WITH c AS (SELECT id, floor({s_uniform('id', 1000)} * 2)::INT AS label, floor({s_uniform('id', 2000)} * 10)::INT AS mapping FROM (SELECT unnest(range(500)) AS id)), x AS (SELECT id, label, mapping, [{', '.join(f'label + {s_uniform("id", i)} / 10' for i in range(7))}] AS x FROM c),
t AS (SELECT {[[int(v) for v in m] for m in generators.mappings(10, 7, 1024)]} AS t) SELECT id, label, mapping, t[mapping + 1][i] AS col, x[i] AS val FROM (SELECT *, unnest(range(1, 8)) AS i FROM x), t""")
def sparse_mapping(spark, sf_dir):
    rows = generators.sparse_mapped(generators.two_clusters(spark, 500), 7)
    return rows.select("id", "label", "mapping", F.explode("entries").alias("e")).select("id", "label", "mapping", "e.col", "e.val")


# ---------------------------------------------------------------- streaming
@query(f"""WITH {S_STREAM}, w AS (SELECT (seq % 3)::INT AS worker, seq, value, row_number() OVER (PARTITION BY seq % 3 ORDER BY seq DESC) AS back, count(*) OVER (PARTITION BY seq % 3) AS seen FROM s)
SELECT worker, seen, seen >= 100 AS ready, round(sum(value), 6) AS total, min(seq) AS first FROM w WHERE back <= 100 GROUP BY worker, seen""")
def stream_ring(spark, sf_dir):
    """The ring window as a stream: a file stream of sequenced events, run until all input is in."""
    from ..session import scratch_path
    from ..streaming.online import ring_stream

    path = scratch_path(spark)
    windows.worker_rows(stream(spark, sf_dir), 3).select("worker", "seq", "value").coalesce(1).write.parquet(f"{path}/in")
    source = spark.readStream.schema("worker int, seq long, value double").parquet(f"{path}/in")
    name = f"ring_{uuid.uuid4().hex}"
    run = ring_stream(source, 100).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select("worker", "seen", "ready", F.round("total", 6).alias("total"), "first")
