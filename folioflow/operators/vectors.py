"""Vectors of words, queries and documents: weighting, centroids, cosine ranking, clusters, components.

Dense products run in NumPy on Arrow batches against a matrix whose size is
checked; a larger matrix is taken in slices, each of which reads the rows
again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioflow.operators.retrieval import cosines, first, unit

#: Smoothing of word weights: of single words, and within centroids.
SMOOTH, SMOOTH_CENTROID = 5e-3, 1e-3
#: Bytes of a matrix that is broadcast at most.
MATRIX_BYTES = 64_000_000
#: Rows that are multiplied with a matrix at a time.
PART = 2048


def word_weight(df: Column, docs: Column, smooth: float = SMOOTH) -> Column:
    """The smooth inverse frequency of a word in ``df`` of ``docs`` documents; an unknown word (null) counts as one that is everywhere."""
    share = F.coalesce(df / docs, F.lit(1.0))
    return F.lit(smooth) / (F.lit(smooth) + share)


def width(df: DataFrame, vector: str) -> int:
    """The number of dimensions, from one row."""
    first = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    return first[0] if first else 0


def weighted_mean(df: DataFrame, by: str, vector: str, weight: Column | None = None, dims: int | None = None) -> DataFrame:
    """``by`` and ``mean``: the weighted mean of each group's vectors.

    A sum for each dimension, added up ahead of the exchange: a group of any
    size sends one row from each task.
    """
    dims = width(df, vector) if dims is None else dims
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(by, w.alias("__w"), F.col(vector).alias("__v"))
    sums = rows.groupBy(by).agg(F.sum("__w").alias("__t"), *[F.sum(F.col("__w") * F.col("__v")[i].cast("double")).alias(f"__s{i}") for i in range(dims)])
    return sums.select(by, F.array(*[F.when(F.col("__t") > 0, F.col(f"__s{i}") / F.col("__t")).otherwise(F.col(f"__s{i}")) for i in range(dims)]).alias("mean"))


def features(tokens: DataFrame, words: DataFrame, by: str, smooth: float | None = SMOOTH_CENTROID) -> DataFrame:
    """``by`` and ``vector``: the mean of the unit vectors of each group's tokens at length 1.

    ``tokens`` has ``by`` and ``token``, ``words`` has ``token``, ``vector``,
    ``df``, ``docs``. With ``smooth``, words weigh by their inverse frequency.
    Unknown tokens count for nothing; a group without a known one has no row.
    """
    known = tokens.join(words.select("token", unit(F.col("vector")).alias("__u"), "df", "docs"), "token")
    weight = None if smooth is None else word_weight(F.col("df"), F.col("docs"), smooth)
    return weighted_mean(known, by, "__u", weight, width(words, "vector")).select(by, unit(F.col("mean")).alias("vector"))


def query_directions(tokens: DataFrame, words: DataFrame, by: str, smooth: float = SMOOTH) -> DataFrame:
    """``by`` and ``vector``: what a document's cosines to all tokens of a query add up to as one product.

    The weighted mean of cosines to several words is the product with the
    weighted mean of their unit vectors, so one vector stands for a query.
    """
    known = tokens.join(words.select("token", unit(F.col("vector")).alias("__u"), "df", "docs"), "token")
    return weighted_mean(known, by, "__u", word_weight(F.col("df"), F.col("docs"), smooth), width(words, "vector")).withColumnRenamed("mean", "vector")


def _slices_of(matrix: DataFrame, key: str, vector: str) -> list[tuple[pa.Array, np.ndarray]]:
    """The rows of a small table as matrices of at most ``MATRIX_BYTES``, in order of the key."""
    rows = matrix.select(key, vector).orderBy(key)
    names, parts, held, out = [], [], 0, []
    for r in rows.toLocalIterator():
        names.append(r[0])
        parts.append(np.array(r[1], np.float64))
        held += parts[-1].nbytes
        if held >= MATRIX_BYTES:
            out.append((names, np.stack(parts)))
            names, parts, held = [], [], 0
    return out + ([(names, np.stack(parts))] if parts else [])


def products(rows: DataFrame, key: str, vector: str, matrix: DataFrame, other: str, other_vector: str, top: int, of: str = "row") -> DataFrame:
    """Key, ``other`` and ``score``: products of all rows with all vectors of a matrix, the best of them.

    With ``of="row"`` the ``top`` vectors of each row stay; with
    ``of="matrix"`` the ``top`` rows of each vector, first in each batch and
    then in all. Scores are rounded to 6 digits and tie by the larger row
    key and the smaller vector key.
    """
    kinds = rows.schema[key].dataType, matrix.schema[other].dataType
    schema = T.StructType([T.StructField(key, kinds[0]), T.StructField(other, kinds[1]), T.StructField("score", T.DoubleType())])
    out, kind = None, to_arrow_type(kinds[1])
    for names, values in _slices_of(matrix, other, other_vector):
        shared = rows.sparkSession.sparkContext.broadcast((names, values))

        def run(batches, shared=shared):
            names, values = shared.value
            for batch in batches:
                keep = batch.filter(pa.compute.is_valid(batch.column(1)))
                if not keep.num_rows:
                    continue
                flat = np.asarray(keep.column(1).flatten()).astype(np.float64).reshape(keep.num_rows, -1)
                score = np.round(np.nan_to_num(flat @ values.T), 6)
                if of == "row":
                    n = min(top, score.shape[1])
                    # A stable sort keeps the smaller vector key first among equals.
                    best = np.argsort(-score, axis=1, kind="stable")[:, :n]
                    i, j = np.repeat(np.arange(len(score)), n), best.ravel()
                else:
                    order = np.argsort(np.asarray(keep.column(0)), kind="stable")[::-1]
                    n = min(top, score.shape[0])
                    best = order[np.argsort(-score[order], axis=0, kind="stable")[:n]]
                    i, j = best.T.ravel(), np.repeat(np.arange(score.shape[1]), n)
                yield pa.RecordBatch.from_arrays([keep.column(0).take(pa.array(i)), pa.array([names[k] for k in j], kind), pa.array(score[i, j])], names=[key, other, "score"])

        part = rows.select(key, vector).mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], schema)
    by, order = (key, [F.desc("score"), F.col(other)]) if of == "row" else (other, [F.desc("score"), F.desc(key)])
    return out.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= top).drop("__n")


def gated(queries: DataFrame, query: str, centroids: DataFrame, coverage: float = 0.2, least: int = 8) -> DataFrame:
    """Query and ``label``: the nearest clusters that hold the share of the documents and are enough in number.

    ``centroids`` has ``label``, ``vector`` and ``n``, the documents of the
    cluster. There are as many rows as clusters, each scored by all queries.
    """
    total = centroids.agg(F.sum("n")).first()[0] or 0
    scored = products(centroids, "label", "vector", queries, query, "vector", top=1 << 30, of="row").join(centroids.select("label", "n"), "label")
    order = Window.partitionBy(query).orderBy(F.desc("score"), "label")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = scored.withColumn("__held", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("__place", F.row_number().over(order) - 1)
    return placed.where((F.col("__held") < max(1, int(coverage * total))) | (F.col("__place") < least)).select(query, "label")


def cosine_rank(docs: DataFrame, key: str, queries: DataFrame, query: str, gate: DataFrame | None = None, best: int | None = None) -> DataFrame:
    """Query, key and ``score`` of documents by the product of their unit vectors with the query's.

    ``docs`` has the key, ``label`` and ``vector``. With ``gate`` (query,
    label) only documents of those clusters have a score. With ``best``,
    scores are rounded to 6 digits and of each batch only so many come out
    for each query, of equals those of larger keys: a bounded number of rows
    for each batch goes on to a ranking.
    """
    kinds = queries.schema[query].dataType, docs.schema[key].dataType
    schema = T.StructType([T.StructField(query, kinds[0]), T.StructField(key, kinds[1]), T.StructField("score", T.DoubleType())])
    kind, out = to_arrow_type(kinds[0]), None
    allowed: dict = {}
    for q, label in gate.select(query, "label").toLocalIterator() if gate is not None else ():
        allowed.setdefault(q, []).append(label)
    for names, values in _slices_of(queries, query, "vector"):
        shared = docs.sparkSession.sparkContext.broadcast((names, values, None if gate is None else [allowed.get(q, []) for q in names]))

        def run(batches, shared=shared):
            names, values, labels = shared.value
            of, by = pa.array(names, kind), {}
            for q, some in enumerate(labels or ()):
                for label in some:
                    by.setdefault(label, []).append(q)
            every = np.arange(len(names))
            for batch in batches:
                at = np.asarray(batch.column(1).to_pandas()) if labels is not None else None
                groups = [(np.flatnonzero(at == label), np.array(qs)) for label, qs in by.items()] if labels is not None else [(np.flatnonzero(np.asarray(pa.compute.is_valid(batch.column(1)))), every)]
                kept: list = []
                for rows, qs in groups:
                    for some in (rows[k : k + PART] for k in range(0, len(rows), PART)):
                        mine = batch.column(2).take(pa.array(some))
                        score = cosines(mine, values[qs])
                        # What has no product has no score, and stands last.
                        score[~np.asarray(pa.compute.equal(pa.compute.list_value_length(mine), values.shape[1]).fill_null(False))] = -np.inf
                        if best is None:
                            i, j = np.nonzero(np.ones_like(score, bool))
                        else:
                            keys, score = np.argsort(np.argsort(np.asarray(batch.column(0)), kind="stable"))[some], np.round(score, 6)
                            i, j = np.nonzero(first(np.ones_like(score, bool), score, keys, best))
                        kept.append((qs[j], some[i], score[i, j]))
                for j, i, score in kept:
                    yield pa.RecordBatch.from_arrays([of.take(pa.array(j)), batch.column(0).take(pa.array(i)), pa.array(score, mask=np.isneginf(score))], names=schema.names)

        part = docs.select(key, "label", "vector").mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def related(words: DataFrame, asked: DataFrame, by: str, n: int = 15, k: int = 5) -> DataFrame:
    """``by``, ``token`` and ``score``: the words nearest to each group of tokens, and those nearest to each of its tokens.

    The ``n`` nearest of the group's centroid and the ``k`` nearest of each
    token, less the tokens themselves; a word has its best score.
    """
    unit_words = words.select("token", unit(F.col("vector")).alias("vector"))
    whole = features(asked, words, by, smooth=None)
    near = products(unit_words, "token", "vector", whole, by, "vector", n, of="matrix")
    single = asked.select("token").distinct().join(unit_words, "token").select(F.col("token").alias("__of"), "vector")
    # One more than asked: each word is its own nearest.
    own = products(unit_words, "token", "vector", single, "__of", "vector", k + 1, of="matrix").where("token <> __of")
    own = own.withColumn("__n", F.row_number().over(Window.partitionBy("__of").orderBy(F.desc("score"), F.desc("token")))).where(F.col("__n") <= k).drop("__n")
    from_tokens = asked.select(by, F.col("token").alias("__of")).join(own, "__of").select(by, "token", "score")
    found = near.select(by, "token", "score").unionAll(from_tokens)
    return found.join(asked.select(by, "token"), [by, "token"], "left_anti").groupBy(by, "token").agg(F.max("score").alias("score"))


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of vectors, their mean and their scatter about it.

    Each batch sends one matrix of the size of the dimensions, and the parts
    are added up before they reach the driver.
    """
    dims = width(df, vector)

    def run(batches):
        n, s, g = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            keep = batch.filter(pa.compute.is_valid(batch.column(0)))
            x = np.asarray(keep.column(0).flatten()).astype(np.float64).reshape(keep.num_rows, -1)
            if len(x):
                n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        flat = np.concatenate([[n], s, g.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "value"])

    total = df.select(vector).mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").toPandas()["value"].to_numpy()
    if not len(total) or not total[0]:
        return 0, np.zeros(dims), np.zeros((dims, dims))
    n, mean = int(total[0]), total[1 : 1 + dims] / total[0]
    return n, mean, total[1 + dims :].reshape(dims, dims) - n * np.outer(mean, mean)


def components(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean, the first ``k`` principal directions and their shares of the variance; signs make the largest entry positive."""
    _, mean, scatter = moments(df, vector)
    values, vectors = np.linalg.eigh(scatter)
    order = np.argsort(-values)[:k]
    axes = vectors[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None] if len(axes) else 1
    return mean, axes, values[order] / max(values.sum(), 1e-300)


def _mapped(df: DataFrame, vector: str, f) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(v: pd.Series) -> pd.Series:
        some = v.notna()
        rows = iter(f(np.stack(v[some].to_list()).astype(np.float64)) if some.any() else ())
        return pd.Series([next(rows) if s else None for s in some], index=v.index, dtype=object)

    return df.withColumn(vector, apply(F.col(vector)))


def without_component(df: DataFrame, vector: str = "vector", k: int = 1) -> DataFrame:
    """The vectors less their parts along the first ``k`` principal directions, at length 1 again."""
    _, axes, _ = components(df, vector, k)

    def take(x: np.ndarray) -> np.ndarray:
        x = x - (x @ axes.T) @ axes
        return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)

    return _mapped(df, vector, take)


def all_but_the_top(df: DataFrame, vector: str = "vector", most: int = 3, least_share: float = 0.02, least_ratio: float = 1.5) -> DataFrame:
    """The vectors less their mean and less the leading principal directions.

    A direction goes while it has at least ``least_share`` of the variance
    and ``least_ratio`` times that of the next; ``most`` of 0 takes away the
    mean alone, below 0 nothing.
    """
    if most < 0:
        return df
    mean, axes, shares = components(df, vector, most)
    n = 0
    while n < len(shares) and shares[n] >= least_share and (n + 1 == len(shares) or shares[n] / max(shares[n + 1], 1e-300) >= least_ratio):
        n += 1
    axes = axes[:n]
    return _mapped(df, vector, lambda x: (x - mean) - ((x - mean) @ axes.T) @ axes)


def clusters(df: DataFrame, vector: str = "vector", k: int | None = None, dims: int = 64, seed: int = 0) -> DataFrame:
    """``df`` with ``cluster``: k-means on the first principal directions; a cluster for 200 rows, two at least."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    count = df.count() if k is None else 0
    mean, axes, _ = components(df, vector, min(dims, width(df, vector)))
    reduced = _mapped(df.withColumn("__v", F.col(vector)), "__v", lambda x: (x - mean) @ axes.T).withColumn("__v", array_to_vector("__v"))
    model = KMeans(k=k or max(2, count // 200), seed=seed, featuresCol="__v", predictionCol="cluster", maxIter=50).fit(reduced)
    return model.transform(reduced).drop("__v")


def clipped(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A score within bounds; what is no number counts as 0."""
    return F.least(F.greatest(F.nanvl(score, F.lit(0.0)), F.lit(low)), F.lit(high))
