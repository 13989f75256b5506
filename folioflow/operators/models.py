"""Models: word vectors with an output space, hashed n-gram vectors, text classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators.vectors import features

#: Words of a model at most: what the factorisation on the driver is bounded by.
VOCABULARY = 20_000
_GRAMS = range(3, 7)


def word_vectors(sentences: DataFrame, column: str = "tokens", dims: int = 100, window: int = 5, min_count: int = 5, most: int = VOCABULARY, shift: float = 1.0, seed: int = 0) -> DataFrame:
    """``token``, ``n``, ``vector`` and ``out``: vectors of words and of contexts from one factorisation.

    Skip-grams with negative sampling factorise the shifted pointwise mutual
    information of words and contexts; here that matrix is counted by Spark
    and factorised by a truncated singular value decomposition, whose two
    sides are the input and the output vectors. The ``most`` frequent words
    with at least ``min_count`` occurrences take part, a documented bound of
    the model, not of the text: every sentence is counted.
    """
    w = sentences.select(F.col(column).alias("w"))
    counts = w.select(F.explode("w").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    vocabulary = counts.orderBy(F.desc("n"), "token").limit(most).withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1)
    names = vocabulary.orderBy("id").collect()
    n = len(names)
    schema = "token string, n bigint, vector array<double>, out array<double>"
    if n < 2:
        return sentences.sparkSession.createDataFrame([], schema)
    near = F.flatten(F.transform("w", lambda x, i: F.transform(F.slice(F.col("w"), i + 2, window), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = w.select(F.explode(near).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("c"))
    ids = F.broadcast(vocabulary.select("token", "id"))
    cells = pairs.join(ids.toDF("a", "i"), "a").join(ids.toDF("b", "j"), "b").select("i", "j", "c").toArrow()
    i, j, c = (np.asarray(cells.column(k)) for k in ("i", "j", "c"))
    i, j, c = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([c, c]).astype(np.float64)
    order = np.lexsort((j, i))
    i, j, c = i[order], j[order], c[order]
    at = np.nonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])))[0]
    i, j, c = i[at], j[at], np.add.reduceat(c, at)
    total, rows = c.sum(), np.bincount(i, weights=c, minlength=n)
    value = np.maximum(np.log(c * total / (rows[i] * rows[j])) - np.log(shift), 0)

    def times(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The sparse matrix with rows ``a`` and columns ``b`` times ``x``."""
        out = np.zeros((n, x.shape[1]))
        for k in range(x.shape[1]):
            out[:, k] = np.bincount(a, weights=value * x[b, k], minlength=n)
        return out

    k = min(dims, n - 1)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, min(n, k + 10))))[0]
    for _ in range(6):
        q = np.linalg.qr(times(times(q, i, j), j, i))[0]
    b = times(q, i, j)
    left, sigma, right = np.linalg.svd(b, full_matrices=False)
    root = np.sqrt(sigma[:k])
    inner, outer = left[:, :k] * root, (q @ right.T)[:, :k] * root
    table = pa.table({"token": [r["token"] for r in names], "n": pa.array([r["n"] for r in names], pa.int64()), "vector": inner.tolist(), "out": outer.tolist()})
    return sentences.sparkSession.createDataFrame(table).select("token", "n", "vector", "out")


def gram_vector(token: Column, dims: int = 64) -> Column:
    """A vector for any word from its character n-grams of 3 to 6, hashed to signs: like spellings have like vectors."""
    padded = F.concat(F.lit("<"), token, F.lit(">"))
    starts = lambda n: F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.length(padded) - n + 1)).otherwise(F.array().cast("array<int>"))
    gram = lambda n: lambda i: F.substring(padded, i, F.lit(n))
    grams = F.flatten(F.array(*[F.transform(starts(n), gram(n)) for n in _GRAMS]))
    sums = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.when(F.pmod(F.xxhash64(g, d), F.lit(2)) == 0, 1.0).otherwise(-1.0)))
    return F.transform(sums, lambda x: x / F.greatest(F.size(grams), F.lit(1)))


def subword_vectors(words: DataFrame, tokens: DataFrame, dims: int) -> DataFrame:
    """``token`` and ``vector`` of every token: the model's where it knows the word, else one from its n-grams."""
    names = tokens.select("token").distinct()
    return names.join(words.select("token", "vector"), "token", "left").select("token", F.coalesce("vector", gram_vector(F.col("token"), dims)).alias("vector"))


def train_classifier(samples: DataFrame, words: DataFrame, key: str = "id", label: str = "label", kind: str = "linear", holdout: float = 0.05, seed: int = 0) -> tuple[PipelineModel, float | None]:
    """A model from the mean word vectors of labelled token lists, and its accuracy on held-out samples.

    ``samples`` has the key, ``tokens`` and the label; ``words`` has
    ``token``, ``vector``, ``df``, ``docs``. ``kind`` is ``linear`` (a linear
    support vector machine, one against the rest), ``logistic`` or
    ``forest``. Samples without a known word take no part.
    """
    learner = {
        "linear": lambda: OneVsRest(classifier=LinearSVC(maxIter=50, regParam=1e-3)),
        "logistic": lambda: LogisticRegression(maxIter=100, regParam=1e-3),
        "forest": lambda: RandomForestClassifier(numTrees=50, seed=seed),
    }.get(kind)
    if learner is None:
        raise ValueError("kind is linear, logistic or forest")
    rows = classifier_input(samples, words, key).join(samples.select(key, F.col(label).cast("string").alias("__label")), key)
    index = StringIndexer(inputCol="__label", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    # Which samples are held out follows from their keys.
    held = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1000)) < int(1000 * holdout)
    model = Pipeline(stages=[index, learner(), IndexToString(inputCol="prediction", outputCol="found", labels=index.labels)]).fit(rows.where(~held))
    tested = model.transform(rows.where(held)).agg(F.avg((F.col("found") == F.col("__label")).cast("double"))).first()[0]
    return model, tested


def classifier_input(samples: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """The key and ``features`` of token lists."""
    tokens = samples.select(key, F.explode("tokens").alias("token"))
    return features(tokens, words, key, smooth=None).select(key, array_to_vector("vector").alias("features"))


def classify(model: PipelineModel, samples: DataFrame, words: DataFrame, key: str = "id") -> DataFrame:
    """The key, ``label`` and ``probability`` (null where the model has none) of token lists with a known word."""
    rows = classifier_input(samples, words, key).withColumn("__label", F.lit(model.stages[0].labels[0]))
    out = model.transform(rows)
    best = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(None).cast(T.DoubleType())
    return out.select(key, F.col("found").alias("label"), best.alias("probability"))
