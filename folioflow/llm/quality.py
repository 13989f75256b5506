"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Labelled documents become vectors: binary terms (words, and shape terms such
as the share of repeated or symbol-laden tokens), each weighted by the square
of its log odds ratio for the label, less two standard errors, reduced by a truncated singular value
decomposition. Quality and toxicity have a space each. The labelled vectors
are broadcast; every document is folded into the same space, its cosine to
every labelled vector is computed in blocks, and the labels of the nearest
are averaged with their similarities as weights. A document's own label never
votes on it, nor does that of a document with the same text.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.textkit import TOKEN, checkpointed, slices

#: Labelled documents at most, those of least MD5 of their key. The bound of what is broadcast.
TRAINING = 4000
#: A term's log odds ratio stands at least so many standard errors from 0.
SURENESS = 3.0
DIMENSIONS = 64
#: The weight of the term that every text has, so that texts without telling terms have neighbours too.
BIAS = 4.0
#: Neighbours count by this power of their similarity.
POWER = 4
NEIGHBOURS = 15
_BLOCK = 512

_SYMBOLS = re.compile(r"[^\w\s]{2,}")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}")
_STEPS = (0.0, 0.02, 0.1, 0.3, 0.6)


def terms_of(text: str) -> set[str]:
    """The words of a text and its shape terms, which start with ``#``."""
    tokens = TOKEN.findall(text.lower())
    out = set(tokens)
    n = len(tokens) or 1
    lines = [x for x in text.split("\n") if x]
    shares = {
        "repeat": sum(map(eq, tokens, tokens[1:])) / n,
        "symbol": len(_SYMBOLS.findall(text)) / n,
        "pipe": text.count("|") / n,
        "bang": text.count("!") / n,
        "capital": len(_CAPITALS.findall(text)) / n,
        "same": 1 - len(out) / n,
        "lines": 1 - len(set(lines)) / (len(lines) or 1),
    }
    out.update(f"#{name}>{s}" for name, share in shares.items() for s in _STEPS if share > s)
    out.add(f"#length{min(len(tokens), 4096).bit_length()}")
    return out


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


class Space:
    """The latent-semantic space of one label, with the labelled vectors in it."""

    def __init__(self, terms: dict[str, float], labels: np.ndarray, found: list[set[str]]) -> None:
        self.index = {t: i for i, t in enumerate(terms)}
        self.weights = np.array([*terms.values(), BIAS], np.float32)
        self.labels = labels.astype(np.float64)
        x = self._weighted(found)
        self.basis = self._right_vectors(x)
        self.points = self._unit(x @ self.basis)

    def _weighted(self, found: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(found), len(self.weights)), np.float32)
        index = self.index
        for i, terms in enumerate(found):
            hits = [index[t] for t in terms & index.keys()]
            x[i, hits] = self.weights[hits]
        x[:, -1] = self.weights[-1]
        return self._unit(x)

    @staticmethod
    def _right_vectors(x: np.ndarray) -> np.ndarray:
        """The right singular vectors of the largest singular values, from the smaller of the two Gram matrices."""
        wide = x.shape[1] > x.shape[0]
        values, vectors = np.linalg.eigh((x @ x.T if wide else x.T @ x).astype(np.float64))
        top = np.argsort(-values)[:DIMENSIONS]
        top = top[values[top] > 1e-6 * max(values.max(), 1e-12)]
        return (x.T @ vectors[:, top] / np.sqrt(values[top]) if wide else vectors[:, top]).astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def vote(self, found: list[set[str]], own: list[set[int]]) -> np.ndarray:
        """The mean label of each text's neighbours, but for its own places; NaN where none is similar."""
        n = len(self.points)
        k = min(NEIGHBOURS, n)
        cosine = self._unit(self._weighted(found) @ self.basis) @ self.points.T
        for i, places in enumerate(own):
            cosine[i, list(places)] = -2
        # Rounded similarities tie by the labelled document's place.
        order = np.rint(cosine * 1e6).astype(np.int64) * n - np.arange(n)
        near = np.argpartition(-order, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1), np.nan)


class Model:
    """One space for quality and one for toxicity over the same labelled documents."""

    def __init__(self, terms: list[dict[str, float]], ids: list[tuple[int, list[str]]], labels: np.ndarray, found: list[set[str]]) -> None:
        self.by_text = {t: i for i, (t, _) in enumerate(ids)}
        self.by_key: dict[str, set[int]] = {}
        for i, (_, keys) in enumerate(ids):
            for k in keys:
                self.by_key.setdefault(k, set()).add(i)
        self.spaces = [Space(t, labels[:, j], found) for j, t in enumerate(terms)]

    def vote(self, keys: list, texts: list[str]) -> np.ndarray:
        """The quality and toxicity of each text, NaN where no labelled document is similar."""
        out = np.zeros((len(texts), 2))
        for start in range(0, len(texts), _BLOCK):
            stop = min(start + _BLOCK, len(texts))
            found = [terms_of(t) for t in texts[start:stop]]
            places = [self.by_text.get(text_hash(t)) for t in texts[start:stop]]
            own = [self.by_key.get(k, set()) | ({p} if p is not None else set()) for k, p in zip(keys[start:stop], places, strict=True)]
            for j, space in enumerate(self.spaces):
                out[start:stop, j] = space.vote(found, own)
        return out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", training: int = TRAINING) -> Model | None:
    """Fit the model on at most ``training`` labelled documents.

    Repeated labels of a key count as the worst of them; null labels, keys
    and texts don't take part. ``None`` where there is no labelled document;
    where no term tells labels apart, all labelled documents are alike and
    the first of them vote.
    """
    judged = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col(key).isNotNull())
    judged = judged.groupBy(F.col(key).cast("string").alias("k")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = judged.withColumn("h", F.md5("k")).orderBy("h", "k").limit(training).drop("h")
    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("t IS NOT NULL AND t <> ''")
    # Copies of one text are one labelled document, else their chance words would look telling.
    sample = checkpointed(rows.join(F.broadcast(chosen), "k").groupBy("t").agg(F.sort_array(F.collect_set("k")).alias("k"), F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).select("k", "t", "quality", "toxic"))

    def words(batches):
        for batch in batches:
            for piece in slices(batch, 1):
                names, flags = [], []
                for t, q, x in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True):
                    found = sorted(terms_of(t))
                    names += found
                    flags += [(int(q), int(x))] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f[0] for f in flags], pa.int32()), pa.array([f[1] for f in flags], pa.int32())], names=["term", "quality", "toxic"])

    total = sample.agg(F.count("*").alias("n"), F.sum("quality").alias("q"), F.sum("toxic").alias("x")).first()
    if not total["n"]:
        return None

    def odds(hit: str, of: int) -> tuple[F.Column, F.Column]:
        """The weight of a term for a label, and how many standard errors its log odds ratio has."""
        a, b = F.col(hit) + 0.5, F.col("n") - F.col(hit) + 0.5
        c, d = F.lit(of) - F.col(hit) + 0.5, F.lit(total["n"] - of) - F.col("n") + F.col(hit) + 0.5
        ratio, error = F.abs(F.log(a * d / (b * c))), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        return F.pow(ratio - 2 * error, F.lit(2)), ratio / error

    counted = checkpointed(sample.mapInArrow(words, "term string, quality int, toxic int").groupBy("term").agg(F.count("*").alias("n"), F.sum("quality").alias("q"), F.sum("toxic").alias("x")))
    chosen_terms = []
    for hit, of in (("q", int(total["q"])), ("x", int(total["x"]))):
        weight, surely = odds(hit, of)
        best = counted.select("term", weight.alias("w"), surely.alias("z")).where(F.col("z") >= SURENESS).orderBy(F.desc("z"), "term").collect()
        chosen_terms.append({r["term"]: r["w"] for r in best})
    wanted = set().union(*chosen_terms)

    def find(batches):
        for batch in batches:
            hits = [sorted(terms_of(x) & wanted) for x in batch.column(1).to_pylist()]
            texts = pa.array([np.uint64(text_hash(x)).astype(np.int64) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, batch.column(2).cast(pa.int32()), batch.column(3).cast(pa.int32()), pa.array(hits, pa.list_(pa.string()))], names=["k", "t", "quality", "toxic", "hits"])

    rows = sorted(sample.mapInArrow(find, "k array<string>, t bigint, quality int, toxic int, hits array<string>").collect(), key=lambda r: r["k"])
    return Model(chosen_terms, [(r["t"] % (1 << 64), r["k"]) for r in rows], np.array([[r["quality"], r["toxic"]] for r in rows]), [set(r["hits"]) for r in rows])


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, ``quality_score``, ``toxicity_score``, ``keep``.

    A document is kept if its quality score is at least 0.5 and its toxicity
    score less. A null or empty text has null scores and isn't kept; without
    a model every other document is kept with null scores. Where no labelled
    document but its own is similar, a score is null and rejects nothing.
    Ties go to the labelled document of the first key. Whole texts are read;
    repeated rows get equal scores; an empty table gives an empty result;
    other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 2):
                texts = batch.column(2).to_pylist()
                scores = _scores(shared.value, batch.column(1).to_pylist(), texts)
                keep = [bool(t) and _passes(s) for t, s in zip(texts, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s, mask=np.isnan(s)) for s in scores.T), pa.array(keep, pa.bool_())], names=["key", "quality_score", "toxicity_score", "keep"])

    out = docs.select(F.col(key).alias("key"), F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("text"))
    return out.mapInArrow(run, f"key {kind}, quality_score double, toxicity_score double, keep boolean").withColumnRenamed("key", key)


def _passes(scores: np.ndarray) -> bool:
    return not (scores[0] < 0.5 or scores[1] >= 0.5)


def _scores(model: Model | None, keys: list, texts: list[str | None]) -> np.ndarray:
    scores = np.full((len(texts), 2), np.nan)
    some = [i for i, t in enumerate(texts) if t]
    if model and some:
        scores[some] = model.vote([keys[i] for i in some], [texts[i] for i in some])
    return scores


def keep_good(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps (see :func:`score`), with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k, t = docs.columns.index(key), docs.columns.index(text)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, t):
                texts = batch.column(t).to_pylist()
                scores = _scores(shared.value, [None if x is None else str(x) for x in batch.column(k).to_pylist()], texts)
                yield batch.filter(pa.array([bool(x) and _passes(s) for x, s in zip(texts, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where("keep").drop("keep")
