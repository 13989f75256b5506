"""N-grams: training by normalised pointwise mutual information, replacement, vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.tokens import members_of, singular
from folioflow.operators.graph import written

#: N-grams that are broadcast at most; more are found by joins.
BROADCAST = 1_000_000
#: Rows whose tokens are numbered at a time.
PART = 1024
#: Words that an apostrophe makes look like a beginning.
NO_START = ("l'", "d'")


def _phrases(words: Column, connectors: Sequence[str] = ()) -> Column:
    """Each word with the next one that is no connector, and the connectors between: ``a``, ``b``, ``phrase``."""
    placed = F.transform(words, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    if connectors:
        placed = F.filter(placed, lambda p: ~p["x"].isin(*connectors))
    n = F.greatest(F.size(placed) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(placed, 1, n), F.slice(placed, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(pairs, lambda p: F.struct(p["a"]["x"].alias("a"), p["b"]["x"].alias("b"), F.array_join(F.slice(words, p["a"]["i"] + 1, p["b"]["i"] - p["a"]["i"] + 1), "_").alias("phrase")))


def _counted(sentences: DataFrame, column: str) -> DataFrame:
    """``pair``, ``a``, ``b``, ``phrase``, ``n``: how often tokens (``pair`` false, in ``a``) and neighbours occur, added up by Arrow batch."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0).drop_null()
            flat = lists.flatten()
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            words, ids = coded.dictionary, np.asarray(coded.indices.fill_null(-1)).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), np.asarray(pa.compute.list_value_length(lists)))
            near = (row[1:] == row[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0)
            pairs, n = np.unique(ids[:-1][near] * len(words) + ids[1:][near], return_counts=True)
            left, right = words.take(pa.array(pairs // max(len(words), 1))), words.take(pa.array(pairs % max(len(words), 1)))
            none = pa.nulls(len(pairs), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(pairs), bool)), left.cast(pa.string()), right.cast(pa.string()), none, pa.array(n)], names=["pair", "a", "b", "phrase", "n"])
            single = np.bincount(ids + 1, minlength=len(words) + 1)
            names = pa.concat_arrays([pa.nulls(1, words.type), words]).cast(pa.string())
            none = pa.nulls(len(single), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(single), bool)), names, none, none, pa.array(single)], names=["pair", "a", "b", "phrase", "n"])

    return sentences.select(column).mapInArrow(run, "pair boolean, a string, b string, phrase string, n bigint")


def score_bigrams(sentences: DataFrame, column: str = "tokens", min_count: int = 10, connectors: Sequence[str] = ()) -> DataFrame:
    """``phrase``, ``n``, ``npmi`` of all neighbours that occur often enough.

    ``npmi = ln(p(ab) / (p(a) p(b))) / -ln p(ab)`` over the number of tokens.
    The sentences are read once (twice with connectors): tokens and
    neighbours are counted by batch ahead of one exchange, and what occurs
    often enough is written for the joins.
    """
    counts = _counted(sentences, column)
    if connectors:
        w = sentences.select(F.col(column).alias("w"))
        told = w.select(F.explode(_phrases(F.col("w"), connectors)).alias("p")).groupBy("p.a", "p.b", "p.phrase").agg(F.count("*").alias("n"))
        counts = counts.where("NOT pair").unionByName(told.withColumn("pair", F.lit(True)))
    summed = counts.groupBy("pair", "a", "b", "phrase").agg(F.sum("n").alias("n"))
    kept = written(summed.where(~F.col("pair") | (F.col("n") >= min_count)))
    two = kept.where("pair").select("a", "b", F.coalesce("phrase", F.concat_ws("_", "a", "b")).alias("phrase"), "n")
    one = kept.where("NOT pair").select(F.col("a").alias("token"), F.col("n").alias("m"))
    total = F.broadcast(one.agg(F.sum("m").alias("total")))
    scored = two.join(one.toDF("a", "x"), "a").join(one.toDF("b", "y"), "b").join(total)
    share = F.col("n") / F.col("total")
    npmi = F.log(share / (F.col("x") / F.col("total") * (F.col("y") / F.col("total")))) / -F.log(share)
    return scored.select("phrase", "n", npmi.alias("npmi"))


def _greedy(words: Column, hits: Column) -> Column:
    """The words with the phrases among ``hits`` merged from the left, the longest at each place.

    ``hits`` has structs of ``i``, the place counted from 0, and ``size``.
    """
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        size = F.coalesce(F.array_max(F.transform(F.filter(hits, lambda h: h["i"] == i), lambda h: h["size"])), F.lit(1))
        word = F.array_join(F.slice(words, i + 1, size), "_")
        return F.when(i < s["at"], s).otherwise(F.struct((i + size).alias("at"), F.array_append(s["out"], word).alias("out")))

    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, state, step, lambda s: s["out"])


def replaced(ngrams: dict[str, dict], words: list[str]) -> list[str]:
    """The words with the n-grams of a prefix tree merged from the left, the longest at each place."""
    out, i = [], 0
    while i < len(words):
        if words[i] not in ngrams:
            out.append(words[i])
            i += 1
            continue
        node, best = ngrams, i + 1
        for j in range(i, len(words)):
            node = node.get(words[j])
            if node is None:
                break
            if None in node and j > i:
                best = j + 1
        out.append("_".join(words[i:best]))
        i = best
    return out


def tree_of(ngrams: Sequence[Sequence[str]]) -> dict:
    """A prefix tree of n-grams; a node that ends one has the key ``None``."""
    root: dict = {}
    for members in ngrams:
        if len(members) > 1 and members[0] not in NO_START:
            node = root
            for word in members:
                node = node.setdefault(word, {})
            node[None] = {}
    return root


def lookup(tree: dict, members: Sequence[str]) -> str | None:
    """The n-gram of just these members, if the tree has it."""
    for word in members:
        tree = tree.get(word)
        if tree is None:
            return None
    return "_".join(members) if None in tree else None


def replace_ngrams(df: DataFrame, ngrams: DataFrame, column: str = "tokens", bound: int = BROADCAST) -> DataFrame:
    """``df`` with the n-grams among the tokens merged, the longest from the left.

    ``ngrams`` has ``members``. Up to ``bound`` of them are broadcast as a
    prefix tree; more are joined with the runs of tokens of their lengths.
    Both ways give the same. Null tokens stay null.
    """
    usable = ngrams.select("members").where((F.size("members") > 1) & ~F.element_at("members", 1).isin(*NO_START)).distinct()
    if usable.count() <= bound:
        tree = df.sparkSession.sparkContext.broadcast(tree_of([r["members"] for r in usable.collect()]))

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def merge(tokens: pd.Series) -> pd.Series:
            return tokens.map(lambda x: replaced(tree.value, list(x)), na_action="ignore")

        return df.withColumn(column, merge(F.col(column)))
    sizes = [r[0] for r in usable.select(F.size("members")).distinct().collect()]
    rows = df.withColumn("__id", F.monotonically_increasing_id())
    start = lambda n: F.when(F.size(column) >= n, F.sequence(F.lit(0), F.size(column) - n)).otherwise(F.array().cast("array<int>"))
    run = lambda n: lambda i: F.struct(i.alias("i"), F.lit(n).alias("size"), F.array_join(F.slice(column, i + 1, n), "_").alias("run"))
    runs = F.flatten(F.array(*[F.transform(start(n), run(n)) for n in sorted(sizes)]))
    told = rows.select("__id", F.explode(runs).alias("r")).select("__id", "r.*").join(usable.select(F.array_join("members", "_").alias("run")), "run", "left_semi")
    hits = told.groupBy("__id").agg(F.collect_list(F.struct("i", "size")).alias("__hits"))
    none = F.array().cast("array<struct<i:int,size:int>>")
    return rows.join(hits, "__id", "left").withColumn(column, F.when(F.col(column).isNotNull(), _greedy(F.col(column), F.coalesce("__hits", none)))).drop("__id", "__hits")


def train_ngrams(sentences: DataFrame, column: str = "tokens", min_count: int = 10, threshold: float = 0.7, connectors: Sequence[str] = (), passes: int = 2) -> DataFrame:
    """``ngram`` and ``members``: phrases of neighbours above the threshold, and of those phrases again.

    Each pass scores neighbours in the sentences as the pass before has
    merged them; all phrases of all passes are in the result.
    """
    found, current = None, sentences.select(F.col(column).alias("w"))
    for k in range(passes):
        phrases = score_bigrams(current, "w", min_count, connectors).where(F.col("npmi") > threshold).select("phrase")
        ngrams = phrases.select(members_of(F.col("phrase")).alias("members")).where("members IS NOT NULL").distinct()
        found = ngrams if found is None else found.unionAll(ngrams)
        if k + 1 < passes:
            current = replace_ngrams(current, ngrams.withColumn("members", F.split(F.array_join("members", "_"), "_")) if k else ngrams, "w")
    return found.distinct().select(F.array_join("members", "_").alias("ngram"), "members")


def resolve_tokens(tokens: DataFrame, vocabulary: DataFrame, min_ratio: float = 1.0) -> DataFrame:
    """``token`` and ``resolved``: compounds under the most frequent of their spellings.

    ``tokens`` has ``token``; ``vocabulary`` ``token`` and ``n``. Spellings of
    a compound are its words run together, in the singular, and both. One
    that is in the vocabulary takes the token's place if the token isn't, or
    if it is at least ``min_ratio`` times as frequent; of equals, the first.
    """
    names = tokens.select("token").distinct()
    compound = F.col("token").rlike("^.+_.+$") & ~F.col("token").rlike("^_[^_]*_$")
    single = F.transform(F.split("token", "_"), singular)
    spellings = F.array(*[F.struct(F.lit(-i).alias("place"), c.alias("spelling")) for i, c in enumerate((F.replace("token", F.lit("_"), F.lit("")), F.array_join(single, "_"), F.array_join(single, "")))])
    tried = names.where(compound).select("token", F.explode(spellings).alias("s")).select("token", "s.place", "s.spelling").where("spelling <> token")
    best = tried.join(vocabulary.select(F.col("token").alias("spelling"), "n"), "spelling").groupBy("token").agg(F.max(F.struct("n", "place", "spelling")).alias("best"))
    own = names.join(best, "token", "left").join(vocabulary.select("token", F.col("n").alias("own")), "token", "left")
    return own.select("token", F.when(F.coalesce("own", F.lit(0)) * F.lit(min_ratio) <= F.col("best.n"), F.col("best.spelling")).otherwise(F.col("token")).alias("resolved"))


def token_ids(df: DataFrame, vocabulary: DataFrame, key: str, column: str = "tokens", bound: int = BROADCAST) -> DataFrame:
    """Key and ``ids``: the numbers of the tokens in the vocabulary (``token``, ``id``), in order, unknown ones left out.

    Up to ``bound`` tokens are broadcast, and each batch is numbered where it
    is read; more are joined. Both ways give the same, an empty list for null.
    """
    known = vocabulary.select("token", F.col("id").cast("bigint").alias("id")).where("token IS NOT NULL AND id IS NOT NULL").limit(bound + 1).collect()
    if len(known) > bound:
        rows = df.select(key, F.posexplode_outer(column).alias("at", "token"))
        placed = rows.join(vocabulary, "token", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "id")))).alias("found"))
        return placed.select(key, F.transform("found", lambda x: x["id"]).alias("ids"))
    shared = df.sparkSession.sparkContext.broadcast((pa.array([r[0] for r in known], pa.string()), np.array([r[1] for r in known], np.int64)))

    def run(batches):
        words, numbers = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, PART):
                part = batch.slice(start, PART)
                sizes = np.asarray(pa.compute.list_value_length(part.column(1)).fill_null(0)).astype(np.int64)
                at = pa.compute.index_in(part.column(1).flatten(), value_set=words)
                hit = np.asarray(pa.compute.is_valid(at))
                ends = np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(sizes)])]
                ids = numbers[np.asarray(at.drop_null()).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int64()))], names=[key, "ids"])

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.LongType()))])
    return df.select(key, F.col(column).cast("array<string>")).mapInArrow(run, schema)
