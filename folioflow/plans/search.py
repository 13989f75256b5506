"""Queries over words, vectors and rankings, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import index, ngrams, retrieval, vectors
from folioflow.operators.graph import written
from folioflow.plans.queries import _BM25, _CENTRE, _DOT, _TOK
from folioflow.plans.registered import query
from folioflow.sources.pages import SQL_PAGES, documents_as_pages, read


def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct tokens of each benchmark item, which stands for a query."""
    return read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"))


def word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token``, ``vector``, ``df``, ``docs`` of the words that queries use; vectors are those of ``embeddings``, given out in order."""
    e = read(spark, sf_dir, "embeddings")
    # The words of the queries are few: numbering them is a window over those alone.
    numbered = query_tokens(spark, sf_dir).select("token").distinct().withColumn("n", F.row_number().over(Window.orderBy("token")) - 1)
    named = numbered.join(F.broadcast(e.agg(F.count("*").alias("c")))).select("token", F.pmod("n", F.col("c")).alias("vec_id"))
    docs = read(spark, sf_dir, "documents")
    df = docs.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token")).join(F.broadcast(named.select("token")), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("docs"))
    return named.join(e.select("vec_id", F.col("embedding").alias("vector")), "vec_id").join(df, "token", "left").join(F.broadcast(total)).select("token", "vector", "df", "docs")


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``vector``, ``label``: documents with the vectors of ``embeddings``, given out in order."""
    e = read(spark, sf_dir, "embeddings")
    ids = read(spark, sf_dir, "documents").select("doc_id").join(F.broadcast(e.agg(F.count("*").alias("c"))))
    return ids.select("doc_id", F.pmod("doc_id", F.col("c")).alias("vec_id")).join(e.select("vec_id", F.col("embedding").alias("vector"), "label"), "vec_id").select("doc_id", "vector", "label")


_WORDS = f"""q AS (SELECT DISTINCT item_id, unnest({X.SQL_TOKENS.format("text")}) AS token FROM benchmark),
names AS (SELECT token, (row_number() OVER (ORDER BY token) - 1) % (SELECT count(*) FROM embeddings) AS vec_id FROM (SELECT DISTINCT token FROM q)),
df AS (SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({X.SQL_TOKENS.format("text")}) AS token FROM documents) GROUP BY token),
words AS (SELECT token, embedding AS v, coalesce(df / (SELECT count(*) FROM documents), 1.0) AS share FROM names JOIN embeddings USING (vec_id) LEFT JOIN df USING (token)),
wu AS (SELECT token, share, list_transform(v, lambda x: x::DOUBLE / (sqrt({_DOT.format("v", "v")}) + 1e-8)) AS u FROM words),
wl AS (SELECT token, share, unnest(range(0, len(u))) AS dim, unnest(u) AS x FROM wu)"""


def _mean(weight: str) -> str:
    return f"(SELECT item_id, dim, sum({weight} * x) / sum({weight}) AS m FROM q JOIN wl USING (token) GROUP BY ALL)"


@query(f"WITH {_WORDS}, m AS {_mean('1e-3 / (1e-3 + share)')} SELECT item_id, dim, round(m / (sqrt(sum(m * m) OVER (PARTITION BY item_id)) + 1e-8), 6) AS value FROM m")
def query_vectors(spark, sf_dir):
    """The weighted centroid of every query's words."""
    made = vectors.features(query_tokens(spark, sf_dir), word_table(spark, sf_dir), "item_id")
    return made.select("item_id", F.posexplode("vector").alias("dim", "value")).select("item_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


_DIRECTIONS = f"dirs AS (SELECT item_id, list(m ORDER BY dim) AS d FROM {_mean('5e-3 / (5e-3 + share)')} GROUP BY item_id)"
_DOCVEC = f"dv AS (SELECT doc_id, label, list_transform(embedding, lambda x: x::DOUBLE / (sqrt({_DOT.format('embedding', 'embedding')}) + 1e-8)) AS u FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings))"
_GATE = f"""{_WORDS}, {_DIRECTIONS}, {_DOCVEC}, {_CENTRE}, cv AS (SELECT label, list(value ORDER BY dim) AS v FROM cen GROUP BY label), cn AS (SELECT label, count(*) AS n FROM dv GROUP BY label),
cs AS (SELECT item_id, label, n, round({_DOT.format("v", "d")}, 6) AS score FROM cv JOIN cn USING (label) CROSS JOIN dirs),
held AS (SELECT *, coalesce(sum(n) OVER w, 0) AS before, count(*) OVER w AS place FROM cs WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gate AS (SELECT item_id, label FROM held WHERE before < greatest(1, floor(0.2 * (SELECT count(*) FROM dv))) OR place < 3)"""


def _gate(spark, sf_dir, directions: DataFrame) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    lists = retrieval.centroids(e).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("vector"))
    sizes = document_vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    return vectors.gated(directions, "item_id", lists.join(sizes, "label"), coverage=0.2, least=3)


@query(f"WITH {_GATE} SELECT item_id, label FROM gate")
def cluster_gate(spark, sf_dir):
    """The nearest clusters of every query, enough of them and of their documents."""
    return _gate(spark, sf_dir, vectors.query_directions(query_tokens(spark, sf_dir), word_table(spark, sf_dir), "item_id"))


@query(f"WITH {_GATE}, s AS (SELECT item_id, doc_id, round({_DOT.format('u', 'd')}, 6) AS score FROM dv JOIN gate USING (label) JOIN dirs USING (item_id)) SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS k FROM s) WHERE k <= 10")
def cosine_rank(spark, sf_dir):
    """The ten best documents of every query by weighted cosine, within the nearest clusters."""
    # A row for each query; else the documents' words are counted for the gate and for the ranking.
    directions = written(vectors.query_directions(query_tokens(spark, sf_dir), word_table(spark, sf_dir), "item_id"))
    scored = vectors.cosine_rank(document_vectors(spark, sf_dir), "doc_id", directions, "item_id", _gate(spark, sf_dir, directions), best=10)
    return retrieval.top(scored, "item_id", [F.desc("score"), F.desc("doc_id")], 10)


# The BM25 query has a table q of the same queries and tokens; the rest of the words' tables come behind it.
_FUSED = f"""{_BM25}, {_WORDS[_WORDS.index("names AS"):]}, {_DIRECTIONS}, {_DOCVEC},
both_ AS (SELECT item_id, doc_id, round(score, 6) AS score, coalesce(round({_DOT.format("u", "d")}, 6), 0) AS cosine FROM s JOIN dv USING (doc_id) LEFT JOIN dirs USING (item_id)),
f2 AS (SELECT item_id, doc_id, 1 / (60 + row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) - 1) + 1 / (60 + row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id DESC) - 1) AS f FROM both_),
fused AS (SELECT item_id, doc_id, round(f / max(f) OVER (PARTITION BY item_id), 9) AS score FROM f2)"""


@query(f"WITH {_FUSED} SELECT * FROM fused")
def rank_fusion(spark, sf_dir):
    """The orders by words and by cosine, fused, over all documents that hold a word of the query."""
    directions = vectors.query_directions(query_tokens(spark, sf_dir), word_table(spark, sf_dir), "item_id")
    return index.fused(read(spark, sf_dir, "documents"), document_vectors(spark, sf_dir), read(spark, sf_dir, "benchmark"), directions).withColumn("score", F.round("score", 9))


@query(f"WITH {_FUSED}, {SQL_PAGES}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS k FROM fused) WHERE k <= 50) SELECT item_id, doc_id, url, score FROM best JOIN docs USING (doc_id) WHERE docs.category = 'external' AND docs.lang = 'en'")
def ranked_pages(spark, sf_dir):
    """The fused ranking, cut, then a predicate with named parameters, and addresses."""
    directions = vectors.query_directions(query_tokens(spark, sf_dir), word_table(spark, sf_dir), "item_id")
    return index.rank(read(spark, sf_dir, "documents"), document_vectors(spark, sf_dir), read(spark, sf_dir, "benchmark"), directions, documents_as_pages(spark, sf_dir), n=50, where="category = :category AND lang = :lang", args={"category": "external", "lang": "en"})


@query(
    f"""WITH {_WORDS}, c AS (SELECT item_id, list(m ORDER BY dim) AS m FROM {_mean("1.0")} GROUP BY item_id), cu AS (SELECT item_id, list_transform(m, lambda x: x / (sqrt({_DOT.format("m", "m")}) + 1e-8)) AS d FROM c),
near AS (SELECT item_id, token, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, token DESC) AS k FROM (SELECT item_id, token, round({_DOT.format("u", "d")}, 6) AS score FROM wu CROSS JOIN cu)) WHERE k <= 15),
own AS (SELECT of_, token, score FROM (SELECT *, row_number() OVER (PARTITION BY of_ ORDER BY score DESC, token DESC) AS k FROM (SELECT a.token AS of_, b.token, round({_DOT.format("a.u", "b.u")}, 6) AS score FROM wu a JOIN wu b ON a.token <> b.token)) WHERE k <= 5),
every AS (SELECT * FROM near UNION ALL SELECT item_id, own.token, score FROM q JOIN own ON of_ = q.token)
SELECT item_id, token, max(score) AS score FROM every ANTI JOIN q USING (item_id, token) GROUP BY ALL"""
)
def related_words(spark, sf_dir):
    """The words nearest to every query and to each of its words."""
    return vectors.related(word_table(spark, sf_dir), query_tokens(spark, sf_dir), "item_id")


@query("SELECT vec_id, i AS place, round(list_sum(list_transform(range(greatest(i - 2, 0), least(i + 3, len(embedding))), lambda j: embedding[j + 1]::DOUBLE)) / 5, 6) AS value FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)")
def moving_average(spark, sf_dir):
    """The mean around each place of a list."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(index.moving_average(F.transform("embedding", lambda x: x.cast("double")), 5)).alias("place", "value"))
    return e.select("vec_id", F.col("place").cast("bigint").alias("place"), F.round("value", 6).alias("value"))


@query(f"WITH {SQL_PAGES} SELECT count(*) AS pages, sha256(min(url) || chr(10) || max(url)) AS ends FROM docs")
def index_ends(spark, sf_dir):
    """The fingerprint of an index by count and ends."""
    from folioflow.operators.dedup import numbered

    pages = numbered(documents_as_pages(spark, sf_dir).select("url"), F.col("url"), name="search_rowid")
    return index.fingerprint(pages).select("pages", "ends")


@query(f"WITH {SQL_PAGES} SELECT doc_id, url FROM docs WHERE instr(parsed, 'the') > 0 AND lang IN ('en', 'de') AND url LIKE '%src1%/doc/%'")
def full_text_filter(spark, sf_dir):
    """a text within the page, sets of languages and address patterns."""
    return documents_as_pages(spark, sf_dir).where("instr(parsed, 'the') > 0 AND lang IN ('en', 'de') AND url LIKE '%src1%/doc/%'").select("doc_id", "url")


@query(f"WITH {SQL_PAGES} SELECT doc_id, url FROM docs ORDER BY length DESC, doc_id LIMIT 20 OFFSET 20")
def second_page(spark, sf_dir):
    """The second page of a sorted result; the limit is the feature."""
    return index.page_of(documents_as_pages(spark, sf_dir).select("doc_id", "url", "length"), [F.desc("length"), F.col("doc_id")], 1).select("doc_id", "url")


# Vocabularies and n-grams


@query(f"WITH {_TOK}, v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM (SELECT token, count(*) AS n FROM tok GROUP BY token HAVING count(*) >= 5)), d AS (SELECT doc_id, unnest(w) AS token, unnest(range(0, len(w))) AS pos FROM (SELECT doc_id, {X.SQL_TOKENS.format('text')} AS w FROM documents)) SELECT r.doc_id, coalesce(list(id ORDER BY pos) FILTER (id IS NOT NULL), []) AS ids FROM documents r LEFT JOIN d USING (doc_id) LEFT JOIN v USING (token) GROUP BY r.doc_id")
def token_numbers(spark, sf_dir):
    """Documents as numbers of a vocabulary."""
    docs = read(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("tokens"))
    counts = docs.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n >= 5")
    # As many rows as the vocabulary has words.
    vocabulary = counts.select("token", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1).cast("bigint").alias("id"))
    return ngrams.token_ids(docs, vocabulary, "doc_id")


_SINGULAR = "CASE WHEN ends_with({0}, 'aux') AND length({0}) > 4 THEN {0}[:-4] || 'al' WHEN ends_with({0}, 's') AND length({0}) > 3 THEN {0}[:-2] ELSE {0} END"


@query(
    f"""WITH {_TOK}, v AS (SELECT token, count(*) AS n FROM tok GROUP BY token), c AS (SELECT token[:3] || '_' || token[4:] AS token FROM v WHERE length(token) > 5),
p AS (SELECT token, regexp_split_to_array(token, '_') AS w FROM c), s AS (SELECT token, list_transform(w, lambda x: {_SINGULAR.format("x")}) AS w FROM p),
t AS (SELECT token, 0 AS place, replace(token, '_', '') AS spelling FROM c UNION ALL SELECT token, 1, array_to_string(w, '_') FROM s UNION ALL SELECT token, 2, array_to_string(w, '') FROM s),
b AS (SELECT t.token, arg_max(spelling, (n, -place)) AS best FROM t JOIN v ON v.token = t.spelling WHERE spelling <> t.token GROUP BY t.token)
SELECT DISTINCT c.token, coalesce(best, c.token) AS resolved FROM c LEFT JOIN b USING (token)"""
)
def resolved_compounds(spark, sf_dir):
    """Words that were cut in two, under the most frequent of their spellings."""
    v = read(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    cut = v.where("length(token) > 5").select(F.concat(F.substring("token", 1, 3), F.lit("_"), F.expr("substring(token, 4)")).alias("token"))
    return ngrams.resolve_tokens(cut, v)


@query()
def trained_ngrams(spark, sf_dir):
    """Phrases of two passes above 0.7; compared with a plain count in the tests."""
    sentences = read(spark, sf_dir, "documents").select(F.explode(X.sentences(F.col("text"))).alias("s")).select(X.tokens(F.col("s")).alias("tokens"))
    return ngrams.train_ngrams(sentences).select("ngram", F.size("members").alias("size"))


@query(f"WITH {_TOK}, stems AS (SELECT token, {X.sql_stem('token')} AS stem, count(*) AS n FROM tok GROUP BY token), b AS (SELECT stem, arg_max(token, (n, token)) AS best FROM stems WHERE n >= 3 GROUP BY stem) SELECT stem, token, n FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC, token) AS k FROM stems WHERE n >= 3 AND stem <> (SELECT best FROM b WHERE b.stem = stems.stem)) WHERE k <= 3")
def stem_choices(spark, sf_dir):
    """The three most frequent tokens of each stem, less rare ones and stems that are their own most frequent token."""
    from folioflow.plans.queries import stem_tokens

    return retrieval.top(retrieval.sanitized_stems(stem_tokens(spark, sf_dir), 3), "stem", [F.desc("n"), F.col("token")], 3)


@query(f"WITH {_TOK}, stems AS (SELECT token, {X.sql_stem('token')} AS stem, count(*) AS n FROM tok GROUP BY token), b AS (SELECT stem, arg_max(token, (n, token)) AS best FROM stems GROUP BY stem), d AS (SELECT item_id, unnest(w) AS stem, unnest(range(0, len(w))) AS pos FROM (SELECT item_id, {X.SQL_TOKENS.format('text')} AS w FROM benchmark)) SELECT item_id, list(coalesce(best, stem) ORDER BY pos) AS tokens FROM d LEFT JOIN b USING (stem) GROUP BY item_id")
def restored_tokens(spark, sf_dir):
    """L4: lists of stems with the most frequent token of each in its place, unknown ones as they are, in order."""
    from folioflow.plans.queries import stem_tokens

    stems = read(spark, sf_dir, "benchmark").select("item_id", X.tokens(F.col("text")).alias("stems"))
    return retrieval.restored(stems, stem_tokens(spark, sf_dir), "item_id")
