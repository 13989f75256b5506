"""Named queries over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions import urls as U
from folioflow.operators import dedup, mail, retrieval, tables, vectors
from folioflow.plans import registered
from folioflow.plans.registered import query
from folioflow.sources import web
from folioflow.sources.pages import SQL_EMAILS, SQL_PAGES, documents_as_pages, emails, read


def queries() -> dict:
    """All queries of the library, name -> (spark, sf_dir) -> DataFrame."""
    from folioflow.plans import corpus, mailing, search  # noqa: F401

    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    """Their DuckDB SQL."""
    queries()
    return dict(registered.SQL)


_P = U.sql_split("url")
_CANON = U.sql_canonical("url")
_ELECT = "coalesce(category = 'external', false), datetime DESC NULLS LAST, crawled DESC NULLS LAST, length DESC NULLS LAST"
_PREPARED = f"{SQL_PAGES}, prep AS (SELECT doc_id, {U.sql_canonical('url')} AS canonical_url, domain, content_hash, datetime, crawled, length, category FROM docs)"


# URLs and the page table


@query(f"SELECT page_id, {', '.join(f'{v} AS {k}' for k, v in _P.items() if k != 'ok')} FROM pages WHERE {_P['ok']}")
def url_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five parts of every page's URL."""
    return read(spark, sf_dir, "pages").select("page_id", U.split_url(F.col("url")).alias("u")).where("u IS NOT NULL").select("page_id", "u.*")


@query(f"SELECT page_id, {_CANON} AS canonical_url FROM pages")
def url_canonical(spark, sf_dir):
    """Canonical addresses."""
    return read(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical_url"))


@query(f"SELECT regexp_replace({U.sql_split('c')['domain']}, '^www\\.', '') AS domain, count(*) AS n FROM (SELECT c FROM (SELECT page_id, {_CANON} AS c, row_number() OVER (PARTITION BY {_CANON} ORDER BY page_id) AS k FROM pages) WHERE k = 1 AND c IS NOT NULL) GROUP BY 1")
def domain_counts(spark, sf_dir):
    """One row for each canonical address, counted by domain."""
    canonical = read(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("c")).where("c IS NOT NULL")
    first = canonical.groupBy("c").agg(F.min("page_id").alias("page_id"))
    return first.groupBy(U.domain_of(F.col("c")).alias("domain")).agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^[^#]+#.+$') THEN regexp_extract(url, '^([^#]+)#', 1) ELSE url END AS radical FROM pages")
def url_radical(spark, sf_dir):
    """T5: addresses before their anchors."""
    return read(spark, sf_dir, "pages").select("page_id", U.radical(F.col("url")).alias("radical"))


@query(f"SELECT page_id, url FROM pages WHERE NOT ({' OR '.join(f'''contains(url, '{x}')''' for x in U.IGNORED)})")
def url_discard(spark, sf_dir):
    """Pages whose address holds no ignored part."""
    return read(spark, sf_dir, "pages").where(~U.contains_any(F.col("url"), U.IGNORED)).select("page_id", "url")


_RAW_LINKS = r"""SELECT page_id, url, trim(regexp_replace(raw, '^["'']|["'']$', '', 'g')) AS raw FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1)) AS raw FROM pages)"""
_GONE = " OR ".join(f"contains(link, '{x}')" for x in web.DISCARDED)


@query(f"WITH r AS ({_RAW_LINKS}), l AS (SELECT page_id, url, {U.sql_absolute('raw', 'url')} AS link FROM r WHERE raw <> '' AND NOT regexp_matches(raw, '(?i)^(?:#|javascript:|mailto:|tel:|data:)')), c AS (SELECT DISTINCT page_id, url, CASE WHEN regexp_matches(link, '^[^#]+#.+$') THEN regexp_extract(link, '^([^#]+)#', 1) ELSE link END AS link FROM l) SELECT * FROM c WHERE NOT ({_GONE}) AND NOT regexp_matches(lower(link), '\\.pdf($|[?#])')")
def page_links(spark, sf_dir):
    """The distinct absolute links of every page, however quoted, less discarded ones and files."""
    return web.links_of(read(spark, sf_dir, "pages"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, lower(regexp_extract(html, '(?i)<html[^>]*\\slang=\"([a-zA-Z]{2})', 1)) AS lang, len(regexp_extract_all(html, '(?i)<h[12][\\s>]'))::BIGINT AS headings FROM pages")
def page_head(spark, sf_dir):
    """H2, H6, H7: title, language and number of headings."""
    return read(spark, sf_dir, "pages").select(
        "page_id",
        F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.lower(F.regexp_extract("html", r'(?i)<html[^>]*\slang="([a-zA-Z]{2})', 1)).alias("lang"),
        F.size(F.regexp_extract_all("html", F.lit(r"(?i)<h[12][\s>]"), F.lit(0))).cast("bigint").alias("headings"),
    )


@query(f"WITH {SQL_PAGES} SELECT doc_id, url, domain, category, length FROM docs WHERE category = 'external' AND lang IN ('en', 'fr') AND regexp_matches(parsed, '(?i)the|le')")
def page_filter(spark, sf_dir):
    """A user's predicate in SQL with a case-insensitive pattern."""
    return documents_as_pages(spark, sf_dir).where("category = 'external' AND lang IN ('en', 'fr') AND parsed RLIKE '(?i)the|le'").select("doc_id", "url", "domain", "category", "length")


@query(f"WITH {SQL_PAGES} SELECT doc_id, CASE WHEN contains(url, 'src1.') THEN 'first' WHEN regexp_matches(url, 'src[2-5]\\.') THEN 'some' ELSE category END AS category FROM docs")
def category_by_pattern(spark, sf_dir):
    """categories by address."""
    u = F.col("url")
    return documents_as_pages(spark, sf_dir).select("doc_id", F.when(F.contains(u, F.lit("src1.")), "first").when(u.rlike(r"src[2-5]\."), "some").otherwise(F.col("category")).alias("category"))


@query("SELECT doc_id, sha1(text) AS content_hash, sha256('c' || chr(0) || text) AS keyed_hash FROM documents")
def content_hashes(spark, sf_dir):
    """Hashes of texts."""
    return read(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("content_hash"), F.sha2(F.concat(F.lit("c"), F.char(F.lit(0)), F.col("text")), 256).alias("keyed_hash"))


# Statistics


@query(f"WITH {SQL_PAGES} SELECT 'domain' AS facet, domain AS item, count(*) AS n FROM docs GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM docs GROUP BY 2 UNION ALL SELECT 'lang', coalesce(nullif(lang, ''), '(unknown)'), count(*) FROM docs GROUP BY 2")
def facet_counts(spark, sf_dir):
    """Pages by domain, category, language in one pass."""
    return tables.facets(documents_as_pages(spark, sf_dir))


_STATS = {
    "pages": "count(*)", "domains": "count(DISTINCT domain)", "categories": "count(DISTINCT category)", "characters": "sum(length)", "longest": "max(length)",
    "mean_length": "round(avg(length), 6)", "oldest": "strftime(min(datetime), '%Y-%m-%d %H:%M:%S')", "newest": "strftime(max(datetime), '%Y-%m-%d %H:%M:%S')",
}


def _stat(name: str) -> str:
    kind = "value_real" if name == "mean_length" else "value_text" if name in ("oldest", "newest") else "value_integer"
    cells = ", ".join(f"({_STATS[name] if c == kind else 'NULL'})::{t} AS {c}" for c, t in (("value_integer", "BIGINT"), ("value_real", "DOUBLE"), ("value_text", "VARCHAR")))
    return f"SELECT '{name}' AS name, {cells} FROM docs"


@query(f"WITH {SQL_PAGES} {' UNION ALL '.join(map(_stat, _STATS))}")
def corpus_stats(spark, sf_dir):
    """Statistics as name and value, each under its type."""
    return tables.corpus_stats(documents_as_pages(spark, sf_dir))


@query(f"WITH {SQL_PAGES} SELECT category, count(*) AS pages FROM docs WHERE coalesce(category, '') <> '' GROUP BY category")
def category_catalogue(spark, sf_dir):
    """Categories with their pages."""
    return tables.catalogue(documents_as_pages(spark, sf_dir))


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS nulls, count(*) FILTER ({c}::VARCHAR = '') AS empties FROM orders" for c in _ORDERS))
def inspect_table(spark, sf_dir):
    """Nulls and empties of every column."""
    return tables.inspect(read(spark, sf_dir, "orders"))


# Elections


@query(f"WITH {_PREPARED} SELECT doc_id, canonical_url FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY {_ELECT}, doc_id) AS k FROM prep WHERE canonical_url IS NOT NULL) WHERE k = 1")
def elect_url(spark, sf_dir):
    """D2, W1."""
    return dedup.elect_by_url(dedup.prepare(documents_as_pages(spark, sf_dir), "doc_id"), "doc_id").select("doc_id", "canonical_url")


@query(f"WITH {_PREPARED} SELECT doc_id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY {_ELECT}, length(canonical_url), doc_id) AS k FROM prep WHERE canonical_url IS NOT NULL) WHERE k = 1 OR content_hash IS NULL")
def elect_content(spark, sf_dir):
    """D3, W2, U1."""
    return dedup.elect_by_content(dedup.prepare(documents_as_pages(spark, sf_dir), "doc_id"), "doc_id").select("doc_id", "content_hash")


@query(f"WITH {_PREPARED}, kept AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY {_ELECT}, length(canonical_url), doc_id) AS k FROM prep WHERE canonical_url IS NOT NULL) SELECT p.doc_id, canonical_url AS url, prep.domain, p.length FROM docs p JOIN (SELECT *, count(*) OVER (PARTITION BY domain) AS n FROM kept WHERE k = 1) prep USING (doc_id) WHERE n >= 5")
def dedup_rebuild(spark, sf_dir):
    """Exact phases, rare domains, rebuild."""
    return dedup.deduplicate(documents_as_pages(spark, sf_dir), "doc_id", threshold=1.0, least=5).select("doc_id", "url", "domain", "length")


@query()
def dedup_near(spark, sf_dir):
    """All phases with near copies."""
    return dedup.deduplicate(documents_as_pages(spark, sf_dir), "doc_id").select("doc_id", "url", "domain", "length")


@query(f"WITH {SQL_PAGES} SELECT doc_id, row_number() OVER (ORDER BY url) - 1 AS search_rowid FROM docs")
def search_rowids(spark, sf_dir):
    """Rows numbered in the order of addresses, without a single partition."""
    return dedup.numbered(documents_as_pages(spark, sf_dir).select("doc_id", "url"), F.col("url"), name="search_rowid").select("doc_id", F.col("search_rowid").cast("bigint").alias("search_rowid"))


# Keyed tables


def _sides(spark, sf_dir):
    """All orders, and a later state of all of them under keys of which half are new, each in two versions."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    moved = o.withColumn("o_orderkey", F.col("o_orderkey") * 2)
    return o, moved.withColumns({"o_orderstatus": F.lit("new"), "version": F.lit(1)}).unionByName(moved.withColumns({"o_custkey": F.col("o_custkey") + 1, "o_orderstatus": F.lit("newer"), "version": F.lit(2)}))


_SIDES = """old AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders), fresh AS (SELECT o_orderkey * 2 AS o_orderkey, o_custkey, 'new' AS o_orderstatus, 1 AS version FROM orders UNION ALL SELECT o_orderkey * 2, o_custkey + 1, 'newer', 2 FROM orders),
latest AS (SELECT * EXCLUDE (version) FROM fresh WHERE version = 2), earliest AS (SELECT * EXCLUDE (version) FROM fresh WHERE version = 1)"""


@query(f"WITH {_SIDES} SELECT * FROM latest UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM fresh)")
def table_upsert(spark, sf_dir):
    """Of a key's new rows the latest version counts."""
    return tables.upsert(*_sides(spark, sf_dir), "o_orderkey", [F.desc("version")])


@query(f"WITH {_SIDES} SELECT * FROM old UNION ALL SELECT * FROM earliest WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def table_merge(spark, sf_dir):
    """Of a key's new rows the first version is taken, where there is no old one."""
    return tables.insert_or_ignore(*_sides(spark, sf_dir), "o_orderkey", [F.col("version")])


@query(f"WITH {_SIDES} SELECT o.o_orderkey, coalesce(f.o_custkey, o.o_custkey) AS o_custkey, coalesce(f.o_orderstatus, o.o_orderstatus) AS o_orderstatus FROM old o LEFT JOIN latest f USING (o_orderkey)")
def table_update(spark, sf_dir):
    """U4, J7."""
    return tables.update_from(*_sides(spark, sf_dir), "o_orderkey", [F.desc("version")])


@query(f"WITH {_SIDES} SELECT o_orderkey FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM fresh)")
def table_missing(spark, sf_dir):
    """U4, J5."""
    return tables.missing(*_sides(spark, sf_dir), "o_orderkey")


@query(f"WITH {_SIDES}, f AS (SELECT * FROM fresh WHERE o_custkey > 100), l AS (SELECT o_orderkey, arg_max(o_custkey, version) AS o_custkey, arg_max(o_orderstatus, version) AS o_orderstatus FROM f GROUP BY o_orderkey) SELECT * FROM l UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l)")
def table_import(spark, sf_dir):
    """U5, J15."""
    old, new = _sides(spark, sf_dir)
    return tables.import_where(new, old, "o_custkey > 100", "o_orderkey", [F.desc("version")])


@query(f"WITH {_SIDES} SELECT o.o_orderkey, coalesce(l.o_custkey, o.o_custkey) AS o_custkey, o.o_orderstatus FROM old o LEFT JOIN latest l USING (o_orderkey) UNION ALL SELECT o_orderkey, o_custkey, NULL FROM latest WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def table_import_preserved(spark, sf_dir):
    """An import that keeps what its source has no column for."""
    old, new = _sides(spark, sf_dir)
    return tables.import_where(new.drop("o_orderstatus"), old, F.lit(True), "o_orderkey", [F.desc("version")], preserve=True)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def table_last(spark, sf_dir):
    """The last row of each key."""
    return tables.last_of_key(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, NULL::BIGINT AS o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def table_delete(spark, sf_dir):
    """Delete by predicate and empty a column."""
    return tables.delete_where(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("o_orderstatus") == "F", ["o_custkey"])


@query("WITH u AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://web.archive.org/web/2020/' || url ELSE url END AS url FROM pages), t AS (SELECT *, CASE WHEN page_id % 4 = 0 THEN regexp_extract(url, '/web/\\d+/(.+)$', 1) ELSE url END AS plain FROM u) SELECT page_id, plain AS url FROM t WHERE url = plain UNION ALL SELECT page_id, plain FROM (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY url) AS k FROM t WHERE url <> plain AND plain NOT IN (SELECT plain FROM t WHERE url = plain)) WHERE k = 1")
def archive_rewrite(spark, sf_dir):
    """U8, J12."""
    p = read(spark, sf_dir, "pages").select("page_id", F.when(F.pmod("page_id", F.lit(4)) == 0, F.concat(F.lit("https://web.archive.org/web/2020/"), "url")).otherwise(F.col("url")).alias("url"))
    return tables.unwrap_addresses(p, U.unwrap_archive(F.col("url")))


@query("SELECT user_id, event_id FROM (SELECT e.*, max(ts) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS seen FROM events e) WHERE seen IS NULL OR ts > seen")
def freshness(spark, sf_dir):
    """Events newer than what is known of their key."""
    e = read(spark, sf_dir, "events")
    known = e.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("known_user")).agg(F.max("ts").alias("seen"))
    return e.join(known, F.col("user_id") == F.col("known_user"), "left").where("seen IS NULL OR ts > seen").select("user_id", "event_id")


# Text


@query(f"SELECT doc_id, {X.SQL_WHITESPACE.format('text')} AS text FROM documents")
def text_whitespace(spark, sf_dir):
    """T9."""
    return read(spark, sf_dir, "documents").select("doc_id", X.clean_whitespace(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {X.sql_prefilter('text')} AS text FROM documents")
def text_prefilter(spark, sf_dir):
    """Cleanup and meta-tokens."""
    return read(spark, sf_dir, "documents").select("doc_id", X.prefiltered(F.col("text")).alias("text"))


@query()
def text_normalize(spark, sf_dir):
    """Lower case, ASCII, blanks."""
    return read(spark, sf_dir, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {X.sql_guess_language('text')} AS guess FROM documents")
def language_guess(spark, sf_dir):
    """Language by frequent words."""
    return read(spark, sf_dir, "documents").select("doc_id", X.guess_language(F.col("text")).alias("guess"))


@query(f"SELECT doc_id, len({X.SQL_SENTENCES.format('text')})::BIGINT AS sentences, len({X.SQL_TOKENS.format('text')})::BIGINT AS words, len(list_distinct({X.SQL_TOKENS.format('text')}))::BIGINT AS terms FROM documents")
def document_stats(spark, sf_dir):
    """A11, A14, T16, T26."""
    t = X.tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("bigint").alias("sentences"), F.size(t).cast("bigint").alias("words"), F.size(F.array_distinct(t)).cast("bigint").alias("terms"))


_TOK = f"tok AS (SELECT doc_id, unnest({X.SQL_TOKENS.format('text')}) AS token FROM documents)"


@query(f"WITH {_TOK} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df, round(count(*) / (SELECT count(*) FROM tok), 9) AS share, round((SELECT count(*) FROM documents) / count(DISTINCT doc_id), 6) AS idf FROM tok GROUP BY token HAVING count(*) >= 10")
def lexicon(spark, sf_dir):
    """Token and document frequencies, pruned, shares, and documents over document frequency."""
    docs = read(spark, sf_dir, "documents")
    tf = retrieval.postings(docs)
    counted = tf.groupBy("token").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))
    total = counted.agg(F.sum("n").alias("total"))
    both = counted.where("n >= 10").join(F.broadcast(total)).join(F.broadcast(docs.agg(F.count("*").alias("docs"))))
    return both.select("token", "n", "df", F.round(F.col("n") / F.col("total"), 9).alias("share"), F.round(F.col("docs") / F.col("df"), 6).alias("idf"))


_STEM = f"{_TOK}, stems AS (SELECT token, {X.sql_stem('token')} AS stem, count(*) AS n FROM tok GROUP BY token)"


@query(f"WITH {_STEM} SELECT stem, token, n FROM stems")
def stem_tokens(spark, sf_dir):
    """Stems with their tokens."""
    counted = read(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counted.select(X.stem(F.col("token")).alias("stem"), "token", "n")


@query(f"WITH {_STEM} SELECT stem, token, n FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC, token) AS k FROM stems) WHERE k = 1 AND stem <> token")
def stem_best(spark, sf_dir):
    """The best token of each stem, less stems that are their own."""
    return retrieval.top(stem_tokens(spark, sf_dir), "stem", [F.desc("n"), F.col("token")], 1).where("stem <> token")


@query(f"WITH d AS (SELECT doc_id, {X.SQL_TOKENS.format('text')} AS w FROM documents), b AS (SELECT unnest(list_zip(w[:-2], w[2:])) AS p FROM d WHERE len(w) > 1), c AS (SELECT p[1] AS a, p[2] AS b, count(*) AS n FROM b GROUP BY 1, 2 HAVING count(*) >= 10), u AS (SELECT token, count(*) AS n FROM (SELECT unnest(w) AS token FROM d) GROUP BY 1), t AS (SELECT sum(n) AS total FROM u) SELECT c.a, c.b, c.n, round(ln(c.n * total / (x.n * y.n)) / -ln(c.n / total), 6) AS npmi FROM c JOIN u x ON x.token = c.a JOIN u y ON y.token = c.b CROSS JOIN t WHERE ln(c.n * total / (x.n * y.n)) / -ln(c.n / total) > 0.3")
def ngram_npmi(spark, sf_dir):
    """Frequent bigrams by normalised pointwise mutual information, in one pass at 0.3; a part of T21."""
    w = read(spark, sf_dir, "documents").select(X.tokens(F.col("text")).alias("w"))
    pairs = F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    two = w.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n")).where("n >= 10")
    one = w.select(F.explode("w").alias("token")).groupBy("token").agg(F.count("*").alias("m"))
    total = one.agg(F.sum("m").alias("total"))
    npmi = F.log(F.col("n") * F.col("total") / (F.col("x") * F.col("y"))) / -F.log(F.col("n") / F.col("total"))
    joined = two.join(one.toDF("a", "x"), "a").join(one.toDF("b", "y"), "b").crossJoin(F.broadcast(total))
    return joined.select("a", "b", "n", F.round(npmi, 6).alias("npmi"), npmi.alias("__s")).where("__s > 0.3").drop("__s")


# Retrieval

_BM25 = f"""{_TOK}, p AS (SELECT token, doc_id, count(*) AS tf FROM tok GROUP BY ALL), l AS (SELECT doc_id, len({X.SQL_TOKENS.format('text')}) AS len FROM documents),
c AS (SELECT count(*) AS n, avg(len) AS av FROM l), f AS (SELECT token, count(*) AS df FROM p GROUP BY token),
q AS (SELECT item_id, unnest(list_distinct({X.SQL_TOKENS.format('text')})) AS token FROM benchmark),
s AS (SELECT item_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5)) * ((tf * {retrieval.K1} + 1) / (tf + {retrieval.K1} * (1 - {retrieval.B} + {retrieval.B} * len / av)) + {retrieval.DELTA})) AS score FROM q JOIN p USING (token) JOIN f USING (token) JOIN l USING (doc_id) CROSS JOIN c GROUP BY ALL)"""


@query(f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score FROM s")
def bm25_scores(spark, sf_dir):
    """Every query's scores of all documents with one of its terms."""
    return retrieval.bm25(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).withColumn("score", F.round("score", 6))


@query(f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id DESC) AS k FROM s) WHERE k <= 10")
def bm25_top(spark, sf_dir):
    """Ten best documents of every query by words."""
    scored = retrieval.bm25(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), best=10).withColumn("score", F.round("score", 6))
    return retrieval.top(scored, "item_id", [F.desc("score"), F.desc("doc_id")], 10)


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_UNIT = f"uv AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / (sqrt({_DOT.format('embedding', 'embedding')}) + 1e-8)) AS u FROM embeddings)"
_CENTRE = f"{_UNIT}, lo AS (SELECT label, unnest(range(0, len(u))) AS dim, unnest(u) AS x FROM uv), mean AS (SELECT label, dim, avg(x) AS m, count(*) AS n FROM lo GROUP BY ALL), cen AS (SELECT label, dim, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS value, n FROM mean)"


@query(f"WITH {_CENTRE} SELECT label, dim, round(value, 6) AS value, n FROM cen")
def cluster_centroids(spark, sf_dir):
    """A18, M3."""
    return retrieval.centroids(read(spark, sf_dir, "embeddings")).withColumn("value", F.round("value", 6))


@query(f"WITH {_CENTRE}, c AS (SELECT label, list(value ORDER BY dim) AS v FROM cen GROUP BY label), d AS (SELECT vec_id, c.label, {_DOT.format('u', 'v')} AS score FROM uv CROSS JOIN c) SELECT vec_id, label AS nearest, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 6) DESC, label) AS k FROM d) WHERE k = 1")
def nearest_cluster(spark, sf_dir):
    """M2: the nearest centroid of every vector."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", retrieval.unit(F.col("embedding")).alias("u"))
    c = retrieval.centroids(read(spark, sf_dir, "embeddings")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v")).select("label", F.transform("v", lambda x: x["value"]).alias("v"))
    return vectors.products(e, "vec_id", "u", c.withColumnRenamed("label", "nearest"), "nearest", "v", 1)


@query(f"WITH t AS (SELECT doc_id % 10 AS label, unnest({X.SQL_TOKENS.format('text')}) AS token FROM documents), f AS (SELECT label, token, count(*) AS tf FROM t GROUP BY ALL), s AS (SELECT label, token, tf / sum(tf) OVER (PARTITION BY label) * ln(1 + 10 / (count(*) OVER (PARTITION BY token) + 1)) AS score FROM f) SELECT label, token, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, token) AS k FROM s) WHERE k <= 15")
def cluster_keywords(spark, sf_dir):
    """The words that tell clusters apart."""
    t = read(spark, sf_dir, "documents").select(F.pmod("doc_id", F.lit(10)).alias("label"), F.explode(X.tokens(F.col("text"))).alias("token"))
    scored = retrieval.ctfidf(t, 10).withColumn("score", F.round("score", 9))
    return retrieval.top(scored, "label", [F.desc("score"), F.col("token")], 15)


# Messages


@query(f"WITH {SQL_EMAILS} SELECT m.message_id, m.in_reply_to, m.sender, p.sender AS parent_sender FROM mails m JOIN mails p ON m.in_reply_to = p.message_id")
def mail_threads(spark, sf_dir):
    """Replies with what they answer."""
    return mail.parents(emails(spark, sf_dir)).select("message_id", "in_reply_to", "sender", "parent_sender")


def _rules() -> list[mail.Rule]:
    return [
        mail.Rule("system", 0, F.col("sender").startswith("system"), "archive", -1),
        mail.Rule("questions", 10, F.contains(F.col("body"), F.lit("?")), "flag", 1),
        mail.Rule("long", 20, F.length("body") > 200, "move:long", 2),
    ]


@query(f"WITH {SQL_EMAILS}, h AS (SELECT message_id, 'system' AS rule, 0 AS priority, 'archive' AS action, -1 AS runs FROM mails WHERE starts_with(sender, 'system') UNION ALL SELECT message_id, 'questions', 10, 'flag', 1 FROM mails WHERE contains(body, '?') UNION ALL SELECT message_id, 'long', 20, 'move:long', 2 FROM mails WHERE length(body) > 200), st AS (SELECT message_id, r AS rule, turn % 3 AS processed FROM mails CROSS JOIN (VALUES ('questions'), ('long')) v(r)) SELECT message_id, rule, priority, action FROM h LEFT JOIN st USING (message_id, rule) WHERE runs < 0 OR coalesce(processed, 0) < runs")
def mail_rules(spark, sf_dir):
    """Rules with counted runs."""
    m = emails(spark, sf_dir)
    state = m.select("message_id", F.explode(F.array(F.lit("questions"), F.lit("long"))).alias("rule"), F.pmod("turn", F.lit(3)).alias("processed"))
    return mail.run_rules(m, _rules(), state)


@query(f"WITH {SQL_EMAILS} SELECT sender, count(*) AS n, count(*) FILTER (contains(body, '?')) AS questions, max(length(body))::BIGINT AS longest FROM mails GROUP BY sender")
def mailbox_counts(spark, sf_dir):
    """A20, E17."""
    return emails(spark, sf_dir).groupBy("sender").agg(F.count("*").alias("n"), F.count_if(F.contains(F.col("body"), F.lit("?"))).alias("questions"), F.max(F.length("body")).cast("bigint").alias("longest"))


@query(f"SELECT doc_id, regexp_extract_all(text, '{mail.ADDRESS}') AS addresses FROM documents WHERE regexp_matches(text, '{mail.ADDRESS}')")
def text_addresses(spark, sf_dir):
    """Mail addresses in texts."""
    return read(spark, sf_dir, "documents").where(F.col("text").rlike(mail.ADDRESS)).select("doc_id", mail.addresses(F.col("text")).alias("addresses"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """ST3: tumbling windows (an extension for streams)."""
    return read(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


@query("SELECT user_id, max(ts) AS latest, least(max(ts) FILTER (event_type = 'view'), max(ts) FILTER (event_type = 'click')) AS threshold FROM events GROUP BY user_id")
def crawl_threshold(spark, sf_dir):
    """The last times of each key and the earlier of two."""
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("latest"), F.least(last("view"), last("click")).alias("threshold"))
