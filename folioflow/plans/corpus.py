"""Queries over pages, dates, tokens and crawls, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import dates, markup
from folioflow.functions import text as X
from folioflow.functions import tokens as K
from folioflow.operators import jobs
from folioflow.plans.registered import query
from folioflow.sources import archives, web
from folioflow.sources.pages import SQL_PAGES, documents_as_pages, read

# Dates


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('minute', ts) WHEN 4 THEN date_trunc('second', ts) WHEN 6 THEN NULL ELSE date_trunc('day', ts) END::TIMESTAMP AS guess FROM events")
def guessed_dates(spark, sf_dir):
    """Times of events, written in seven forms and read again."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    later = lambda h: F.col("t") + F.make_dt_interval(F.lit(0), F.lit(h))
    forms = [
        F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.concat(F.date_format(later(2), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200")),
        F.date_format("t", "d MMM yyyy"),
        F.date_format("t", "MMMM d, yyyy h:mm a"),
        F.concat(F.lit("D:"), F.date_format(later(1), "yyyyMMddHHmmss"), F.lit("+01'00'")),
        F.concat(F.lit("on "), F.date_format("t", "MM/dd/yyyy")),
        F.lit("no date at all"),
    ]
    said = F.element_at(F.array(*forms), (F.pmod("event_id", F.lit(len(forms))) + 1).cast("int"))
    return e.select("event_id", dates.guess_date(said).cast("timestamp_ntz").alias("guess"))


@query("SELECT o_orderkey, (o_orderdate - INTERVAL 2 MONTH - INTERVAL 17 DAY)::TIMESTAMP AS earlier, round(epoch(TIMESTAMP '2000-01-01' - o_orderdate) / 86400, 6) AS age, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp FROM orders")
def date_arithmetic(spark, sf_dir):
    """Spans before, ages, stamps."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    return o.select("o_orderkey", dates.ago(F.col("d"), months=2, weeks=2, days=3).cast("timestamp_ntz").alias("earlier"), F.round(dates.age_days(F.col("d"), F.lit("2000-01-01").cast("timestamp")), 6).alias("age"), dates.stamp(F.col("d")).alias("stamp"))


# Pages


def stated_pages(spark, sf_dir) -> DataFrame:
    """``pages`` with a head in front that states a date in one of ten ways, an excerpt in one of three, a language and translations."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(300)).cast("int")), "yyyy-MM-dd")
    ways = ["<meta name=\"date\" content=\"{}\">", "<meta content='{}' name='publishDate'>", "<meta property=\"article:modified_time\" content=\"{}\">", "<meta property=\"article:published_time\" content={}>", "<meta name=\"dc.date\" content=\"{}\">", "<time class=\"x\" datetime=\"{}\">a day</time>", "<relative-time datetime='{}'></relative-time>", "<div class=\"dateline\">on <b>{}</b></div>", "<script type=\"application/ld+json\">{{\"datePublished\": \"2001-01-01\", \"dateModified\": \"{}\"}}</script>", "<span class=\"updated rich-snippet-hidden\">{}</span>"]
    filled = F.array(*[F.concat(*[x for part in zip([F.lit(p) for p in w.replace("{{", "\0").replace("}}", "\1").split("{}")[:1]], [day], [F.lit(w.replace("{{", "\0").replace("}}", "\1").split("{}")[1])], strict=True) for x in part]) for w in ways])
    date = F.translate(F.element_at(filled, (F.pmod("page_id", F.lit(10)) + 1).cast("int")), "\0\1", "{}")
    id_ = F.col("page_id").cast("string")
    excerpt = F.element_at(F.array(F.concat(F.lit('<meta property="og:description" content="first  '), id_, F.lit('"><meta name="description" content="second">')), F.concat(F.lit("<meta name='description' content='second "), id_, F.lit("'>")), F.lit("")), (F.pmod("page_id", F.lit(3)) + 1).cast("int"))
    langs = F.concat(F.lit('<link rel="alternate" hreflang="fr" href="/fr/'), id_, F.lit("\"><link hreflang=de rel=alternate href='/de'>"))
    locale = F.when(F.pmod("page_id", F.lit(2)) == 0, F.lit('<meta property="og:locale" content="es_ES">')).otherwise("")
    bare = F.regexp_replace("html", r'(?i)<html lang="[^"]*">', "<html>")
    return read(spark, sf_dir, "pages").select("page_id", "url", F.concat(locale, excerpt, langs, date, F.when(F.pmod("page_id", F.lit(2)) == 0, bare).otherwise(F.col("html"))).alias("html"))


@query("SELECT page_id, CASE WHEN page_id % 10 = 7 THEN 'on ' ELSE '' END || strftime(DATE '2024-01-01' + (page_id % 300)::INT, '%Y-%m-%d') AS date, DATE '2024-01-01' + (page_id % 300)::INT AS day FROM pages")
def page_dates(spark, sf_dir):
    """The dates that pages state in ten ways."""
    said = stated_pages(spark, sf_dir).select("page_id", markup.page_date(F.col("html")).alias("date"))
    return said.select("page_id", "date", dates.guess_date(F.col("date")).cast("date").alias("day"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'first ' || page_id WHEN 1 THEN 'second ' || page_id END AS excerpt, CASE WHEN page_id % 2 = 0 THEN 'es_ES' ELSE nullif(regexp_extract(html, '(?i)<html[^>]*\\slang=\"([^\"]*)\"', 1), '') END AS lang, '/fr/' || page_id AS french, '/de' AS german FROM pages")
def page_meta(spark, sf_dir):
    """H4, H6, H9: excerpts, languages and translations that pages state."""
    h = F.col("html")
    other = markup.translations(h)
    return stated_pages(spark, sf_dir).select("page_id", markup.page_excerpt(h).alias("excerpt"), markup.page_lang(h).alias("lang"), other["fr"].alias("french"), other["de"].alias("german"))


@query("SELECT page_id, list_distinct(list_filter(list_transform(regexp_extract_all(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), lambda x: regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '^[\\s#↑🔗]+|[\\s#↑🔗]+$', '', 'g')), lambda x: x <> '')) AS h1 FROM pages")
def page_headings(spark, sf_dir):
    """H2: the first headings of every page."""
    return read(spark, sf_dir, "pages").select("page_id", markup.headings(F.col("html"), 1).alias("h1"))


@query(f"SELECT page_id, {markup.SQL_UNMINIFY.format('html')} AS html FROM pages")
def unminified(spark, sf_dir):
    """H1: line ends after blocks, blanks after inline elements."""
    return read(spark, sf_dir, "pages").select("page_id", markup.unminify(F.col("html")).alias("html"))


@query()
def page_records(spark, sf_dir):
    """H2–H8, B1: pages as records with clean texts; compared with a parser of its own in the tests."""
    return jobs.parse(jobs.records(stated_pages(spark, sf_dir))).select("url", "title", "lang", "excerpt", "date", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "length", "content_hash")


@query("SELECT page_id, 'https://w.example/' || page_id AS link FROM pages")
def page_files(spark, sf_dir):
    """the PDF files that pages link to."""
    p = read(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit('<a href="https://w.example/'), F.col("page_id").cast("string"), F.lit('.pdf?x=1">a</a><a href=/y.html>b</a>'), "html").alias("html"))
    return web.links_of(p, pdf=True).select("page_id", F.regexp_replace("link", r"\.pdf\?x=1$", "").alias("link"))


# Crawls


def _linked(spark, sf_dir) -> DataFrame:
    """Links of a made-up site: each document leads to three others by their numbers."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    to = F.array(F.col("doc_id") * 2 + 1, F.col("doc_id") * 3 + 2, F.floor(F.col("doc_id") / 2))
    site = lambda c: F.concat(F.lit("https://site"), F.pmod(c, F.lit(3)).cast("string"), F.lit(".example.org/"), c.cast("string"))
    rows = d.select("doc_id", F.explode(to).alias("to")).join(d.select(F.col("doc_id").alias("to")), "to", "left_semi")
    return rows.select(site(F.col("doc_id")).alias("url"), site(F.col("to")).alias("link"))


_LINKED = """t AS (SELECT doc_id AS a, unnest([doc_id * 2 + 1, doc_id * 3 + 2, doc_id // 2]) AS b FROM documents), e AS (SELECT a, b FROM t WHERE b IN (SELECT doc_id FROM documents)),
l AS (SELECT 'https://site' || (a % 3) || '.example.org/' || a AS url, 'https://site' || (b % 3) || '.example.org/' || b AS link FROM e)"""


@query(f"WITH RECURSIVE {_LINKED}, r(url, depth) AS (SELECT 'https://site1.example.org/1', 0 UNION SELECT link, depth + 1 FROM r JOIN l USING (url) WHERE depth < 5) SELECT url, min(depth)::INT AS depth FROM r GROUP BY url")
def crawled(spark, sf_dir):
    """What a crawl of five steps reaches, at which depth."""
    seeds = spark.createDataFrame([("https://site1.example.org/1",)], "url string")
    return web.crawl(_linked(spark, sf_dir), seeds, 5)


@query(f"WITH {_LINKED} SELECT url, link FROM l WHERE regexp_extract(url, '//([^/]+)', 1) = regexp_extract(link, '//([^/]+)', 1)")
def internal_links(spark, sf_dir):
    """Links within a domain."""
    return web.followed(_linked(spark, sf_dir), "internal")


def _sitemaps(spark, sf_dir) -> DataFrame:
    """A sitemap for each source, and one that lists them all."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id")
    entry = F.concat(F.lit("<url><loc>https://e.org/"), F.col("doc_id").cast("string"), F.lit("?a=1&amp;b=2</loc>"), F.when(F.pmod("doc_id", F.lit(4)) > 0, F.concat(F.lit("<lastmod>"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(60)).cast("int")), "yyyy-MM-dd"), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>"))
    leaves = d.groupBy("source").agg(F.array_join(F.collect_list(entry), "\n").alias("body")).select(F.concat(F.lit("https://e.org/"), "source", F.lit(".xml")).alias("url"), F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://x">'), "body", F.lit("</urlset>")).alias("xml"))
    root = leaves.agg(F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))), "").alias("body")).select(F.lit("https://e.org/sitemap.xml").alias("url"), F.concat(F.lit("<sitemapindex>"), "body", F.lit("</sitemapindex>")).alias("xml"))
    return leaves.unionByName(root)


_ENTRY = "'https://e.org/' || doc_id || '?a=1&b=2'"


@query(f"SELECT {_ENTRY} AS loc, CASE WHEN doc_id % 4 > 0 THEN TIMESTAMP '2024-01-01' + to_days((doc_id % 60)::INT) END AS lastmod FROM documents")
def sitemap_pages(spark, sf_dir):
    """All pages of nested sitemaps with their dates."""
    found = web.sitemap_pages(_sitemaps(spark, sf_dir), ["https://e.org/sitemap.xml"])
    return found.select("loc", F.col("lastmod").cast("timestamp_ntz").alias("lastmod"))


@query(f"WITH k AS (SELECT doc_id, TIMESTAMP '2024-02-01' AS crawled FROM documents WHERE doc_id % 2 = 0), e AS (SELECT doc_id, {_ENTRY} AS loc, CASE WHEN doc_id % 4 > 0 THEN TIMESTAMP '2024-01-01' + to_days((doc_id % 60)::INT) END AS lastmod FROM documents) SELECT loc FROM e LEFT JOIN k USING (doc_id) WHERE crawled IS NULL OR lastmod > crawled OR (lastmod IS NULL AND crawled < TIMESTAMP '2024-04-01')")
def due_pages(spark, sf_dir):
    """J6, F19, ST4: entries that are new, changed, or long unread."""
    d = read(spark, sf_dir, "documents")
    known = d.where("doc_id % 2 = 0").select(F.concat(F.lit("https://e.org/"), F.col("doc_id").cast("string"), F.lit("?a=1&b=2/")).alias("url"), F.lit("2024-02-01").cast("timestamp").alias("crawled"))
    entries = web.sitemap_entries(_sitemaps(spark, sf_dir)).where("NOT nested")
    return web.due(entries, known, now=F.lit("2024-07-01").cast("timestamp")).select("loc")


@query("SELECT (DATE '2024-12-31' - (i * 90)::INT - 90)::DATE AS since, (DATE '2024-12-31' - (i * 90)::INT)::DATE AS until FROM range(0, 4) t(i) UNION ALL SELECT DATE '2024-01-01', DATE '2024-01-06'")
def date_windows(spark, sf_dir):
    """S22, W8, ST3: windows of 90 days back over a year."""
    return web.date_windows(spark, "2024-01-01", "2024-12-31")


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'dns' WHEN 'view' THEN 'refused' WHEN 'purchase' THEN 'connection' ELSE 'unknown' END AS kind, event_type IN ('click', 'view') AS hard, count(*) AS n FROM events GROUP BY 1, 2, 3")
def error_classes(spark, sf_dir):
    """Failures by their messages."""
    said = F.create_map(*[F.lit(x) for x in ("click", "Could not resolve host: a.b", "view", "[Errno 111] Connection refused", "purchase", "Operation timed out")])
    e = read(spark, sf_dir, "events").withColumn("m", F.coalesce(F.try_element_at(said, F.col("event_type")), F.lit("it failed")))
    return e.groupBy("event_type", web.error_class(F.col("m")).alias("kind"), web.is_hard(F.col("m")).alias("hard")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT user_id) FILTER (event_id % 10 < 7) AS processed, count(DISTINCT user_id) FILTER (event_id % 10 IN (7, 8)) AS missing, count(DISTINCT user_id) FILTER (event_id % 10 = 9) AS failed FROM events")
def crawl_report(spark, sf_dir):
    """What a crawl has met, by status."""
    status = F.element_at(F.array(*map(F.lit, [200] * 7 + [404, 404, 500])), (F.pmod("event_id", F.lit(10)) + 1).cast("int"))
    return web.crawl_report(read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), status.alias("status")))


@query("SELECT 'https://q.example/' || conv_id AS url, arg_min(text, turn) || coalesce((SELECT string_agg(chr(10) || chr(10) || '---' || chr(10) || chr(10) || text, '' ORDER BY turn) FROM conversations c WHERE c.conv_id = conversations.conv_id AND turn > 0), '') AS content FROM conversations GROUP BY conv_id")
def feed_posts(spark, sf_dir):
    """Questions with their answers as pages."""
    c = read(spark, sf_dir, "conversations")
    said = F.collect_list(F.when(F.col("turn") > 0, F.struct(F.timestamp_seconds("turn").alias("created"), F.col("text").alias("body"))))
    feed = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("body"), said.alias("comments"))
    shaped = feed.select(F.concat(F.lit("https://q.example/"), F.col("conv_id").cast("string")).alias("url"), F.lit("t").alias("title"), "body", F.lit(None).cast("timestamp").alias("created"), F.lit(None).cast("timestamp").alias("updated"), F.lit("q").alias("kind"), "comments")
    return web.posts(shaped).select("url", "content")


@query("WITH p AS (SELECT conv_id, turn, text, (SELECT max(o.turn) FROM conversations o WHERE o.conv_id = c.conv_id AND o.turn <= c.turn AND o.turn % 2 = 0) AS pos FROM conversations c) SELECT 'd' || conv_id || '#page=' || pos AS url, string_agg(text, chr(10) ORDER BY turn) AS content FROM p GROUP BY conv_id, pos")
def outline_sections(spark, sf_dir):
    """Sections of documents between the pages of their outlines."""
    c = read(spark, sf_dir, "conversations").select(F.concat(F.lit("d"), F.col("conv_id").cast("string")).alias("url"), F.col("turn").alias("page"), "text")
    outline = c.where("page % 2 = 0").select("url", F.lit("s").alias("title"), "page")
    return web.outline_sections(outline, c).select("url", "content")


@query("SELECT page_id, 8 - (regexp_matches(url, '^https?://[^?#]*$'))::INT AS others FROM pages")
def address_variants(spark, sf_dir):
    """Other addresses under which a page may be found; a plain address is one of the eight itself."""
    return read(spark, sf_dir, "pages").select("page_id", F.size(web.variants(F.regexp_replace("url", r"/+$", ""))).alias("n"), F.col("url").rlike(r"^https?://[^?#]*$").alias("plain")).select("page_id", F.when(F.col("plain"), F.col("n")).otherwise(F.lit(8)).alias("others"))


# Tokens and tables

_EDGE = "[?!#=+,:;''\"^*./`()\\[\\]{}&\\s<>-]+"


def _sql_normal(token: str) -> str:
    """:func:`tokens.normalize_token` for tokens of any language, none of which stands for a kind of text."""
    every = ", ".join(repr(w) for w in sorted({w for words in X.STOPWORDS.values() for w in words}))
    w = f"regexp_replace({token}, '^{_EDGE}|{_EDGE}$', '', 'g')"
    gram = f"regexp_matches({w}, '^.+_.+$')"
    bare = f"nullif(CASE WHEN {gram} THEN {w} ELSE regexp_replace({w}, '^_+|_+$', '', 'g') END, '')"
    stem = X.sql_stem(f"replace({bare}, '_', '')")
    return f"CASE WHEN NOT {gram} AND regexp_matches({bare}, '^[+-]?[0-9]+(?:[.,][0-9]+)*$') THEN '_NUMBER_' WHEN NOT {gram} AND regexp_matches({bare}, '^[0-9a-f]{{6,}}$') AND regexp_matches({bare}, '[0-9]') AND regexp_matches({bare}, '[a-f]') THEN '_HASH_' WHEN {bare} IN ({every}) THEN NULL ELSE nullif({stem}, '') END"


@query(f"WITH t AS (SELECT DISTINCT lower(unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS token FROM documents WHERE text IS NOT NULL), k AS (SELECT token FROM t WHERE NOT regexp_matches(token, '_[a-z]+_')) SELECT token, {_sql_normal('token')} AS normal FROM k")
def normal_tokens(spark, sf_dir):
    """Every distinct piece of text in its normal form."""
    t = read(spark, sf_dir, "documents").select(F.explode(K.pieces(F.col("text"))).alias("token")).select(F.lower("token").alias("token")).distinct()
    return t.where(~F.col("token").rlike("_[a-z]+_")).select("token", K.normalize_token(F.col("token")).alias("normal"))


@query("SELECT doc_id, lang AS code FROM documents")
def language_codes(spark, sf_dir):
    """Two letters for tags and names of languages."""
    d = read(spark, sf_dir, "documents")
    names = F.create_map(*[F.lit(x) for x in ("en", "English", "fr", "FRA", "de", "ger", "es", "Spanish")])
    said = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat("lang", F.lit("_XX"))).otherwise(F.coalesce(names[F.col("lang")], "lang"))
    return d.select("doc_id", X.language_code(said).alias("code"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'pt' ELSE CASE WHEN length(text) >= 5 THEN {X.sql_guess_language('text')} END END AS lang FROM documents")
def detected_languages(spark, sf_dir):
    """The declared language, else one guessed from five characters or more."""
    d = read(spark, sf_dir, "documents")
    declared = F.when(F.pmod("doc_id", F.lit(2)) == 0, "pt-BR").otherwise(F.lit("not a language name"))
    return d.select("doc_id", jobs.detected_language(F.col("text"), declared).alias("lang"))


@query(f"SELECT sum(len({X.SQL_TOKENS.format('text')}))::BIGINT AS items FROM documents")
def nested_items(spark, sf_dir):
    """How many tokens there are below sentences, without listing them."""
    d = read(spark, sf_dir, "documents").select(X.tokenize(F.col("text")).alias("tokenized"))
    return archives.count_items(d, "tokenized", 1)


@query(f"WITH {SQL_PAGES} SELECT doc_id, len({X.SQL_SENTENCES.format('parsed')}) > 0 AS tokenized FROM docs")
def resumed_tokens(spark, sf_dir):
    """B2, ST6: only pages without tokens are tokenised."""
    p = documents_as_pages(spark, sf_dir).withColumn("tokenized", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.array(F.array(F.lit("kept")))))
    out = jobs.tokenize(p.withColumn("had", F.col("tokenized")))
    same = F.when(F.col("had").isNotNull(), F.col("tokenized") == F.col("had")).otherwise(F.size("tokenized") > 0)
    return out.select("doc_id", same.alias("tokenized"))
