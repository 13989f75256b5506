"""Crawls over tables of pages: sitemaps, links, frontiers, feeds, error classes.

Nothing here opens a connection: what has been fetched lies in tables, and a
crawl is joins over them. Fetching belongs to whatever fills the tables; its
rates and windows are planned here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.dates import iso_date
from folioflow.functions.markup import page_links
from folioflow.functions.urls import IGNORED, absolute, contains_any, domain_of, radical
from folioflow.operators.graph import written

#: Parts of links that lead to no content of a site: sharing, accounts, shops, feeds.
DISCARDED = IGNORED + ("/share/", "/sharer", "?share=", "/register", "/account/", "/checkout", "/wishlist", "/comment-page-", "?replytocom=", "/wp-admin/", "/wp-content/", "/feed", "?print=", "/logout", "/forgot-password", "/intent/tweet")


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """``url`` of the sitemap, ``loc``, ``lastmod`` and ``nested`` (whether it is a sitemap itself) of all entries.

    ``sitemaps`` has ``url`` and ``xml``. Entities are read, a missing date is null.
    """
    blocks = F.regexp_extract_all("xml", F.lit(r"(?is)<(?:\w+:)?(url|sitemap)\b[^>]*>(.*?)</(?:\w+:)?(?:url|sitemap)\s*>"), F.lit(0))
    inner = lambda name: F.trim(F.regexp_replace(F.regexp_extract("b", rf"(?is)<(?:\w+:)?{name}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</", 1), "&amp;", "&"))
    rows = sitemaps.select("url", F.explode(blocks).alias("b"))
    return rows.select("url", inner("loc").alias("loc"), iso_date(F.nullif(inner("lastmod"), F.lit(""))).alias("lastmod"), F.col("b").rlike(r"(?i)^<(?:\w+:)?sitemap\b").alias("nested")).where("loc <> ''")


def sitemap_pages(sitemaps: DataFrame, roots: Sequence[str], depth: int = 10) -> DataFrame:
    """``loc`` and ``lastmod`` of all pages that sitemaps reach from the roots, nested ones too; the latest date of each."""
    entries = written(sitemap_entries(sitemaps))
    reached = frontier = sitemaps.sparkSession.createDataFrame([(r,) for r in roots], "url string").distinct()
    for _ in range(depth):
        found = entries.where("nested").join(frontier, "url", "left_semi").select(F.col("loc").alias("url")).distinct()
        frontier = written(found.join(reached, "url", "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionAll(frontier)
    return entries.where("NOT nested").join(reached, "url", "left_semi").groupBy("loc").agg(F.max("lastmod").alias("lastmod"))


def due(entries: DataFrame, known: DataFrame, grace_months: int = 3, now: Column | None = None) -> DataFrame:
    """Entries to fetch: unknown ones, those changed since they were fetched, and undated ones fetched long ago.

    ``known`` has ``url`` and ``crawled``. Addresses agree up to final slashes.
    """
    trim = lambda c: F.regexp_replace(c, "/+$", "")
    seen = known.groupBy(trim(F.col("url")).alias("__key")).agg(F.max("crawled").alias("__crawled"))
    old = F.add_months(F.coalesce(now, F.current_timestamp()) if now is not None else F.current_timestamp(), -grace_months)
    stale = F.when(F.col("lastmod").isNotNull(), F.col("lastmod") > F.col("__crawled")).otherwise(F.col("__crawled") < old)
    return entries.join(seen, trim(F.col("loc")) == F.col("__key"), "left").where(F.col("__crawled").isNull() | stale).drop("__key", "__crawled")


def links_of(pages: DataFrame, key: str = "page_id", discard: Sequence[str] = DISCARDED, pdf: bool = False) -> DataFrame:
    """Key, ``url`` and ``link``: the distinct absolute addresses that pages link to, less anchors and discarded ones.

    ``pages`` has ``url`` and ``html``. With ``pdf`` the PDF files among them, else the others.
    """
    rows = pages.select(key, "url", F.explode(page_links(F.col("html"))).alias("raw"))
    found = rows.select(key, "url", radical(absolute(F.col("raw"), F.col("url"))).alias("link"))
    is_pdf = F.lower("link").rlike(r"\.pdf($|[?#])")
    return found.where(~contains_any(F.col("link"), discard) & (is_pdf if pdf else ~is_pdf)).distinct()


def followed(links: DataFrame, mode: str = "any") -> DataFrame:
    """Links (``url``, ``link``) that a crawl goes on to: ``any``, ``internal`` (the page's domain), ``external`` or ``ignore``."""
    same = F.contains(F.coalesce(domain_of(F.col("link")), F.lit("")), F.coalesce(domain_of(F.col("url")), F.lit("")))
    if mode not in ("any", "internal", "external", "ignore"):
        raise ValueError("mode is any, internal, external or ignore")
    return links.where({"any": F.lit(True), "internal": same, "external": ~same, "ignore": F.lit(False)}[mode])


def crawl(links: DataFrame, seeds: DataFrame, depth: int, within: Column | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """``url`` and ``depth`` of the pages that links (``url``, ``link``) reach from the seeds (``url``), at their least depth.

    Each round joins the frontier with the links and leaves out what has been
    visited; nothing but a count reaches the driver. ``within`` tells of
    ``link`` whether it belongs to the crawl. With ``hashes`` (``url``,
    ``content_hash``), pages whose content has been met under another address
    of less depth (the first address, of equals) lead no further.
    """
    edges = written(links.where(within) if within is not None else links)
    visited = frontier = written(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    met = None
    for d in range(1, depth + 1):
        if hashes is not None:
            here = frontier.join(hashes, "url", "left")
            fresh = here if met is None else here.join(met, "content_hash", "left_anti").unionByName(here.where("content_hash IS NULL").limit(0))
            first = fresh.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("url").alias("url"))
            met = written(first.select("content_hash") if met is None else met.unionAll(first.select("content_hash")))
            leading = first.select("url").unionAll(here.where("content_hash IS NULL").select("url"))
        else:
            leading = frontier.select("url")
        reached = edges.join(leading, "url", "left_semi").select(F.col("link").alias("url")).distinct()
        frontier = written(reached.join(visited, "url", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        visited = visited.unionAll(frontier)
    return visited


def crawl_report(visited: DataFrame) -> DataFrame:
    """One row: distinct pages ``processed``, ``missing`` (status 404) and ``failed`` (other errors) of ``url`` and ``status``."""
    page = lambda cond: F.count_distinct(F.when(cond, F.col("url")))
    return visited.agg(page(F.col("status") < 400).alias("processed"), page(F.col("status") == 404).alias("missing"), page((F.col("status") >= 400) & (F.col("status") != 404)).alias("failed"))


def error_class(message: Column) -> Column:
    """What kind of failure a connection's message tells of: ``dns``, ``refused``, ``connection`` or ``unknown``."""
    m = F.lower(message)
    return (
        F.when(m.rlike(r"could not resolve|name or service not known|getaddrinfo|nxdomain|no address associated|resolve host"), "dns")
        .when(m.rlike(r"refused"), "refused")
        .when(m.rlike(r"timed? ?out|reset|unreachable|aborted|broken pipe|connect"), "connection")
        .otherwise("unknown")
    )


def is_hard(message: Column) -> Column:
    """Whether trying again is useless: the host doesn't exist or turns connections down."""
    return error_class(message).isin("dns", "refused")


def media_type(content_type: Column, url: Column) -> Column:
    """A page's type from the header, else from its address: ``html``, ``pdf``, ``xml`` or ``other``."""
    c, u = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return F.when(F.contains(c, F.lit("pdf")) | u.endswith(".pdf"), "pdf").when(c.rlike("html|xhtml"), "html").when(F.contains(c, F.lit("xml")) | u.endswith(".xml"), "xml").when((c == "") & ~u.rlike(r"\.(jpe?g|png|gif|webp|zip|gz|mp4|mp3|exe)$"), "html").otherwise("other")


def variants(url: Column) -> Column:
    """Other addresses under which a page may be found: both schemes, with and without ``www.``, with and without a final slash."""
    rest = F.regexp_replace(url, r"(?i)^(?:https?:)?//(?:www\.)?|/+$", "")
    parts = [(s, w, e) for s in ("https://", "http://") for w in ("", "www.") for e in ("", "/")]
    return F.array_except(F.array(*[F.concat(F.lit(s + w), rest, F.lit(e)) for s, w, e in parts]), F.array(url))


def robots_rules(robots: DataFrame) -> DataFrame:
    """``domain``, ``agent``, ``disallow`` (paths) and ``delay`` in seconds, 30 at most, of robots files (``domain``, ``text``)."""
    lines = robots.select("domain", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).select("domain", "at", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line"))
    part = lines.select("domain", "at", F.lower(F.trim(F.regexp_extract("line", r"^([\w-]+)\s*:", 1))).alias("field"), F.trim(F.regexp_extract("line", r"^[\w-]+\s*:\s*(.*)$", 1)).alias("value")).where("field <> ''")
    by = F.collect_list(F.struct("at", "field", "value"))
    order = F.array_sort(by)
    start = F.struct(F.lit("*").alias("agent"), F.array().cast("array<struct<agent:string,field:string,value:string>>").alias("out"))
    fold = lambda xs: F.aggregate(xs, start, lambda s, x: F.struct(F.when(x["field"] == "user-agent", F.lower(x["value"])).otherwise(s["agent"]).alias("agent"), F.when(x["field"] == "user-agent", s["out"]).otherwise(F.array_append(s["out"], F.struct(s["agent"].alias("agent"), x["field"].alias("field"), x["value"].alias("value")))).alias("out")), lambda s: s["out"])
    told = part.groupBy("domain").agg(order.alias("xs")).select("domain", F.explode(fold(F.col("xs"))).alias("r")).select("domain", "r.*")
    number = F.expr("try_cast(value AS double)")
    return told.groupBy("domain", "agent").agg(F.sort_array(F.collect_set(F.when((F.col("field") == "disallow") & (F.col("value") != ""), F.col("value")))).alias("disallow"), F.max(F.when(F.col("field") == "crawl-delay", F.least(number, F.lit(30.0)))).alias("delay"))


def schedule(urls: DataFrame, rules: DataFrame, agent: str = "*", delay: float = 1.0) -> DataFrame:
    """``url`` and ``start``, seconds from now: requests to one domain stand a delay apart, disallowed paths are left out.

    A domain's requests are numbered in the order of their addresses; domains don't wait for each other.
    """
    from pyspark.sql import Window

    mine = rules.where(F.col("agent") == agent).select(F.col("domain").alias("__d"), "disallow", F.col("delay").alias("__delay"))
    rows = urls.select("url", domain_of(F.col("url")).alias("domain")).join(mine, F.col("domain") == F.col("__d"), "left")
    path = F.regexp_replace("url", r"(?i)^(?:https?:)?//[^/]+", "")
    allowed = ~F.coalesce(F.exists("disallow", lambda p: path.startswith(p)), F.lit(False))
    place = F.row_number().over(Window.partitionBy("domain").orderBy("url")) - 1
    return rows.where(allowed).select("url", (place * F.coalesce("__delay", F.lit(delay))).alias("start"))


def date_windows(spark, start: str, stop: str, days: int = 90) -> DataFrame:
    """``since`` and ``until``: windows that cover a span of days without gaps, the latest first; one row is one request's range."""
    one = spark.range(1).select(F.to_date(F.lit(start)).alias("a"), F.to_date(F.lit(stop)).alias("b"))
    ends = F.sequence(F.col("b"), F.col("a"), F.make_dt_interval(F.lit(-days)))
    return one.select("a", F.explode(ends).alias("until")).select(F.greatest(F.date_add("until", -days), F.col("a")).alias("since"), "until").where("since < until")


def posts(feed: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """Records of feeds of questions, issues and videos as pages: ``url``, ``title``, ``content``, ``date``, ``category``.

    ``feed`` has ``url``, ``title``, ``body``, ``created``, ``updated``, ``kind``
    and ``comments``, whose ``body`` are put behind the text in order of ``created``.
    """
    said = F.transform(F.array_sort(F.transform("comments", lambda c: F.struct(c["created"].alias("created"), c["body"].alias("body")))), lambda c: c["body"])
    return feed.select("url", "title", F.array_join(F.concat(F.array(F.coalesce("body", F.lit(""))), F.coalesce(said, F.array().cast("array<string>"))), separator).alias("content"), F.coalesce("updated", "created").alias("date"), F.col("kind").alias("category"))


def outline_sections(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections of documents by their outlines: ``url#page=n``, ``title`` and the ``content`` of the pages up to the next section.

    ``outline`` has ``url``, ``title``, ``page``; ``pages`` has ``url``, ``page``, ``text``. The last section goes to the end.
    """
    from pyspark.sql import Window

    after = Window.partitionBy("url").orderBy("page", "title")
    bounds = outline.withColumn("stop", F.lead("page").over(after))
    held = (F.col("p.page") >= F.col("o.page")) & (F.col("o.stop").isNull() | (F.col("p.page") < F.greatest(F.col("o.stop"), F.col("o.page") + 1)))
    joined = bounds.alias("o").join(pages.alias("p"), (F.col("o.url") == F.col("p.url")) & held)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p.page", "p.text"))), lambda x: x["text"]), "\n")
    return joined.groupBy("o.url", "o.title", F.col("o.page").alias("at")).agg(text.alias("content")).select(F.concat("url", F.lit("#page="), F.col("at").cast("string")).alias("url"), "title", "content")
