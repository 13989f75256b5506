"""Column jobs over page tables: parse, tokenise, stem, vectorise; those that can be resumed do only what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.dates import guess_date
from folioflow.functions.markup import Selector, headings, page_date, page_excerpt, page_lang, page_text, page_title
from folioflow.functions.text import clean_whitespace, guess_language, language_code, normalize_text
from folioflow.functions.tokens import post_filter, tokenize_sentences
from folioflow.functions.urls import domain_of
from folioflow.operators.ngrams import replace_ngrams
from folioflow.operators.vectors import features


def parse(pages: DataFrame) -> DataFrame:
    """Pages with clean title and content, ``parsed``, ``length`` (of ``parsed``), ``datetime``, ``lang``, ``excerpt``, ``content_hash``.

    ``parsed`` is the normalised title and content. A declared language is
    taken as two letters, else it is guessed. An excerpt that is missing is
    the first 800 characters of the content.
    """
    clean = lambda c: clean_whitespace(F.coalesce(F.col(c), F.lit("")))
    rows = pages.withColumns({"title": clean("title"), "content": clean("content")})
    rows = rows.withColumn("parsed", normalize_text(F.concat("title", F.lit("\n\n"), "content")))
    return rows.withColumns(
        {
            "length": F.length("parsed"),
            "datetime": guess_date(F.col("date")),
            "lang": detected_language(F.col("content"), F.col("lang")),
            "excerpt": F.coalesce(F.nullif(clean("excerpt"), F.lit("")), F.substring("content", 1, 800)),
            "content_hash": F.when(F.col("parsed") != "", F.sha1("parsed")),
        }
    )


def detected_language(text: Column, declared: Column | None = None) -> Column:
    """The declared language as two letters, else one guessed by frequent words; null for fewer than 5 characters."""
    guess = F.when(F.length(text) >= 5, guess_language(text))
    return F.coalesce(language_code(declared), guess) if declared is not None else guess


def _missing(df: DataFrame, column: str, made: Column) -> DataFrame:
    """The column, made where it is null; rows that have it keep it."""
    return df.withColumn(column, F.when(F.col(column).isNull(), made).otherwise(F.col(column)) if column in df.columns else made)


def tokenize(pages: DataFrame, text: str = "parsed") -> DataFrame:
    """Pages with ``tokenized``, sentences of tokens as they are written, where it is null and there is a text."""
    return _missing(pages, "tokenized", F.when(F.col(text).isNotNull(), tokenize_sentences(F.col(text), normalize=False, stemmed=False, stop=False)))


def stem(pages: DataFrame, key: str, ngrams: DataFrame | None = None) -> DataFrame:
    """Pages with ``stemmed`` where it is null: n-grams merged, frequent words gone, the rest stemmed; empty sentences go.

    Only pages that lack it are read into the sentences that the n-grams are merged in.
    """
    todo = pages if "stemmed" not in pages.columns else pages.where("stemmed IS NULL")
    sentences = todo.where("tokenized IS NOT NULL").select(key, F.col("lang").alias("__lang"), F.posexplode("tokenized").alias("__at", "tokens"))
    merged = sentences if ngrams is None else replace_ngrams(sentences, ngrams)
    done = merged.select(key, "__at", post_filter(F.col("tokens"), F.col("__lang")).alias("s")).where("size(s) > 0")
    lists = done.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "s"))), lambda x: x["s"]).alias("__new"))
    out = pages.join(lists, key, "left")
    made = F.when(F.col("tokenized").isNotNull(), F.coalesce("__new", F.array().cast("array<array<string>>")))
    return _missing(out, "stemmed", made).drop("__new")


def vectorize(pages: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Pages with ``vectorized``: the weighted mean of their words' output vectors (``token``, ``out``, ``df``, ``docs``)."""
    tokens = pages.where("stemmed IS NOT NULL").select(key, F.explode(F.flatten("stemmed")).alias("token"))
    made = features(tokens, words.select("token", F.col("out").alias("vector"), "df", "docs"), key).select(key, F.col("vector").cast("array<float>").alias("__v"))
    return pages.drop("vectorized").join(made, key, "left").withColumnRenamed("__v", "vectorized")


def records(pages: DataFrame, selectors: Selector | Sequence[Selector] = "body") -> DataFrame:
    """Fetched pages (``url``, ``html``) as records with what their markup says; those without a title or a content are left out.

    Pages of the encyclopaedia have their text in an element of its own.
    """
    h = F.col("html")
    # Other pages are null to the parser of the encyclopaedia's element, which leaves them alone.
    own = page_text(F.when(domain_of(F.col("url")).endswith("wikipedia.org"), h), ("div", {"id": "bodyContent"}))
    rows = pages.withColumn("content", F.coalesce(F.nullif(own, F.lit("")), page_text(h, selectors)))
    rows = rows.withColumns({"title": page_title(h, F.col("content")), "excerpt": page_excerpt(h), "date": page_date(h), "lang": page_lang(h), "h1": headings(h, 1), "h2": headings(h, 2)})
    return rows.where("content <> '' AND title <> ''").drop("html")
