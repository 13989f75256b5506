import os
import random
from datetime import UTC, datetime
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from folioflow.functions import dates, markup
from folioflow.functions import tokens as K
from folioflow.functions import urls as U
from folioflow.operators import jobs
from folioflow.plans import corpus
from folioflow.sources import archives, mailbox, web

SF = "/root/testdata/sf0.001"


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def utc(*parts):
    return datetime(*parts, tzinfo=UTC)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2023-01-14", utc(2023, 1, 14)),
        ("2023-01-14T15:30:00Z", utc(2023, 1, 14, 15, 30)),
        ("2023-01-14 15:30:00+02:00", utc(2023, 1, 14, 13, 30)),
        ("2023-01-14T15:30:00.123-0500", utc(2023, 1, 14, 20, 30)),
        ("Tue, 14 Feb 2023 08:05:09 GMT", utc(2023, 2, 14, 8, 5, 9)),
        ("Tue, 14 Feb 2023 08:05:09 PST", utc(2023, 2, 14, 16, 5, 9)),
        ("posted on March 3rd, 2021 at 4:05 pm by someone", utc(2021, 3, 3, 16, 5)),
        ("3 September 2019", utc(2019, 9, 3)),
        ("07/04/2020", utc(2020, 7, 4)),
        ("25/12/2020", utc(2020, 12, 25)),
        ("D:20230114153000+01'00'", utc(2023, 1, 14, 14, 30)),
        ("D:20230114153000+00:0000'00'", utc(2023, 1, 14, 15, 30)),
        ("D:2023", utc(2023, 1, 1)),
        ("31 Feb 2020", None),
        ("2023", None),
        ("nothing of the kind", None),
        ("", None),
        (None, None),
    ],
)
def test_guessed_dates(spark, text, want):
    got = column(spark, [text], lambda x: F.unix_seconds(dates.guess_date(x)))[0]
    assert got == (int(want.timestamp()) if want else None)


def test_each_form_of_a_date_is_searched_once(spark):
    text = str(dates.guess_date(F.col("t")))
    assert text.count("regexp_extract") + text.count("regexp_replace(translate") < 30
    # A text that has the mark between parts, a year 0, days that the month lacks.
    texts = ["\x01on 2024-02-29 10:30", "\x0112\x012024\x01", "0000-1-15", "2023-02-29", "2/30/2023", "1900-02-29"]
    want = ["2024-02-29 10:30:00", None, "0000-01-15 00:00:00", None, None, None]
    assert column(spark, texts, lambda x: dates.guess_date(x).cast("string")) == want


def test_other_dates(spark):
    assert column(spark, ["x 11 Oct 2017 y", "40 Oct 2017", "11 Foo 2017"], lambda x: dates.human_date(x).cast("string")) == ["2017-10-11 00:00:00", None, None]
    assert column(spark, ["2024-05-01", "2024-05-01T10:00:00+02:00", "1 May"], lambda x: dates.iso_date(x).cast("string")) == ["2024-05-01 00:00:00", "2024-05-01 08:00:00", None]
    assert column(spark, ["the 5th of June, 2019 or so"], lambda x: dates.guess_date(x, fuzzy=True).cast("date").cast("string")) == ["2019-06-05"]
    rows = spark.createDataFrame([({"date": "03-04-2020"},), ({"date": "bad", "delivery-date": "2020-01-02"},), ({},)], "x map<string,string>")
    assert [r[0] for r in rows.select(dates.mail_date(F.col("x")).cast("string")).collect()] == ["2020-04-03 00:00:00", "2020-01-02 00:00:00", "1970-01-01 00:00:00"]


def test_absolute_addresses(spark):
    base = "https://a.org/x/y.html?q=1"
    links = ["z.html", "../z", "./z/./w", "/r/../s", "//b.org/k", "?p=2", "#top", "", "mailto:a@b.c", "../../../up?x=../y", "z/.."]
    want = ["https://a.org/x/z.html", "https://a.org/z", "https://a.org/x/z/w", "https://a.org/s", "https://b.org/k", "https://a.org/x/y.html?p=2", "https://a.org/x/y.html?q=1#top", base, "mailto:a@b.c", "https://a.org/up?x=../y", "https://a.org/x/"]
    assert column(spark, links, lambda x: U.absolute(x, F.lit(base))) == want
    urls = ["https://www.a.org:8080/x/", "https://www.a.org/#/virtual/", "https://web.archive.org/web/2020/https://a.org/#/v"]
    assert column(spark, urls, U.canonical_url) == ["https://a.org/x", "https://www.a.org/#/virtual/", "https://web.archive.org/web/2020/https://a.org/#/v"]
    assert column(spark, urls[:1], lambda x: U.canonical_url(x, keep_www=True)) == ["https://www.a.org/x"]


PAGE = """<html lang=fr><head><title> A  title </title></head><body><nav>menu <a href='/m'>m</a></nav><div id="content" class="wide main"><h1>Head #</h1><p>First <b>bold</b> &amp; more.</p><script>no()</script></div>
<div class="main">Second</div><div class="main">Second</div><form>gone</form><a href=/plain>p</a> <a class="x" href="q.html#a">q</a><a href="#here">h</a><a href="javascript:x()">j</a></body></html>"""


def test_parts_of_pages(spark):
    assert markup.text_of(PAGE, ["h1", ("div", {"class": "main"})]).split() == "Head # Head #First bold & more. Second".split()
    assert "menu" not in markup.text_of(PAGE, ["body"]) and "gone" not in markup.text_of(PAGE, ["body"]) and "no()" not in markup.text_of(PAGE, ["body"])
    got = spark.createDataFrame([(PAGE,), (None,), ("no markup",)], "h string").select(markup.page_links(F.col("h")).alias("l"), markup.page_title(F.col("h")).alias("t"), markup.headings(F.col("h"), 1).alias("h1"), markup.page_lang(F.col("h")).alias("lang"), markup.page_text(F.col("h"), ("div", {"id": "content"})).alias("c"), markup.page_date(F.col("h")).alias("d")).collect()
    assert got[0]["l"] == ["/m", "/plain", "q.html#a"] and got[0]["t"] == "A title" and got[0]["h1"] == ["Head"] and got[0]["lang"] == "fr" and got[0]["c"] == "Head #\nFirst bold & more." and got[0]["d"] is None
    assert tuple(got[1]) == (None,) * 6 and got[2]["l"] == [] and got[2]["c"] == ""
    titles = spark.createDataFrame([("<h1>One <i>two</i></h1>", "x"), ("<p>", "c" * 60), ("<p>", "short")], "h string, c string").select(markup.page_title(F.col("h"), F.col("c"))).collect()
    assert [r[0] for r in titles] == ["One two", "c" * 50, None]
    assert column(spark, ["<style>p{}</style><p>A &eacute; &#39;b&#39;</p><img src=x>c"], markup.mail_text) == ["A é 'b'\nc"]


class Words(HTMLParser):
    """All text outside of dropped elements, told by a count of those that are open."""

    def __init__(self):
        super().__init__()
        self.depth, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in markup.DROPPED and tag not in markup._VOID

    def handle_endtag(self, tag):
        self.depth -= tag in markup.DROPPED and tag not in markup._VOID

    def handle_data(self, data):
        if not self.depth:
            self.words += data.split()


def test_records_have_the_words_of_their_pages(spark):
    pages = corpus.stated_pages(spark, SF)
    got = {r["url"]: r for r in jobs.parse(jobs.records(pages)).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        parser = Words()
        parser.feed(r["html"][r["html"].lower().index("<body") :])
        assert got[r["url"]]["content"].split() == parser.words
        assert got[r["url"]]["length"] == len(got[r["url"]]["parsed"]) and got[r["url"]]["datetime"] is not None and len(got[r["url"]]["lang"]) == 2


def test_jobs_resume_and_merge(spark):
    pages = spark.createDataFrame([(1, "u1", "t", "New York is big. It rains!", "2020-01-01", "en", None), (2, "u2", None, None, None, None, None), (3, "u3", "x", "y", "bad", "xx-YY", "e")], "id long, url string, title string, content string, date string, lang string, excerpt string")
    parsed = jobs.parse(pages)
    rows = {r["id"]: r for r in parsed.collect()}
    assert rows[1]["parsed"] == "t\n\nnew york is big. it rains!" and rows[1]["excerpt"] == "New York is big. It rains!" and rows[2]["parsed"] == "" and rows[2]["content_hash"] is None and rows[3]["lang"] == "xx"
    tokens = jobs.tokenize(parsed)
    ngrams = spark.createDataFrame([(["new", "york"],)], "members array<string>")
    stems = {r["id"]: r["stemmed"] for r in jobs.stem(tokens, "id", ngrams).collect()}
    assert stems[1][1] == [s for s in stems[1][1] if "york" in s or s] and any("newyork" in t for s in stems[1] for t in s) and stems[2] == []
    kept = jobs.stem(tokens.withColumn("stemmed", F.when(F.col("id") == 1, F.array(F.array(F.lit("k"))))), "id", ngrams)
    assert {r["id"]: r["stemmed"] for r in kept.collect()}[1] == [["k"]]
    words = spark.createDataFrame([("t", [1.0, 0.0], 1, 2), ("x", [0.0, 2.0], 2, 2)], "token string, out array<double>, df long, docs long")
    made = {r["id"]: r["vectorized"] for r in jobs.vectorize(jobs.stem(tokens, "id"), words, "id").collect()}
    assert made[1] == pytest.approx([1, 0], abs=1e-6) and made[2] is None and made[3] == pytest.approx([0, 1], abs=1e-6)


def test_tokens(spark):
    said = ["Hello,", "the", "_it_", "2045", "e62fabc2", "2.5", "4.999.23", "new_york", "_DATE_", "a b", "''", None]
    assert column(spark, said, lambda x: K.normalize_token(F.lower(x), stemmed=False)) == ["hello", None, None, "_NUMBER_", "_HASH_", "_NUMBER_", "_NUMBER_", "new_york", "_DATE_", None, None, None]
    assert column(spark, ["the", "der"], lambda x: K.normalize_token(x, F.lit("de"), stemmed=False)) == ["the", None]
    assert column(spark, ["asap"], lambda x: K.normalize_token(x, stemmed=False, replacements={"asap": "soon"})) == ["soon"]
    assert column(spark, ["new_york_city", "_DATE_", "of_DATE", "word"], K.members_of) == [["new", "york", "city"], None, ["of", "_DATE_"], None]
    assert column(spark, ["chevaux", "cars", "gas", "aux", "ponies"], K.singular) == ["cheval", "car", "gas", "aux", "ponie"]
    assert column(spark, ["One two.\n\nThree the four"], lambda x: K.tokenize_paragraphs(F.lower(x), stemmed=False, meta=False)) == [[["one", "two"], ["three", "four"]]]
    assert column(spark, [b"caf\xc3\xa9", b"a\xffb", None], K.known_text, "binary") == ["café", "a\ufffdb", None]
    assert column(spark, [b"caf\xe9", None], lambda x: K.known_text(x, "ISO-8859-1"), "binary") == ["café", None] and column(spark, [b"a\xffb"], lambda x: K.known_text(x, "ascii"), "binary") == ["a\ufffdb"]


def test_folder_names_go_through_the_codec():
    rng = random.Random(1)
    assert K.imap_encoded("A & B") == "A &- B" and K.imap_encoded("Entwürfe") == "Entw&APw-rfe" and K.imap_encoded("台北") == "&U,BTFw-" and K.imap_decoded("~peter/mail/&U,BTFw-/&ZeVnLIqe-") == "~peter/mail/台北/日本語"
    for _ in range(300):
        name = "".join(rng.choice("ab&-/ ü台\U0001f600\t") for _ in range(rng.randrange(12)))
        assert K.imap_decoded(K.imap_encoded(name)) == name and K.imap_encoded(name).isascii()


def test_crawls(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "y"), ("d", "a")], "url string, link string")
    seeds = spark.createDataFrame([("a",)], "url string")
    at = lambda df: {r["url"]: r["depth"] for r in df.collect()}
    assert at(web.crawl(links, seeds, 2)) == {"a": 0, "b": 1, "x": 1, "c": 2, "y": 2}
    assert at(web.crawl(links, seeds, 9, within=F.col("link") != "x")) == {"a": 0, "b": 1, "c": 2, "d": 3}
    hashes = spark.createDataFrame([("a", "1"), ("b", "2"), ("x", "2"), ("c", "3"), ("d", "4")], "url string, content_hash string")
    assert at(web.crawl(links, seeds, 9, hashes=hashes)) == {"a": 0, "b": 1, "x": 1, "c": 2, "d": 3}
    robots = spark.createDataFrame([("a.org", "User-agent: *\nDisallow: /private # no\nCrawl-delay: 90\n\nUser-agent: Bot\nDisallow:")], "domain string, text string")
    rules = web.robots_rules(robots)
    assert {(r["agent"], tuple(r["disallow"]), r["delay"]) for r in rules.collect()} == {("*", ("/private",), 30.0), ("bot", (), None)}
    urls = spark.createDataFrame([("https://a.org/1",), ("https://a.org/private/2",), ("https://a.org/3",), ("https://b.org/1",)], "url string")
    assert sorted(map(tuple, web.schedule(urls, rules).collect())) == [("https://a.org/1", 0.0), ("https://a.org/3", 30.0), ("https://b.org/1", 0.0)]
    assert column(spark, ["text/html; x", "application/pdf", None, ""], lambda x: web.media_type(x, F.lit("https://a.org/k.XML?z"))) == ["html", "pdf", "xml", "xml"]


def test_archives_and_staging(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "word string, frequency double")
    path = str(tmp_path / "x")
    archives.save(df, path)
    assert archives.open_archive(spark, path).count() == 2 and archives.modified(spark, path).first()[0] is not None
    with pytest.raises(FileNotFoundError):
        archives.open_archive(spark, path + "-none")
    archives.write_word_list(df, path + ".words")
    assert [tuple(r) for r in archives.word_list(spark, path + ".words").orderBy("word").collect()] == [("a", 1.0), ("b", 2.0)]
    staged = archives.staged(spark)
    archives.append(spark.createDataFrame([("u", 1)], "url string, extra int"), staged)
    archives.append(spark.createDataFrame([("u",)], "url string"), staged)
    assert archives.open_archive(spark, staged).count() == 2
    archives.drop_staged(spark, staged)
    assert not os.path.exists(staged.removeprefix("file:"))
    with pytest.raises(OSError):
        archives.staged(spark, 1 << 60)
    archives.save_model(spark, "m", {"words": df})
    assert archives.load_model(spark, "m", ("words",))["words"].count() == 2
    archives.write_domains(spark.createDataFrame([("a",), ("a",), (None,)], "domain string"), path + ".domains")
    assert [r[0] for r in spark.read.text(path + ".domains").collect()] == ["a: 2", "(none): 1"]
    nested = spark.createDataFrame([([[1, 2], [3]],), (None,), ([[]],)], "x array<array<int>>")
    assert sorted(r[0] for r in archives.items(nested, "x", 1).collect()) == [1, 2, 3] and archives.count_items(nested, "x", 1).first()[0] == 3
    spark.sql("DROP TABLE IF EXISTS made")
    from pyspark.sql import types as T

    assert archives.create(spark, "made", T.StructType.fromDDL("a int")).columns == ["a"] and archives.create(spark, "made", T.StructType.fromDDL("a int, b string")).columns == ["a", "b"]
    spark.sql("DROP TABLE made")


MAIL = b"From: Ann <ann@a.org>\r\nTo: b@b.org\r\nSubject: =?utf-8?q?Caf=C3=A9?=\r\nMessage-ID: <1@a>\r\nDate: Tue, 14 Feb 2023 08:05:09 +0000\r\nReceived: one\r\nReceived: two\r\nStatus: RO\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=X\r\n\r\n--X\r\nContent-Type: text/html\r\n\r\n<p>Hi</p>\r\n--X\r\nContent-Type: text/calendar\r\nContent-Disposition: attachment; filename=a.ics\r\n\r\nx\r\n--X--\r\n"


def test_files_of_mail_and_contacts(spark, tmp_path):
    mailbox.register(spark)
    box = tmp_path / "Inbox"
    box.mkdir()
    (box / "1.eml").write_bytes(MAIL)
    (box / "all.mbox").write_bytes(b"From a\n" + MAIL.replace(b"\r\n", b"\n") + b"\nFrom b\n" + MAIL.replace(b"\r\n", b"\n"))
    rows = spark.read.format("mailfiles").load(str(box)).collect()
    assert len(rows) == 3 and {r["folder"] for r in rows} == {"Inbox", "all"}
    assert all(r["subject"] == "Café" and r["html"].strip() == "<p>Hi</p>" and r["plain"] is None and r["received"] == ["one", "two"] and r["attachments"] == ["a.ics"] and "Seen" in r["flags"] for r in rows)
    (tmp_path / "c.vcf").write_text("BEGIN:VCARD\nUID:1\nFN:Ann Lee\nEMAIL;TYPE=home:Ann@a.org\nEMAIL:b@b.org\nCATEGORIES:x,y\nNOTE:long\n  line\nEND:VCARD\nBEGIN:VCARD\nFN:No Mail\nEND:VCARD\n")
    cards = spark.read.format("contacts").load(str(tmp_path / "c.vcf")).orderBy("name").collect()
    assert [(c["name"], c["emails"]) for c in cards] == [("Ann Lee", ["ann@a.org", "b@b.org"]), ("No Mail", [])] and cards[0]["properties"]["categories"] == ["x", "y"] and cards[0]["properties"]["note"] == ["long line"]


def test_a_token_is_read_by_each_pattern_once(spark):
    one = spark.createDataFrame([("x",)], "t string").select(K.normalize_token(F.col("t"), stemmed=False, stop=False).alias("n"))
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^[+-]?[0-9]+") == 1 and plan.count("^_+|_+$") == 1 and plan.count("^.+_.+$") == 1


def test_the_encyclopaedias_element_is_sought_in_its_pages_only(spark):
    pages = spark.createDataFrame([("https://a.org/x", "<title>t</title><body>b c</body>"), ("https://en.wikipedia.org/x", "<title>t</title><body>b<div id='bodyContent'>own</div></body>"), ("https://a.org/y", "<title>t</title><body> </body>")], "url string, html string")
    made = jobs.records(pages)
    assert {r["url"]: r["content"] for r in made.collect()} == {"https://a.org/x": "b c", "https://en.wikipedia.org/x": "own"}
    picks = [x for x in made._jdf.queryExecution().analyzed().toString().split("pick(")[1:]]
    assert any("CASE WHEN" in x.split(")#")[0] for x in picks)
