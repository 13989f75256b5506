import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions import urls as U
from folioflow.operators import dedup, graph, mail, tables
from folioflow.plans import queries as plans
from folioflow.sources.pages import PAGE, sanitize

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got = plans.queries()[name](spark, SF)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = db.execute(plans.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(str([plain(v) for v in r]) for r in rel.fetchall()) == sorted(str([plain(r[n]) for n in names]) for r in got.collect())


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.a.org/x/?utm=1#top", "https://a.org/x"),
        ("a.org/watch?v=3", "https://a.org/watch?v=3"),
        ("http://en.m.wikipedia.org/wiki/A", "http://en.wikipedia.org/wiki/A"),
        ("https://web.archive.org/web/2020/http://a.org/p/", "http://a.org/p"),
        ("https://a.org/f.pdf#page=3", "https://a.org/f.pdf#page=3"),
        ("https://www.web.com/", "https://web.com"),
        ("https://a.org/login", None),
        ("not a url", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    once = spark.createDataFrame([(url,)], "u string").select(U.canonical_url(F.col("u")).alias("u"))
    assert once.first()["u"] == want and once.select(U.canonical_url(F.col("u"))).first()[0] == want


def naive_near(rows, threshold, distance):
    """The forward scan itself: rows of (key, url, text) in the order of addresses."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    gone = set()
    for i, r in enumerate(rows):
        if i in gone:
            continue
        near = [j for j in range(i + 1, min(i + distance, len(rows))) if j not in gone and dedup.similarity(r[2], rows[j][2], threshold) > threshold]
        if near:
            group = [i, *near]
            best = max(group, key=lambda k: (len(rows[k][2]), -k))
            gone.update(k for k in group if k != best)
    return {r[0] for i, r in enumerate(rows) if i not in gone}


def test_near_copies_equal_the_forward_scan(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        t = list("abcdefghij" * 4 if i % 3 else "klmnopqrst" * 4)
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = "z"
        rows.append((i, f"u{rng.randrange(40):02d}", "".join(t)))
    df = spark.createDataFrame(rows, "id long, canonical_url string, parsed string").withColumns({"category": F.lit("c"), "datetime": F.lit(None).cast("timestamp"), "crawled": F.lit(None).cast("timestamp"), "length": F.length("parsed")})
    got = {r["id"] for r in dedup.drop_near_copies(df, "id", threshold=0.92, distance=9).collect()}
    assert got == naive_near(rows, 0.92, 9)


def test_similarity_is_that_of_the_longest_common_subsequence():
    assert dedup.similarity("abcd", "abxd", 0) == 0.75
    assert dedup.similarity("", "", 0) == 1 and dedup.similarity("a", "a" * 50, 0.9) == 0


def test_similarity_gives_up_early_but_never_wrongly():
    rng = random.Random(3)

    def plain_ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        return 2 * row[-1] / max(1, len(a) + len(b))

    for k in range(150):
        a = "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 400)))
        b = "".join(c for c in a if rng.random() > 0.1 * (k % 5)) + "z" * rng.randrange(20)
        b = b if k % 3 else "".join(x for c in b for x in (c, rng.choice("abq"))[: 1 + (rng.random() < 0.15)])
        want = plain_ratio(a, b)
        for least in (0.0, 0.5, 0.9, want - 1e-9, want):
            got = dedup.similarity(a, b, least)
            assert got == want if want > least else got in (0, want)


def test_texts_of_one_language_are_told_apart_at_once(monkeypatch):
    rng = random.Random(5)
    a, b = ("".join(rng.choice("etaoin shrdlu") for _ in range(4000)) for _ in "ab")
    steps, plain = [], dedup._masks
    monkeypatch.setattr(dedup, "_masks", lambda x, y: steps.append(len(y)) or plain(x, y))
    assert dedup.similarity(a, b, 0.9) == 0 and sum(steps) < 2000


def test_components_of_a_chain_and_of_nothing(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (9, 8), (5, 5)], "a long, b long")
    assert {(r["node"], r["root"]) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    assert graph.components(edges.limit(0)).count() == 0


def test_sanitised_records(spark):
    df = spark.createDataFrame([("u", None, "x" * 900, "", 0), ("v", "t", None, "p", 3)], "url string, title string, content string, parsed string, length int")
    got = {r["url"]: r for r in sanitize(df).collect()}
    assert sanitize(df).columns == PAGE.names
    assert (got["u"]["title"], len(got["u"]["excerpt"]), got["u"]["parsed"], got["u"]["length"]) == ("", 800, None, None)
    assert (got["v"]["content"], got["v"]["h1"], got["v"]["parsed"], got["v"]["length"]) == ("", [], "p", 3)


def test_text_functions(spark):
    one = spark.createDataFrame([("½ “Été”™  x\t y\n\n\n\nz",)], "t string").select(X.normalize_text(F.col("t")).alias("n"), X.balanced(F.lit("a (b) c) (d")).alias("b")).first()
    assert one["n"] == '12 "ete"TM x y\n\nz' and one["b"] == "a (b) c d"


def test_rules_count_runs_and_failures_apart(spark):
    mails = spark.createDataFrame([("a", "hello?"), ("b", None)], "message_id string, body string")
    state = spark.createDataFrame([("a", "q", 1, 0)], "message_id string, rule string, processed long, errored long")
    rule = mail.Rule("q", 1, F.contains(F.col("body"), F.lit("?")), "flag")
    assert mail.run_rules(mails, [rule], state).count() == 0
    done = spark.createDataFrame([("a", "q", False)], "message_id string, rule string, ok boolean")
    assert tuple(mail.log_runs(state, done).first()) == ("a", "q", 1, 1)


def test_upsert_with_missing_columns(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    got = tables.upsert(old, spark.createDataFrame([(2,), (3,)], "k long"), "k").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a"), (2, None), (3, None)]


def test_archived_twins_go_by_their_least_id(spark):
    rows = [(i, "w/a" if i % 2 else "w/b") for i in range(40, 0, -1)]
    df = spark.createDataFrame(rows, "id long, url string").repartition(4)
    got = tables.unwrap_addresses(df, F.replace("url", F.lit("w/"), F.lit("")))
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "b")]


def test_numbers_of_many_parts_are_whole(spark):
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in small if spark.conf.get(k, None)}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("url"))
        # A second column, which the sizes don't need, makes the exchanges differ.
        wide = df.select("url", F.concat(*[F.sha2(F.concat("url", F.lit(str(i))), 256) for i in range(8)]).alias("wide"))
        got = [r[:2] for r in dedup.numbered(wide, F.col("url")).select("url", "place", "wide").collect()]
    finally:
        for k in small:
            spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)
    assert sorted(p for _, p in got) == list(range(20_000))
    assert [u for u, _ in sorted(got, key=lambda r: r[1])] == sorted(u for u, _ in got)


def test_meta_tokens_are_those_of_the_sql(spark):
    texts = ["a\x0b@bob.x e.g. 3\u212am \u017fay 10 k\u212a\u017f", "see http://a.b/c?d, x@y.org, 1.2.3.4 f.py (10:30) 5 GB\\ [b]x[/b] ----", "", None, "\u20ac5 20\u20ac 90 \u00b0C", "x" * 70]
    db = duckdb.connect()
    want = [db.execute(f"SELECT {X.sql_prefilter('$1')}", [t]).fetchone()[0] if t is not None else None for t in texts]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(X.prefiltered(F.col("t"))).collect()] == want
