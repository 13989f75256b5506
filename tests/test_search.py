import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import dedup, index, mail, mailrules, models, ngrams, retrieval, tables, vectors
from folioflow.plans import search

SF = "/root/testdata/sf0.001"


def naive_phrases(sentences, min_count, threshold, connectors=()):
    one, two = Counter(), Counter()
    for words in sentences:
        one.update(words)
        content = [i for i, w in enumerate(words) if w not in connectors]
        two.update(tuple(words[i : j + 1]) for i, j in zip(content, content[1:], strict=False))
    total, out = sum(one.values()), set()
    for p, n in two.items():
        share = n / total
        if n >= min_count and math.log(share / (one[p[0]] / total * one[p[-1]] / total)) / -math.log(share) > threshold:
            out.add(p)
    return out


def test_ngrams_of_two_passes_equal_a_plain_count(spark):
    rng = random.Random(5)
    sentences = []
    for _ in range(400):
        words = [rng.choice("abcdefghij") for _ in range(rng.randrange(9))]
        for phrase in (["new", "york", "city"], ["state", "of", "art"], ["l'", "eau"]):
            if rng.random() < 0.2:
                at = rng.randrange(len(words) + 1)
                words[at:at] = phrase
        sentences.append(words)
    got = {tuple(r["members"]) for r in ngrams.train_ngrams(spark.createDataFrame([(s,) for s in sentences], "tokens array<string>"), connectors=["of"]).collect()}
    first = naive_phrases(sentences, 10, 0.7, ["of"])
    tree = ngrams.tree_of(sorted(first))
    merged = [ngrams.replaced(tree, s) for s in sentences]
    second = {tuple(w for part in p for w in part.split("_")) for p in naive_phrases(merged, 10, 0.7, ["of"])}
    assert got == first | second and ("new", "york", "city") in got and ("state", "of", "art") in got
    assert ngrams.lookup(tree, ["l'", "eau"]) is None and ngrams.lookup(ngrams.tree_of([["a", "b"]]), ["a", "b"]) == "a_b" and ngrams.lookup(tree, ["foo"]) is None


def test_bigrams_are_counted_in_one_reading(spark):
    rng = random.Random(9)
    sentences = [[rng.choice("abcde") for _ in range(rng.randrange(7))] for _ in range(200)] + [["x", "y"]] * 12
    read = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<string>")
    def seen(words):
        read.add(len(words))
        return words

    df = spark.createDataFrame([(s,) for s in sentences] + [(None,), (["x", None, "y"],)], "tokens array<string>").select(seen("tokens").alias("tokens"))
    got = {tuple(r["phrase"].split("_")): r["n"] for r in ngrams.score_bigrams(df).where("npmi > 0.7").collect()}
    assert got == {("x", "y"): 12} and read.value == len(sentences) + 2
    one = Counter(w for s in sentences for w in s)
    score = ngrams.score_bigrams(df).where("phrase = 'x_y'").first()["npmi"]
    total = sum(one.values()) + 3
    assert math.isclose(score, math.log(12 / total / (13 / total) ** 2) / -math.log(12 / total))


def test_words_are_scored_where_documents_are_read(spark, monkeypatch):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30)))) for i in range(40)] + [(98, ""), (99, None)]
    asked = [(1, "a b zz"), (2, "--"), (3, "H c, c"), (4, None)]
    docs, queries = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    bags = {i: Counter((t or "").split()) for i, t in texts}
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    want = {}
    for q, terms in ((1, "ab"), (3, "hc")):
        for i, bag in bags.items():
            for t in terms:
                df = sum(t in b for b in bags.values())
                if bag[t]:
                    part = math.log((n - df + 0.5) / (df + 0.5)) * ((bag[t] * 1.8 + 1) / (bag[t] + 1.8 * (0.6 + 0.4 * sum(bag.values()) / mean)) + 0.8)
                    want[q, i] = want.get((q, i), 0) + part
    for cells in (retrieval.CELLS, 1):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        scored = retrieval.bm25(docs, queries)
        assert not any(x in scored._jdf.queryExecution().executedPlan().toString() for x in ("Join", "Exchange"))
        got = {(r["item_id"], r["doc_id"]): r["score"] for r in scored.collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
        few = retrieval.top(retrieval.bm25(docs, queries, best=3), "item_id", [F.desc("score"), F.desc("doc_id")], 3).collect()
        order = lambda q: sorted((-round(s, 6), -d) for (p, d), s in want.items() if p == q)[:3]
        assert all(sorted((-r["score"], -r["doc_id"]) for r in few if r["item_id"] == q) == order(q) for q in (1, 3))


def test_ngrams_merge_alike_in_both_ways(spark):
    rng = random.Random(6)
    grams = spark.createDataFrame([(["a", "b"],), (["a", "b", "c"],), (["c", "a"],), (["l'", "a"],), (["x"],)], "members array<string>")
    rows = [(i, [rng.choice(["a", "b", "c", "l'"]) for _ in range(rng.randrange(12))], "k") for i in range(60)] + [(99, None, "k")]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, other string")
    small, large = (sorted(map(tuple, ([r["id"], str(r["tokens"]), r["other"]] for r in ngrams.replace_ngrams(df, grams, bound=b).collect()))) for b in (100, 0))
    assert small == large and len(small) == 61
    got = {r["id"]: r["tokens"] for r in ngrams.replace_ngrams(df.limit(0).unionAll(spark.createDataFrame([(1, list("aabcab"), "k")], df.schema)), grams).collect()}
    assert got == {1: ["a", "a_b_c", "a_b"]}


def test_resolved_tokens(spark):
    vocabulary = spark.createDataFrame([("libertarian", 50), ("liber_tarian", 3), ("etre_humain", 9), ("x_y", 90), ("xy", 3)], "token string, n long")
    asked = spark.createDataFrame([("liber_tarian",), ("etres_humains",), ("x_y",), ("plain",), ("_DATE_",), ("no_where",)], "token string")
    got = {r["token"]: r["resolved"] for r in ngrams.resolve_tokens(asked, vocabulary).collect()}
    assert got == {"liber_tarian": "libertarian", "etres_humains": "etre_humain", "x_y": "x_y", "plain": "plain", "_DATE_": "_DATE_", "no_where": "no_where"}


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) * [9, 4, 1, 1, 1, 1] + [3, 0, 0, 0, 0, 5]
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "id long, vector array<double>")


def test_components_and_their_removal(cloud):
    x, df = cloud
    mean, axes, shares = vectors.components(df, "vector", 3)
    centred = x - x.mean(axis=0)
    _, sigma, right = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(np.abs(axes), np.abs(right[:3]), atol=1e-6) and np.allclose(shares, (sigma**2 / (sigma**2).sum())[:3])
    got = {r["id"]: r["vector"] for r in vectors.without_component(df).collect()}
    want = x - np.outer(x @ right[0], right[0])
    assert got[999] is None and np.allclose([got[i] for i in range(400)], want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-6)
    top = {r["id"]: r["vector"] for r in vectors.all_but_the_top(df, most=3).collect()}
    assert np.allclose([top[i] for i in range(400)], centred - centred @ right[:2].T @ right[:2], atol=1e-6)
    bare = {r["id"]: r["vector"] for r in vectors.all_but_the_top(df, most=0).collect()}
    assert np.allclose([bare[i] for i in range(400)], centred) and vectors.all_but_the_top(df, most=-1) is df


def test_products_take_the_best_of_rows_and_of_vectors(spark, cloud, monkeypatch):
    x, df = cloud
    q = x[:7]
    matrix = spark.createDataFrame([(f"q{i}", r.tolist()) for i, r in enumerate(q)], "name string, v array<double>")
    score = np.round(x @ q.T, 6)
    for size in (vectors.MATRIX_BYTES, 100):
        monkeypatch.setattr(vectors, "MATRIX_BYTES", size)
        got = {(r["id"], r["name"]): r["score"] for r in vectors.products(df, "id", "vector", matrix, "name", "v", 2).collect()}
        assert got == {(i, f"q{j}"): score[i, j] for i in range(400) for j in sorted(range(7), key=lambda j: (-score[i, j], j))[:2]}
        got = {(r["id"], r["name"]): r["score"] for r in vectors.products(df, "id", "vector", matrix, "name", "v", 3, of="matrix").collect()}
        assert got == {(i, f"q{j}"): score[i, j] for j in range(7) for i in sorted(range(400), key=lambda i: (-score[i, j], -i))[:3]}
    assert vectors.products(df, "id", "vector", matrix.limit(0), "name", "v", 2).count() == 0


def test_clusters_of_far_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) + 20 * np.eye(4)[i % 3]).tolist()) for i in range(90)]
    got = vectors.clusters(spark.createDataFrame(rows, "id long, vector array<double>"), k=3).collect()
    assert len({(r["id"] % 3, r["cluster"]) for r in got}) == 3


def test_word_vectors_put_like_words_together(spark):
    rng = random.Random(3)
    groups = [[f"{g}{i}" for i in range(8)] for g in "abc"]
    sentences = [[rng.choice(g) for _ in range(8)] for _ in range(200) for g in groups]
    words = models.word_vectors(spark.createDataFrame([(s,) for s in sentences], "tokens array<string>"), dims=10)
    rows = {r["token"]: (np.array(r["vector"]), np.array(r["out"])) for r in words.collect()}
    assert len(rows) == 24 and words.columns == ["token", "n", "vector", "out"]
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    for side in (0, 1):
        near = [cosine(rows["a0"][0], rows[f"a{i}"][side]) for i in range(1, 8)]
        far = [cosine(rows["a0"][0], rows[f"b{i}"][side]) for i in range(8)]
        assert min(near) > max(far)
    assert models.word_vectors(spark.createDataFrame([(["x"],)], "tokens array<string>")).count() == 0
    like = models.subword_vectors(words, spark.createDataFrame([("a1",), ("sailing",), ("sailings",), ("quartz",)], "token string"), 64)
    v = {r["token"]: np.array(r["vector"]) for r in like.collect()}
    assert len(v["a1"]) == 10 and len(v["quartz"]) == 64 and v["sailing"] @ v["quartz"] < 0.5 * (v["quartz"] @ v["quartz"]) and cosine(v["sailing"], v["sailings"]) > cosine(v["sailing"], v["quartz"])


@pytest.mark.parametrize("kind", ["linear", "logistic", "forest"])
def test_classifiers_on_held_out_samples(spark, kind):
    rng = random.Random(4)
    table = [(f"{g}{i}", (np.eye(3)[k] + np.random.default_rng(i).normal(size=3) * 0.1).tolist(), 5, 10) for k, g in enumerate("abc") for i in range(6)]
    words = spark.createDataFrame(table, "token string, vector array<double>, df long, docs long")
    samples = spark.createDataFrame([(i, [rng.choice("abc"[i % 3]) + str(rng.randrange(6)) for _ in range(5)], f"label{i % 3}") for i in range(120)] + [(500, ["unknown"], "label0")], "id long, tokens array<string>, label string")
    model, tested = models.train_classifier(samples, words, kind=kind, holdout=0.2)
    assert tested > 0.9
    got = {r["id"]: (r["label"], r["probability"]) for r in models.classify(model, samples, words).collect()}
    assert 500 not in got and all(got[i][0] == f"label{i % 3}" for i in range(0, 30)) and all((p is None) == (kind == "linear") for _, p in got.values())
    with pytest.raises(ValueError):
        models.train_classifier(samples, words, kind="other")


def test_index_checks_and_filters(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "c" if i % 2 else "d") for i in range(9)], "search_rowid long, url string, category string")
    stored = index.fingerprint(pages)
    assert index.verify(pages, stored).first()[0] and index.verify(pages, stored, full=True).first()[0]
    changed = pages.withColumn("url", F.when(F.col("search_rowid") == 4, "other").otherwise(F.col("url")))
    assert index.verify(changed, stored).first()[0] and not index.verify(changed, stored, full=True).first()[0] and not index.verify(pages.limit(8), stored).first()[0]
    ranked = pages.select("search_rowid", F.col("search_rowid").alias("score"))
    assert sorted(r[0] for r in index.filtered(ranked, pages, "category = :c AND search_rowid > :n", "search_rowid", {"c": "c", "n": 3}).collect()) == [5, 7]
    words = index.rank(*(f(spark, SF) for f in (lambda s, d: s.read.parquet(f"{d}/documents.parquet"), search.document_vectors, lambda s, d: s.read.parquet(f"{d}/benchmark.parquet"))), None, search.documents_as_pages(spark, SF), n=3, method="words")
    assert words.columns == ["item_id", "doc_id", "url", "score"] and words.groupBy("item_id").count().where("count > 3").count() == 0
    with pytest.raises(ValueError):
        index.rank(None, None, None, None, None, method="grep")


def test_keyed_tables_with_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "p", 1), (3, "q", 2)], "k long, v string, t int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.upsert(old, new, "k", [F.desc("t")])) == [(1, "y"), (2, "b"), (3, "q")]
    assert rows(tables.insert_or_ignore(old, new, "k", [F.col("t")])) == [(1, "a"), (2, "b"), (3, "p")]
    assert rows(tables.update_from(old, new, "k", [F.col("t")])) == [(1, "x"), (2, "b")]
    assert rows(tables.import_where(new.drop("v"), old, F.col("t") == 1, "k", preserve=True))[:2] == [(1, "a"), (2, "b")]


def test_rules_of_files_and_messages(spark):
    files = spark.createDataFrame([("c/00-imap-spam.py", False), ("l/00-imap-own.py", True), ("c/07-imap-news.py", False), ("c/LEARN-imap-ban.py", False), ("c/readme.md", False)], "path string, local boolean")
    assert sorted(map(tuple, mailrules.registry(files).select("priority", "name").collect())) == [(0, "own"), (7, "news"), (100, "ban")]
    hops = spark.createDataFrame([(["from a.org (a.org [203.0.113.5]) by in.net with X id 1 (envelope-from <e@a.org>) for <m@n>; now", "from localhost (x [127.0.0.1]) by a.org with Y; then"],)], "r array<string>").select(mailrules.hops(F.col("r")).alias("h")).first()["h"]
    assert [(h["from"]["domain"], h["from"]["ip"], h["by"]["domain"], h["envelope_from"]) for h in hops] == [("localhost", [], "a.org", []), ("a.org", ["203.0.113.5"], "in.net", ["e@a.org"])]
    lines = spark.createDataFrame([('(\\HasNoChildren \\Junk) "." "INBOX.Spam"',), ('(\\HasNoChildren) "/" Plain',), ("nonsense",)], "line string")
    assert sorted(map(str, mailrules.folders(lines).collect())) == sorted(map(str, [("INBOX.Spam", ".", "Junk"), ("Plain", "/", None)])) or {tuple(r) for r in mailrules.folders(lines).collect()} == {("INBOX.Spam", ".", "Junk"), ("Plain", "/", None)}
    one = spark.createDataFrame([("12 (UID 77 FLAGS (\\Seen work))", "urgent")], "raw string, body string")
    assert tuple(one.select(mailrules.uid_and_flags(F.col("raw")).alias("u")).first()["u"]) == (77, "\\Seen work")
    mails = spark.createDataFrame([("a", None, "URGENT now", {"references": "<p>"}, "p"), ("p", "g", "auto", {"x-mailer": "folioflow"}, "g"), ("g", None, "first", {}, None)], "message_id string, x string, body string, headers map<string,string>, in_reply_to string")
    mails = mails.withColumns({"sender": F.lit("A <a@b.c>"), "subject": F.lit("s"), "received": F.array().cast("array<string>"), "flags": F.lit(""), "attachments": F.array().cast("array<string>"), "date": F.lit("2024-01-01").cast("timestamp"), "folder": F.lit("INBOX")})
    state = spark.createDataFrame([], "message_id string, rule string, processed long")
    got = mail.run_rules(mailrules.with_context(mails), mailrules.usual_rules(F.lit("2024-01-02").cast("timestamp")), state)
    assert ("a", "urgent") in {(r["message_id"], r["rule"]) for r in got.collect()} and mailrules.newest(mails, 2, "message_id").count() == 2


@pytest.mark.parametrize(("x", "want"), [([1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 7 / 3]), ([], []), ([5.0], [5 / 3])])
def test_moving_average(spark, x, want):
    got = spark.createDataFrame([(x,)], "x array<double>").select(index.moving_average(F.col("x"), 3)).first()[0]
    assert got == pytest.approx(want)


def test_normalised_texts_equal_plain_python(spark):
    import unicodedata

    def fold(t):
        t = unicodedata.normalize("NFKC", t.lower())
        for a, b in X.ASCII:
            t = t.replace(a, b)
        return " ".join("".join(c for c in t if ord(c) < 128).split())

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text", X.normalize_text(F.col("text")).alias("n")).collect()
    assert all(" ".join(r["n"].split()) == fold(r["text"]) for r in rows)


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts += [t[:-2] + "zz" for t in texts[:20]]
    for a in texts:
        for b in texts:
            lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
            ratio = 2 * lcs[-1][-1] / (len(a) + len(b))
            got = dedup.similarity(a, b, 0.8)
            assert got == pytest.approx(ratio) or (got == 0 and ratio <= 0.8)


def test_scored_rows_are_not_joined_with_vectors(spark):
    plan = search.rank_fusion(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")]


def test_the_best_are_ranked_as_among_all(spark):
    rng = random.Random(11)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9)))) for i in range(600)], "doc_id long, text string").repartition(5)
    # Many equal vectors, some missing, some of no number.
    vectors = spark.createDataFrame([(i, [float(i % 7 - 3), float("nan") if i % 50 == 1 else 1.0]) for i in range(600) if i % 9], "doc_id long, vector array<double>")
    queries = spark.createDataFrame([(0, "a b"), (1, "c"), (2, "f e d"), (3, "nothing")], "item_id long, text string")
    directions = spark.createDataFrame([(0, [1.0, 0.5]), (1, [-1.0, 0.2])], "item_id long, vector array<double>")
    first = lambda df: sorted(map(tuple, retrieval.top(df.withColumn("score", F.round("score", 9)), "item_id", [F.desc("score"), F.desc("doc_id")], 4).collect()))
    best = index.fused(docs, vectors, queries, directions, best=4)
    assert first(best) == first(index.fused(docs, vectors, queries, directions)) and best.count() <= 3 * 2 * index.reach(4)


def test_best_cosines_come_from_each_batch(spark):
    docs = spark.createDataFrame([(i, i % 3, [float(i % 5), 1.0] if i % 11 else None) for i in range(400)], "doc_id long, label long, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 1.0])], "item_id long, vector array<double>")
    gate = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "item_id long, label long")
    best = vectors.cosine_rank(docs, "doc_id", queries, "item_id", gate, best=3)
    every = vectors.cosine_rank(docs, "doc_id", queries, "item_id", gate).withColumn("score", F.round("score", 6))
    of = lambda df: sorted(map(tuple, retrieval.top(df, "item_id", [F.desc("score"), F.desc("doc_id")], 3).collect()))
    assert of(best) == of(every) and best.count() <= 3 * 3 < every.count() == 400


def test_numbers_of_tokens_need_no_row_for_each(spark):
    rows = [(0, ["b", "a", "zz", None, "b"]), (1, []), (2, None), (3, ["zz"]), (4, ["é", "a"])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    words = spark.createDataFrame([("a", 7), ("b", 0), ("é", 3)], "token string, id long")
    at_once, joined = ngrams.token_ids(docs, words, "doc_id"), ngrams.token_ids(docs, words, "doc_id", bound=2)
    assert sorted(map(tuple, at_once.collect())) == sorted(map(tuple, joined.collect())) == [(0, [0, 7, 0]), (1, []), (2, []), (3, []), (4, [3, 7])]
    assert "Join" not in at_once._jdf.queryExecution().optimizedPlan().toString()
