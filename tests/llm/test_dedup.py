import random

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import ngramjoin, substrings, textkit
from folioflow.llm.textkit import TOKEN

SCHEMA = "doc_id long, text string, copy string, start string"


def words(rng, n):
    return " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(90)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    shared = [words(rng, n) for n in (60, 110, 55, 230)]
    rows = [(i, f"{words(rng, rng.randrange(1, 90))}. {' '.join(rng.sample(shared, rng.randrange(3)))} {words(rng, 20)}") for i in range(40)]
    rows += [(50, rows[3][1]), (51, rows[3][1]), (None, rows[3][1]), (None, None), (52, ""), (53, "short"), (3, rows[3][1]), (54, "la la la " * 80), (54, words(rng, 70))]
    return [(k, t, "x", "y") for k, t in rows]


def naive_repeats(rows, least=2 * substrings.SEED):
    """Copies and first occurrences of windows by brute force: (key, copy) -> covered places."""
    docs = sorted({(k is None, k, t) for k, t, *_ in rows if t}, key=str)
    texts = {d: TOKEN.findall(d[2].lower()) for d in docs}
    seen = {}
    # Texts of one key are in an order of their own; here their windows repeat in no other document.
    for d in sorted(docs, key=lambda d: (d[0], d[1] or 0)):
        for i in range(len(texts[d]) - least + 1):
            seen.setdefault(tuple(texts[d][i : i + least]), []).append((d, i))
    covered = {}
    for at in seen.values():
        if len(at) > 1:
            for n, (d, i) in enumerate(at):
                covered.setdefault((d[1], n > 0), set()).update(range(i, i + least))
    return covered


def test_repeats_equal_brute_force(spark, corpus):
    rows, got = corpus, {}
    for r in substrings.repeats(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r["doc_id"], r["copy"]), set()).update(range(r["start"], r["stop"]))
        # A first occurrence may run on into what is itself a copy; a copy holds copies only.
        assert r["longest"] in (50, 100, 200) and (not r["copy"] or r["stop"] - r["start"] >= r["longest"])
    assert got == naive_repeats(rows)


def test_longest_follows_doubling(spark):
    rng = random.Random(9)
    long = words(rng, 210)
    got = substrings.repeats(spark.createDataFrame([(1, long + " a"), (2, "b " + long)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["copy"], r["start"], r["stop"], r["longest"]) for r in got) == [(1, False, 0, 210, 200), (2, True, 1, 211, 200)]


def test_cut_leaves_one_of_each_window_and_clean_rows(spark, corpus):
    df = spark.createDataFrame(corpus, SCHEMA)
    out = substrings.cut_copies(df)
    assert out.columns == df.columns
    kept = out.collect()
    assert sum(r["text"] is None for r in kept) == 1 and sum(r["text"] == "" for r in kept) == 1
    windows = {}
    for r in kept:
        if r["doc_id"] == 54 or not r["text"]:
            continue
        t = TOKEN.findall(r["text"].lower())
        for i in range(len(t) - 49):
            windows.setdefault(tuple(t[i : i + 50]), set()).add((r["doc_id"], r["text"]))
    assert all(len(v) == 1 for v in windows.values())
    clean = {k for k, *_ in corpus if k is not None} - {k for k, copy in naive_repeats(corpus) if copy}
    texts = {r["doc_id"]: r["text"] for r in kept}
    assert all(texts[k] == next(t for i, t, *_ in corpus if i == k) for k in clean - {54})


def test_repeats_of_other_keys_and_of_nothing(spark, corpus):
    df = spark.createDataFrame([(None if k is None else f"k{k}", t) for k, t, *_ in corpus], "doc_id string, text string")
    assert {r["doc_id"] for r in substrings.repeats(df).collect()} >= {"k3", "k50", None}
    assert substrings.repeats(df.limit(0)).count() == 0 and substrings.cut_copies(df.limit(0)).count() == 0


def test_offsets_survive_letters_that_grow():
    text = "İstanbul one two three"
    assert substrings.without(text, [(len(TOKEN.findall("İ".lower() + "stanbul")), len(TOKEN.findall(text.lower())))]).strip().lower().startswith("i")


def grams(text):
    t = TOKEN.findall(text.lower())
    return frozenset(tuple(t[i : i + 3]) for i in range(max(len(t) - 2, 1))) if t else frozenset()


def naive_classes(rows, similarity=ngramjoin.SIMILARITY):
    """(key, text) -> least key of its class and number of links, by comparing all documents."""
    docs = sorted({(k, t) for k, t, *_ in rows if t and grams(t)}, key=str)
    sets = [grams(t) for _, t in docs]
    links = [[j for j in range(len(docs)) if j != i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity - 1e-12] for i in range(len(docs))]
    out = []
    for i, (k, _) in enumerate(docs):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        if links[i]:
            out.append((k, min((docs[j][0] for j in seen if docs[j][0] is not None), default=None), len(links[i])))
    return sorted(out, key=str)


def found_classes(df, **how):
    return sorted(((r["doc_id"], r["class_id"], r["links"]) for r in ngramjoin.similar(df, **how).collect()), key=str)


def near_copies(seed, n=120, bases=12):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(3, 60)).split() for _ in range(bases)]
    rows = []
    for i in range(n):
        t = list(base[i % bases])
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = f"new{rng.randrange(50)}"
        rows.append((i, " ".join(t), "x", "y"))
    return rows


def test_classes_and_links_equal_brute_force(spark):
    rows = near_copies(2)
    rows += [(200, None, "x", "y"), (201, "", "x", "y"), (202, "!!", "x", "y"), (203, "one", "x", "y"), (204, "one", "x", "y"), (0, rows[0][1], "x", "y"), (0, rows[1][1], "x", "y"), (None, rows[2][1], "x", "y"), (None, "two three four", "x", "y"), (None, "two, three four!", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found_classes(df) == naive_classes(rows)
    assert found_classes(df.limit(0)) == []
    assert found_classes(spark.createDataFrame([(i, words(random.Random(i), 30), "x", "y") for i in range(40)], SCHEMA)) == []


@pytest.mark.parametrize("limits", [{"UNIT_GRAMS": 60, "BLOCK": 2, "_HELD": 50}, {"ALIKE": 99, "BLOCK": 3}, {"ALIKE": 0, "FREQUENT": 0}], ids=str)
def test_clusters_units_and_blocks_change_nothing(spark, monkeypatch, limits):
    rows = near_copies(5, 90, 3)
    for name, value in limits.items():
        monkeypatch.setattr(ngramjoin, name, value)
    assert found_classes(spark.createDataFrame(rows, SCHEMA)) == naive_classes(rows)


def test_links_below_the_shared_part_are_found(spark):
    common = [f"c{i}" for i in range(12)]
    rows = [(k, " ".join([f"{k}w{i}" for i in range(45)] + common + [f"{k}v{i}" for i in range(45)]), "x", "y") for k in range(4)]
    assert all(len(grams(t)) == 100 for _, t, *_ in rows)
    assert found_classes(spark.createDataFrame(rows, SCHEMA), similarity=0.05) == [(k, 0, 3) for k in range(4)]


def test_overlaps_derived_from_the_set_before_equal_counted_ones(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 60, 80).astype(np.uint64)
    blobs = [np.unique(np.concatenate([rng.choice(base, 60, replace=False), rng.integers(1, 1 << 60, 9).astype(np.uint64)])) for _ in range(30)]
    table = pa.table({"hash": range(30), "w": [1] * 30, "grams": [b.tobytes() for b in blobs]})
    left, right = ngramjoin.Sets(pa.concat_tables([table, table.slice(3, 4)])), ngramjoin.Sets(table.slice(0, 11))
    assert sorted(left.name) == list(range(30))
    for held in (1, 1_000_000):
        monkeypatch.setattr(ngramjoin, "_HELD", held)
        for a, b in ((left, right), (left, left)):
            for i, row in ngramjoin.overlaps(a, b):
                assert [int(x) for j, x in enumerate(row) if a is not b or i != j] == [len(np.intersect1d(blobs[a.name[i]], blobs[b.name[j]])) for j in range(len(b.name)) if a is not b or i != j]


def test_frequent_trigrams_rank_by_their_whole_hashes():
    whole = np.array([0x1234_5678_9ABC_DEF0, 0x7, 0xFFFF_FFFF_FFFF_FFFF, 0x1234_5678_9ABD_0000], np.uint64)
    known, owners = ngramjoin._unpack(ngramjoin._pack(np.sort(whole[:3]), np.arange(3, dtype=np.uint16)), np.uint16)
    assert owners.tolist() == [0, 1, 2]
    assert ngramjoin._ranks(whole, known, np.array([5, 6, 9])).tolist() == [6, 5, 9, 0]
    assert ngramjoin._ranks(whole, known[:0], np.zeros(0, np.int64)).tolist() == [0] * 4


def test_sieve_lets_all_its_ids_through(spark, monkeypatch):
    ids, others = spark.range(5_000).selectExpr("id * 977 - 99999 AS rid"), spark.range(5_000).selectExpr("'x' AS a", "id * 977 - 99998 AS rid")
    full = textkit.Sieve(ids)
    assert full.let(ids, "rid").count() == 5_000 and full.let(ids, "rid", held=False).count() == 0
    assert full.let(others, "rid").count() < 500 and full.let(others, "rid").count() + full.let(others, "rid", held=False).count() == 5_000
    monkeypatch.setattr(textkit, "SIEVE_BITS", 1024)
    assert textkit.Sieve(ids).let(ids, "rid").count() == 5_000 and textkit.Sieve(ids.limit(0)).let(ids, "rid").count() == 0


def test_keep_one_keeps_the_first_of_each_group(spark):
    rng = random.Random(3)
    a, b = words(rng, 40), words(rng, 40)
    rows = [(5, a, "x", "y"), (2, a + " tail", "x", "y"), (9, b, "x", "y"), (None, a, "x", "y"), (7, None, "x", "y"), (8, "", "x", "y"), (9, b, "x", "y")]
    got = ngramjoin.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "copy", "start"]
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 7, 8, 9]
    assert ngramjoin.keep_one(got.limit(0)).count() == 0
