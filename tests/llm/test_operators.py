import math
import random
import textwrap
import time

import duckdb
import numpy as np
import pytest

from folioflow.llm import decontaminate, fingerprints, html, language, licenses, quality, registry, sharding

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, score double"
EDGES = [(None, None, None, "s", 1.0), (1, None, "en", "s", 1.0), (2, "", "en", "s", 1.0), (3, "?!", "en", "s", 1.0), (4, "the word " * 30_000, "en", "s", 1.0), (4, "the word " * 30_000, "en", "s", 1.0), (None, "some text here", "fr", "s", 1.0)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    got = registry.queries()[name](spark, SF)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got.collect())


@pytest.mark.parametrize(
    "apply",
    [
        lambda d: fingerprints.fingerprint(d),
        lambda d: licenses.scan_licenses(d),
        lambda d: sharding.assign_shards(d, "doc_id", sharding.SHARDS),
        lambda d: language.identify(d, language.train(d)),
        lambda d: html.extract(d, "doc_id", "text"),
        lambda d: quality.score(d, None),
    ],
    ids=["fingerprints", "licenses", "sharding", "language", "html", "quality"],
)
def test_row_wise_operators_answer_every_row(edges, apply):
    out = apply(edges)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r[0]) for r in EDGES)
    assert apply(edges.limit(0)).count() == 0


def test_sketches_merge_and_estimate_containment(spark):
    rng = random.Random(1)
    tokens = [f"t{rng.randrange(10_000)}" for _ in range(20_000)]
    rows = [(1, " ".join(tokens)), (2, " ".join(tokens[:4_000])), (3, " ".join(f"u{i}" for i in range(4_000)))]
    got = {r["doc_id"]: set(r["sketch"]) for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got[2] & got[1]) / len(got[2]) > 0.9 and not got[3] & got[1]
    one = fingerprints.merge(fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("1 AS g", "sketch"), "g").first()
    assert set(one["sketch"]) == got[1] | got[2] | got[3]


def test_adding_a_shard_moves_only_what_it_wins(spark):
    keys = spark.range(5_000).withColumnRenamed("id", "doc_id")
    got = sharding.moved(keys, "doc_id", sharding.SHARDS, {**sharding.SHARDS, "new": 1.0}).where("before <> after").collect()
    assert {r["after"] for r in got} == {"new"} and 0.02 < len(got) / 5_000 < 0.09
    with pytest.raises(ValueError):
        sharding.assign_shards(keys, "doc_id", {})


def test_licenses_of_whole_sequences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. The software is provided as is, without warranty of any kind."
    rows = [(1, mit), (2, "Intro. All rights reserved. Licensed under the MIT License."), (3, "plain"), (4, "You may not use this file except in compliance with the license.")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT Proprietary", 3: "NONE", 4: "UNKNOWN"}


NOTICES = {
    "MIT": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}
NOTICES["BSD-3-Clause"] = ["All rights reserved.", *NOTICES["BSD-2-Clause"][:3], "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", NOTICES["BSD-2-Clause"][3]]
for family, name, subject, version, a, b in (("GPL-3.0", "", "program", "3", ":", ","), ("GPL-2.0", "", "program", "2", ";", ";"), ("LGPL-3.0", "Lesser ", "program", "3", ":", ","), ("LGPL-2.1", "Lesser ", "library", "2.1", ";", ";"), ("AGPL-3.0", "Affero ", "program", "3", ":", ",")):
    NOTICES[f"{family}-or-later"] = [f"This {subject} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation{b} either version {version} of the License, or (at your option) any later version.", f"This {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {name}General Public License for more details.", f"You should have received a copy of the GNU {name}General Public License along with this {subject}{'.  If not, see <https://www.gnu.org/licenses/>.' if version == '3' else '; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA'}"]


def test_licenses_of_published_notices_wrapped_or_not(spark):
    heading, code = "Copyright (c) 2020 A. Person\n", "\n\nint main() { return 0; }"
    rows = []
    for name, paragraphs in NOTICES.items():
        wrapped = "\n\n".join(textwrap.fill(p, 66) for p in paragraphs)
        texts = ["\n\n".join(paragraphs), " ".join(paragraphs), "\n".join(paragraphs), wrapped, textwrap.indent(wrapped, "   "), wrapped.replace("\n", "\r\n"), textwrap.indent(wrapped, " * ", lambda _: True)]
        rows += [(f"{name} {i}", heading + t + code if i != 6 else f"/*\n{t}\n */{code}") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {k: k.split()[0] for k, _ in rows}


def test_license_words_across_a_break_or_within_a_line_are_no_sentence(spark):
    rows = [(1, "Not released under the MIT License."), (2, "Released under\n\nthe MIT License."), (3, "Released under. The MIT License"), (4, "A heading\nReleased under the\nMIT License\nmore words")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "NONE", 2: "NONE", 3: "NONE", 4: "MIT"}


def test_main_text_leaves_navigation_out():
    links = "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(30))
    body = "".join(f"<p>{'A sentence of the article that says much. ' * 8}</p>" for _ in range(5))
    text = html.main_text(f"<html><body><ul>{links}</ul><div><article>{body}</article></div><script>var a='</p>'</script></body></html>")
    assert text.count("article that says") == 40 and "Link number" not in text and "var a" not in text
    assert html.main_text(None) is None and html.main_text("") == "" and html.main_text("<p>unclosed <b>tags") == "unclosed tags"
    assert html.main_text("just words") == "just words" and html.main_text("<body><h1>A head</h1><p>A text without a link.</p></body>") == "A head\nA text without a link."


def naive_text(source):
    """Main text by the definition itself, every subtree walked anew."""
    page = html.Page(source)
    n = len(page.tag)
    kids = [[k for k in range(n) if page.parent[k] == i] for i in range(n)]
    tree = lambda i: [i, *(x for k in kids[i] for x in tree(k))]
    up = lambda i: [] if i < 0 else [i, *up(page.parent[i])]
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    gone = {i for i in range(n) if any(page.tag[k] in html._SKIPPED for k in up(i))}
    linked = {i for i in range(n) if any(page.tag[k] == "a" for k in up(i))}

    def counts(i):
        own = set(tree(i)) - (gone if i not in gone else set())
        texts = [(k, t) for _, k, t in page.texts if k in own and k not in gone]
        return sum(len(t) for _, t in texts), len(own), sum(len(t) for k, t in texts if k in linked), len(own & linked)

    c, _, lc, _ = counts(body)
    ratio = lc / (c or 1)

    def density(c, t, lc, lt):
        base = math.log(c / ((c - lc) or 1) * lc + ratio * c + math.e)
        return c / t * (math.log(c / (lc or 1) * (t / (lt or 1))) / (math.log(base) or 1)) if c else 0.0

    dense = [0.0 if i in gone else density(*counts(i)) for i in range(n)]
    total = [sum(dense[k] for k in kids[i]) for i in range(n)]
    best = lambda i: max(tree(i), key=lambda k: (total[k], -k))
    top = best(body)
    least = min(dense[k] for k in up(top) if body in up(k))
    marked, todo = set(), [body]
    direct = set()
    while todo:
        i = todo.pop()
        if i in marked or not dense[i] or dense[i] < least:
            continue
        own = sum(len(t) for _, k, t in page.texts if k == i and k not in gone)
        marked |= set(tree(best(i)))
        if (density(own, 1, own * (i in linked), int(i in linked)) if own else 0.0) >= least:
            direct.add(i)
        todo += kids[i]
    return [t for _, k, t in page.texts if k not in gone and (k in marked or k in direct)]


@pytest.mark.parametrize("links", [True, False])
def test_main_text_equals_the_definition_on_random_trees(links):
    rng = random.Random(11 + links)

    def element(depth):
        tag = rng.choice(["div", "section", "p", "ul", "b"] + ["a"] * links)
        inner = "".join(element(depth - 1) for _ in range(rng.randrange(4))) if depth else ""
        return f"<{tag}>{' '.join(['word'] * rng.randrange(12))}{inner}</{tag}>"

    for _ in range(60):
        source = f"<body>{''.join(element(4) for _ in range(rng.randrange(1, 5)))}</body>"
        assert html.main_text(source).split() == " ".join(naive_text(source)).split()


def test_deep_and_broken_pages_take_no_longer_than_others():
    began = time.process_time()
    assert html.main_text("<body>" + "<div>" * 20_000 + "deep text" + "</div>" * 20_000) == "deep text"
    assert html.main_text("<body>" + "<div>" * 5_000 + "<p>a</p><b>x</i>" * 5_000).startswith("a\nx")
    assert time.process_time() - began < 20


@pytest.mark.parametrize(
    "start",
    [
        "<html><head><title>T</title></head><body>",
        "<html><head><title>T</title><body>",
        "<html><head><title>T</title>",
        "<html><head><title>The <b> tag</title><meta charset=utf-8><style>p{}</style>",
        "<head><title>T</title><body>",
        "<html><title>T</title><body>",
        "<title>T</title><body>",
        "<title>T</title>",
        "<html><head><body>",
        "<head><title>T</title><p>First words.</p><body class=x>",
        "<!doctype html><html><head><title>T</title>First words.</head><body>",
        "",
    ],
)
def test_main_text_with_optional_tags_left_out(start):
    links = "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(30))
    body = "".join(f"<p>{'A sentence of the article that says much. ' * 8}</p>" for _ in range(5))
    text = html.main_text(f"{start}<ul>{links}</ul><div><article>{body}</article></div>")
    assert text.count("article that says") == 40 and "Link number" not in text and "T\n" not in text and "The " not in text
    plain = html.main_text(f"{start}<p>Plain words that say more than the first.</p>")
    assert "Plain words" in plain and ("First words." in plain) == ("First words." in start) and "T\n" not in plain


def test_dense_blocks_beside_the_largest_come_in():
    say = lambda w: f"{w} sentence with many words of its own. " * 9
    parts = "".join(f"<p>{say('Inner')}</p>" for _ in range(3))
    links = "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(30))
    for lone in (f"<p>{say('Lone')}</p>", f"<pre>{say('Lone')}</pre>", f"<table><td>{say('Lone')}</table>", say("Lone")):
        text = html.main_text(f"<body><ul>{links}</ul>{lone}<div>{parts}</div></body>")
        assert text.count("Lone sentence") == 9 and text.count("Inner sentence") == 27 and "Link number" not in text


def naive_hits(index, tokens, threshold):
    """Scores of all units for each passage of two unit lengths, without any index."""
    found = {}
    for start in range(0, max(len(tokens), 1), decontaminate.UNIT):
        have = {index.terms[w] for w in tokens[start : start + 2 * decontaminate.UNIT] if w in index.terms}
        for u in range(len(index.owner)):
            score = sum(x for t in have for d, x in zip(index.docs[t], index.impacts[t], strict=True) if d == u)
            if score >= threshold - 1e-9:
                found[start, u] = round(score, 9)
    return found


def test_block_max_search_equals_brute_force():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 150)))) for i in range(40)]
    index = decontaminate.Index(items)
    for threshold in (0.3, 0.6):
        for _ in range(30):
            tokens = [rng.choice(vocabulary) for _ in range(rng.randrange(300))]
            got = {}
            for start in range(0, max(len(tokens), 1), decontaminate.UNIT):
                terms = sorted({index.terms[w] for w in tokens[start : start + 2 * decontaminate.UNIT] if w in index.terms})
                got.update({(start, u): round(s, 9) for u, s in index.search(terms, threshold)})
            assert got == naive_hits(index, tokens, threshold)


def test_shards_of_a_benchmark_score_as_the_whole(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary[: 10 + i]) for _ in range(rng.randrange(5, 150)))) for i in range(40)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(20)] + [t[: len(t) * 2 // 3] for _, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def hits(shard_chars):
        found = list(decontaminate.indexes(bench, shard_chars=shard_chars))
        return len(found), {(n, x.items[i], *(round(v, 6) for v in values)) for x in found for n, row in enumerate(x.hits(texts, 0.4, 0, 0)) for i, *values in row}

    (one, want), (many, got) = hits(10**9), hits(3_000)
    assert one == 1 and many > 3 and want and got == want


def test_planted_items_are_found_and_clean_texts_stay(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(f"x{rng.randrange(4_000)}" for _ in range(n))
    items = [(i, f"{say(20)}? {say(15)}.") for i in range(30)]
    docs = [(i, f"{say(200)} {items[i][1] if i < 10 else ''} {say(300)}", "en", "s", 1.0) for i in range(40)] + EDGES
    docs, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame([*items, (None, None), (99, ""), items[0]], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {(i, i) for i in range(10)}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 10 - 0
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0 and decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count() and decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0


def test_hits_equal_brute_force_whatever_the_grid(monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(150)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 90)))) for i in range(30)]
    index = decontaminate.Index(items)
    texts = [None, "", *(" ".join([*(rng.choice(vocabulary) for _ in range(rng.randrange(200))), items[i][1], *(rng.choice(vocabulary) for _ in range(rng.randrange(200)))]) for i in range(30))]

    def naive(text):
        tokens, out = decontaminate.TOKEN.findall(text.lower()) if text else [], {}
        for (start, unit), score in naive_hits(index, tokens, 0.5).items():
            item = index.owner[unit]
            near = tokens[max(start - index.sizes[item], 0) : start + 2 * decontaminate.UNIT + index.sizes[item]]
            out.setdefault(item, []).append((score, index.overlap(item, near)))
        return {i for i, found in out.items() if any(q >= 0.6 and a >= 0.5 for _, (q, a) in found)}

    want = [naive(t) for t in texts]
    assert sum(map(len, want)) >= 30
    for cells in (decontaminate.CELLS, 10):
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        assert [{i for i, *_ in hits} for hits in index.hits(texts, 0.5, 0.6, 0.5)] == want


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    held = quality.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    right = sum((r["quality_score"] >= 0.5) == bool(r["quality"]) for r in held) / len(held)
    harmless = sum((r["toxicity_score"] >= 0.5) == bool(r["toxic"]) for r in held) / len(held)
    assert right > 0.9 and harmless > 0.9


def test_votes_equal_brute_force_and_own_labels_have_none(spark):
    rng = random.Random(4)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, say(good if i % 2 else bad, 30)) for i in range(60)]
    # 900 is labelled; 901 has its text, 902 its words twice.
    rows += [(900, "g1 g2 g3 b1"), (901, "g1 g2 g3 b1"), (901, "g1 g2 g3 b1"), (902, "g1 g2 g3 b1 g1 g2 g3 b1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(900, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    space = model.spaces[0]
    texts = {k: t for k, t in rows}
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    for k, t in texts.items():
        x = np.zeros(len(space.weights))
        for w in quality.terms_of(t) & space.index.keys():
            x[space.index[w]] = space.weights[space.index[w]]
        x[-1] = space.weights[-1]
        v = x @ space.basis.astype(float)
        mine = {i for i, (_, keys) in enumerate(sorted([(quality.text_hash(texts[j]), [str(j)]) for j in [*range(60), 900]], key=lambda z: z[1])) if texts[int(keys[0])] == t or keys[0] == str(k)}
        near = sorted(((round(float(v @ p / np.linalg.norm(v)) * 1e6), -i) for i, p in enumerate(space.points) if i not in mine), reverse=True)[: quality.NEIGHBOURS]
        weight = np.array([max(c / 1e6, 0) ** quality.POWER for c, _ in near])
        assert abs((weight * [space.labels[-i] for _, i in near]).sum() / weight.sum() - got[k]) < 1e-3
    assert got[900] == got[901] and len([r for r in quality.score(docs, model).collect() if r["doc_id"] == 901]) == 2


def test_without_another_labelled_document_scores_are_null(spark):
    docs = spark.createDataFrame([(1, "one good text"), (2, "one good text"), (3, None), (4, "")], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.score(docs, model).collect()}
    assert got == {1: (None, None, True), 2: (None, None, True), 3: (None, None, False), 4: (None, None, False)}


def test_spaces_of_many_terms_equal_those_of_few():
    rng = np.random.default_rng(2)
    x = rng.random((30, 90)).astype(np.float32)
    wide, low = quality.Space._right_vectors(x), quality.Space._right_vectors(np.vstack([x, np.zeros((80, 90), np.float32)]))
    assert np.allclose(np.abs((wide.T @ low)).sum(axis=0), 1, atol=1e-2)


def test_containment_of_a_part_in_the_whole(spark):
    tokens = [f"t{i}" for i in range(6_000)]
    prints = fingerprints.fingerprint(spark.createDataFrame([(1, " ".join(tokens)), (2, " ".join(tokens[:3_000])), (3, None)], "doc_id long, text string"))
    both = prints.selectExpr("doc_id AS a", "sketch AS small").crossJoin(prints.selectExpr("doc_id AS b", "sketch AS large"))
    got = {(r["a"], r["b"]): r["c"] for r in both.select("a", "b", fingerprints.containment(both["small"], both["large"]).alias("c")).collect()}
    assert got[2, 1] == got[1, 1] == 1 and 0.3 < got[1, 2] < 0.7 and got[3, 1] is None


def test_languages_of_other_scripts_within_bounds(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(40)) for _ in range(60)] + [None, "", "abc abd", "abc abd"]
    profiles = {"aa": np.unique(rng.choices([int(c) for c in language._grams(["abc", "abd"])[0]], k=20)).astype(np.uint64)}
    want = language.distances(texts, profiles, 50)
    monkeypatch.setattr(language, "CELLS", 500)
    assert (language.distances(texts, profiles, 50) == want).all() and (want[60:62] == -1).all() and (want[:60] > 0).all()


def test_classifier_without_labels_keeps_texts(spark, edges):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(edges, labels)
    assert model is None and quality.keep_good(edges, model).columns == edges.columns
    assert sorted(str(r["doc_id"]) for r in quality.keep_good(edges, model).collect()) == ["3", "4", "4", "None"]
