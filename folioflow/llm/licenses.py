"""License scans by sentence rules.

A text is cut into sentences at ``BREAK`` punctuation and empty lines, each
sentence is normalised, and a sentence that is in the table of known licence
sentences becomes its identifier. A line end within a sentence may be a wrap
or an end: any run of whole lines of a sentence can be a known one, so notices
are found wrapped or not, behind comment marks, and below headings. The
sequence of identifiers of a text is then matched against ordered rules; a
rule consumes what it matches, so a later rule can't claim it again.
Everything is one projection: no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentence -> identifier. A sentence holds one of ``ANCHORS``.
SENTENCES = {
    "all rights reserved": "AllRights",
    "released under the mit license": "MITref",
    "licensed under the mit license": "MITref",
    "distributed under the mit license": "MITref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MITperm",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is without warranty of any kind": "AsIs",
    "licensed under the apache license version 2 0": "Apache2ref",
    "licensed under the apache license version 2 0 the license": "Apache2ref",
    "you may not use this file except in compliance with the license": "Apache2use",
    "you may obtain a copy of the license at": "Apache2copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "Apache2basis",
    "see the license for the specific language governing permissions and limitations under the license": "Apache2see",
    "this work is licensed under the gnu general public license version 3": "GPL3ref",
    "this work is licensed under the gnu general public license version 2": "GPL2ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPLany",
    "either version 3 of the license or at your option any later version": "V3plus",
    "either version 2 of the license or at your option any later version": "V2plus",
    "this program is distributed in the hope that it will be useful but without any warranty": "GPLhope",
    "you should have received a copy of the gnu general public license along with this program": "GPLreceived",
    "licensed under the gnu lesser general public license version 3": "LGPL3ref",
    "licensed under the gnu affero general public license version 3": "AGPL3ref",
    "licensed under the mozilla public license version 2 0": "MPL2ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDcond",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice": "BSDbinary",
    "licensed under the bsd license": "BSDref",
    "licensed under the isc license": "ISCref",
    "licensed under cc by 4 0": "CCBYref",
    "licensed under cc by sa 4 0": "CCBYSAref",
    "licensed under cc by nc 4 0": "CCBYNCref",
    "licensed under cc by nd 4 0": "CCBYNDref",
    "licensed under cc0 1 0": "CC0ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "CCBYref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CCBYSAref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CCBYNCref",
}


def _prefixes(name: str, seq: list[str], least: int) -> list[tuple[str, list[str]]]:
    """Rules for a sequence and its beginnings, the longest first."""
    return [(name, seq[:n]) for n in range(len(seq), least - 1, -1)]


def _gnu() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Sentences and rules of the GNU notices, of which ``:``, ``;`` or ``,`` part the clauses."""
    sentences, rules = {}, []
    for family, word, versions in (("AGPL", "gnu affero general", ("3",)), ("LGPL", "gnu lesser general", ("3", "2 1")), ("GPL", "gnu general", ("3", "2"))):
        terms = f"you can redistribute it and or modify it under the terms of the {word} public license as published by the free software foundation"
        for start in ("", *(f"this {x} is free software " for x in ("program", "library", "software"))):
            sentences[start + terms] = f"{family}any"
            for v in versions:
                sentences[f"{start}{terms} either version {v} of the license or at your option any later version"] = f"{family}{v.replace(' ', '')}plus"
        for x in ("program", "library", "software"):
            sentences[f"this {x} is distributed in the hope that it will be useful but without any warranty"] = "GPLhope"
            sentences[f"you should have received a copy of the {word} public license along with this {x}"] = f"{family}received"
        for v in versions:
            sentences[f"either version {v} of the license or at your option any later version"] = f"V{v.replace(' ', '')}plus"
            name, short, rest = f"{family}-{v.replace(' ', '.') if ' ' in v else v + '.0'}-or-later", v.replace(" ", ""), ["GPLhope", f"{family}received"]
            rules += _prefixes(name, [f"{family}any", f"V{short}plus", *rest], 2) + _prefixes(name, [f"{family}{short}plus", *rest], 1)
    return sentences, rules


_GNU, _GNU_RULES = _gnu()
_BASIS = "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
#: More sentences, as the published licences have them; ``|`` stands for a break within. The SQL has the short table above only.
PUBLISHED = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITperm",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AsIs",
    **{f"you may obtain a copy of the license at {x} www apache org licenses license 2 0": "Apache2copy" for x in ("http", "https")},
    **{f"you may obtain a copy of the license at {x} www apache org licenses license 2 0 {_BASIS}": "Apache2terms" for x in ("http", "https")},
    _BASIS: "Apache2basis",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    **{f"neither the name of {x} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDname" for x in ("the copyright holder", "the copyright owner", "the organization", "the author", "the")},
    **{f"this software is provided by the {x} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDasis" for x in ("copyright holders and contributors", "copyright holder and contributors", "author and contributors", "author")},
    "this source code form is subject to the terms of the mozilla public license v | 2 0": "MPL2ref",
    **{f"if a copy of the mpl was not distributed with this file you can obtain one at {x} mozilla org mpl 2 0": "MPL2copy" for x in ("http", "https", "http www", "https www")},
    **_GNU,
}
_BSD = ["BSDcond", "BSDsource", "BSDbinary"]
#: Rules for published texts, before those of ``RULES``.
PUBLISHED_RULES = [
    *_prefixes("BSD-3-Clause", ["AllRights", *_BSD, "BSDname", "BSDasis"], 5),
    *_prefixes("BSD-3-Clause", [*_BSD, "BSDname", "BSDasis"], 4),
    *_prefixes("BSD-2-Clause", ["AllRights", *_BSD, "BSDasis"], 5),
    *_prefixes("BSD-2-Clause", [*_BSD, "BSDasis"], 4),
    ("Apache-2.0", ["Apache2ref", "Apache2use", "Apache2terms", "Apache2see"]),
    ("MPL-2.0", ["MPL2ref", "MPL2copy"]),
    *_GNU_RULES,
]
ANCHORS = ("licen", "rights reserved", "permission", "copyright", "warranty", "redistribut", "version")
#: Ordered rules: licence, identifiers that must follow each other.
RULES = [
    ("MIT", ["MITperm", "MITnotice", "AsIs"]),
    ("MIT", ["MITperm", "MITnotice"]),
    ("Apache-2.0", ["Apache2ref", "Apache2use", "Apache2copy", "Apache2basis", "Apache2see"]),
    ("Apache-2.0", ["Apache2ref", "Apache2use", "Apache2copy"]),
    ("GPL-3.0-or-later", ["GPLany", "V3plus", "GPLhope", "GPLreceived"]),
    ("GPL-2.0-or-later", ["GPLany", "V2plus", "GPLhope", "GPLreceived"]),
    ("GPL-3.0-or-later", ["GPLany", "V3plus"]),
    ("GPL-2.0-or-later", ["GPLany", "V2plus"]),
    ("BSD-3-Clause", ["BSDcond", "BSDsource", "BSDbinary", "AsIs"]),
    ("BSD-2-Clause", ["BSDcond", "BSDsource", "BSDbinary"]),
    ("AGPL-3.0", ["AGPL3ref"]),
    ("LGPL-3.0", ["LGPL3ref"]),
    ("GPL-3.0", ["GPL3ref"]),
    ("GPL-2.0", ["GPL2ref"]),
    ("Apache-2.0", ["Apache2ref"]),
    ("MPL-2.0", ["MPL2ref"]),
    ("MIT", ["MITref"]),
    ("BSD", ["BSDref"]),
    ("ISC", ["ISCref"]),
    ("CC-BY-SA-4.0", ["CCBYSAref"]),
    ("CC-BY-NC-4.0", ["CCBYNCref"]),
    ("CC-BY-ND-4.0", ["CCBYNDref"]),
    ("CC-BY-4.0", ["CCBYref"]),
    ("CC0-1.0", ["CC0ref"]),
    ("Proprietary", ["AllRights"]),
]
#: A break is a full stop, ``!``, ``?``, ``;`` or ``:`` before white space or the end; an empty line is one too.
BREAK = r"[.!?;:]+(?:\s+|$)"
_KNOWN = SENTENCES | PUBLISHED
#: Whole lines that are a known sentence, the longest first; a line end may take a blank's place.
_LINES = "(?m)^(?:" + "|".join(s.replace(" | ", "\n\n").replace(" ", "[ \n]") for s in sorted(_KNOWN, key=len, reverse=True)) + ")$"
_ANCHORED = "(?i)" + "|".join(ANCHORS)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in sorted(_KNOWN.items()) for x in pair])
    # Two line ends part sentences, one the lines of a sentence, a blank the words.
    words = F.regexp_replace(F.regexp_replace(F.lower(text), BREAK, "\n\n"), r"[^\p{L}\p{N}\n]+", " ")
    lines = F.trim(F.regexp_replace(F.regexp_replace(words, " ?\n ?", "\n"), "\n{3,}", "\n\n"))
    found = F.regexp_extract_all(lines, F.lit(_LINES), F.lit(0))
    found = F.transform(found, lambda s: F.try_element_at(known, F.replace(F.replace(s, F.lit("\n\n"), F.lit(" | ")), F.lit("\n"), F.lit(" "))))
    return F.when(text.rlike(_ANCHORED), found).otherwise(F.array().cast("array<string>"))


def licenses_of(ids: Column) -> Column:
    """The licences that the ordered rules find in identifiers, sorted.

    Identifiers left over by all rules give ``UNKNOWN``; no identifiers give
    ``NONE``. Each identifier is written as ``<id>``; a match is struck out.
    """
    rest = F.concat(F.lit(""), F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    state = F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("hits"))
    rules = F.array(*[F.struct(F.lit("".join(f"<{x}>" for x in seq)).alias("seq"), F.lit(name).alias("name")) for name, seq in PUBLISHED_RULES + RULES])
    step = lambda s, r: F.struct(
        F.replace(s["rest"], r["seq"], F.lit("|")).alias("rest"),
        F.when(F.contains(s["rest"], r["seq"]), F.array_append(s["hits"], r["name"])).otherwise(s["hits"]).alias("hits"),
    )
    done = F.aggregate(rules, state, step)
    left = F.contains(done["rest"], F.lit("<"))
    hits = F.array_distinct(F.when(left, F.array_append(done["hits"], F.lit("UNKNOWN"))).otherwise(done["hits"]))
    return F.when(F.size(ids) == 0, F.array(F.lit("NONE"))).otherwise(F.sort_array(hits))


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, ``sentences`` and ``licenses``, each joined by blanks.

    A null or empty text has no sentences and the licence ``NONE``. Repeated
    rows are answered each on its own, whole texts are read however long, an
    empty table gives an empty result, and other columns are not read.
    """
    ids = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text")).select(F.col(key), sentence_ids(F.col("__text")).alias("__ids"))
    return ids.select(F.col(key), F.array_join("__ids", " ").alias("sentences"), F.array_join(licenses_of(F.col("__ids")), " ").alias("licenses"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    steps, prev = [], "joined"
    for n, (name, seq) in enumerate(RULES):
        pat = "".join(f"<{x}>" for x in seq)
        steps.append(f"r{n} AS (SELECT doc_id, n, sentences, replace(rest, '{pat}', '|') AS rest, CASE WHEN contains(rest, '{pat}') THEN list_append(hits, '{name}') ELSE hits END AS hits FROM {prev})")
        prev = f"r{n}"
    return f"""
WITH known(s, id) AS (VALUES {known}),
numbered AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
cut AS (SELECT n, unnest(regexp_split_to_array(text, '[.!?;:]+(?:\\s+|$)|\\n+')) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?;:]+(?:\\s+|$)|\\n+'), 1) AS p FROM numbered),
ids AS (SELECT n, list(id ORDER BY p) AS ids FROM (SELECT n, p, trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS s FROM cut) JOIN known USING (s) GROUP BY n),
joined AS (SELECT doc_id, n, coalesce(array_to_string(ids, ' '), '') AS sentences, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS rest, []::VARCHAR[] AS hits FROM numbered LEFT JOIN ids USING (n)),
{", ".join(steps)}
SELECT doc_id, sentences, CASE WHEN sentences = '' THEN 'NONE' ELSE array_to_string(list_sort(list_distinct(CASE WHEN contains(rest, '<') THEN list_append(hits, 'UNKNOWN') ELSE hits END)), ' ') END AS licenses
FROM {prev}"""
