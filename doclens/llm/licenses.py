"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

All of it is SQL functions. Texts and templates are lower-cased and split into runs of letters and digits. A text's
bigrams that some template has are found by a join with the templates' bigrams, a fixed list that is
broadcast. A template that is too long for a text is no candidate: Dice <= 2 n / (n + t) for a text of n bigrams, so the pair
is pruned in that join, before anything is counted or shuffled. Within a text a window of n bigrams can only reach AT_LEAST
if n <= (2 / AT_LEAST - 1) t, as Dice <= 2 t / (n + t), and if it has AT_LEAST t / (2 - AT_LEAST) hits at least, as
Dice <= 2 c / (c + t) for c of them. So only hits with as many within that reach ahead begin a window, and only hits within reach
of such a one are kept. From each of the former every window within the size bound is scored, up to every hit; nothing else
limits a window, so words put in, repeated lines and stray hits beside a notice do no harm. The Dice coefficient counts each
bigram as often as both sides have it.

Result for each row: ``license`` (best template, BARE only if there is no other, null if none reaches AT_LEAST; ties by name), ``dice`` (0 if none),
``n_licenses`` (templates found), ``first_word``, ``last_word`` (the best region). Null, empty and wordless texts
have none. Rows of equal text share the result; repeated rows repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import table
from doclens.llm.fingerprint import words

AT_LEAST = 0.8

# Texts of public licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Licensed under the BSD 3-Clause License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-1.0": "Released into the public domain under CC0 1.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "No part of this publication may be reproduced without permission. All rights reserved.",
    "rights-reserved": "All rights reserved.",
}
#: Licence texts hold this line too, so it names a text only if no other template is found.
BARE = "rights-reserved"


def bigrams(tokens):
    """Hashes of successive word pairs, in order."""
    hashed = F.transform(F.array(F.transform(tokens, lambda w: F.xxhash64(w))), lambda h: F.when(F.size(h) > 1, F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))))
    return F.element_at(hashed, 1)


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(template, total, gram, often): a fixed list, a few thousand rows."""
    rows = spark.createDataFrame(sorted(texts.items()), "template string, text string")
    each = rows.select("template", F.explode(bigrams(words(F.col("text")))).alias("gram"))
    return each.groupBy("template", "gram").agg(F.count("*").alias("often")).join(each.groupBy("template").agg(F.count("*").alias("total")), "template")


def candidates(docs: DataFrame, known: DataFrame, text: str = "text", at_least: float = AT_LEAST) -> DataFrame:
    """(th, template, total, often, at, gram): the places of template bigrams in texts that are long enough for the template."""
    rows = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), bigrams(words(F.col(text))).alias("grams"))
    rows = rows.select("th", F.size("grams").alias("n"), F.posexplode("grams").alias("at", "gram"))
    fits = 2.0 * F.col("n") >= at_least * (F.col("n") + F.col("total")) - 1e-9
    return rows.join(F.broadcast(known), "gram").where(fits).select("th", "template", "total", "often", "at", "gram").distinct()


def scan(docs: DataFrame, text: str = "text", texts: dict[str, str] | None = None, at_least: float = AT_LEAST) -> DataFrame:
    """(th, license, dice, n_licenses, first_word, last_word) of each distinct text with a licence; th hashes the text."""
    known = templates(docs.sparkSession, TEMPLATES if texts is None else texts)
    hits = candidates(docs, known, text, at_least)
    often = [r["often"] for r in known.select("often").distinct().collect()]  # a few numbers
    # a hit counts in a window that begins after the hit that stands as many hits of its bigram before as the template has
    before = " ".join(f"when {k} then lag(at, {k}) over (partition by th, template, gram order by at)" for k in often) or "when 0 then 0"
    reach = f"{2 / at_least - 1 + 1e-9!r}D"  # places within a window, in units of the template's bigrams
    found = docs.sparkSession.sql(f"""
        with counted as (
          select *, at / total as place, coalesce(case often {before} end, -1) as before,
            count(*) over (partition by th, template order by at / total range between current row and {reach} following) as c
          from {{hits}}),
        begun as (
          select *, {2 - at_least!r}D * c >= {at_least!r}D * total - 1e-9D as begins from counted),
        near as (
          select *, max(begins) over (partition by th, template order by place range between {reach} preceding and current row) as kept from begun),
        ahead as (
          select th, template, total, at, begins, collect_list(struct(at, before)) over (
            partition by th, template order by place range between current row and {reach} following) as hits from near where kept),
        scored as (
          select th, template, at as low, aggregate(
            filter(hits, h -> 2.0D * total >= {at_least!r}D * (h.at - at + 1 + total) - 1e-9D),
            struct(0 as shared, 0.0D as dice, at as high),
            (x, h) -> named_struct(
              'shared', x.shared + if(h.before < at, 1, 0),
              'dice', greatest(x.dice, 2.0D * (x.shared + if(h.before < at, 1, 0)) / (h.at - at + 1 + total)),
              'high', if(2.0D * (x.shared + if(h.before < at, 1, 0)) / (h.at - at + 1 + total) > x.dice, h.at, x.high))) as w, total
          from ahead where begins),
        best as (
          select th, template, max(struct(w.dice as dice, -low as low, w.high as high)) as b
          from scored where w.dice >= {at_least!r}D group by th, template)
        select th, count(*) as n_licenses, min(struct(template = '{BARE}' as bare, -b.dice as d, template, b)) as m from best group by th""", hits=hits)
    return found.select("th", F.col("m.template").alias("license"), F.col("m.b.dice").alias("dice"), "n_licenses", (-F.col("m.b.low")).cast("long").alias("first_word"), (F.col("m.b.high") + 1).cast("long").alias("last_word"))


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the licence of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs)
    own = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    return own.join(found, "th", "left").select("doc_id", "license", F.coalesce("dice", F.lit(0.0)).alias("dice"), F.coalesce("n_licenses", F.lit(0).cast("long")).alias("n_licenses"), "first_word", "last_word")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


REACH = 2 / AT_LEAST - 1 + 1e-9
SQL = rf"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(TEMPLATES.items()))}) v(template, text)),
tw AS (SELECT template, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM t),
tb AS (SELECT template, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS gram, len(w) - 1 AS total FROM tw),
tc AS (SELECT template, gram, total, count(*) AS often FROM tb GROUP BY ALL),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
db AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: struct_pack(pos := i - 1, gram := w[i] || ' ' || w[i+1])), recursive := true) FROM dw),
h AS (SELECT doc_id, template, total, often, pos, gram FROM db JOIN tc USING (gram)),
c AS (SELECT *, coalesce(lag(pos, CAST(often AS INT)) OVER (PARTITION BY doc_id, template, gram ORDER BY pos), -1) AS before,
  count(*) OVER (PARTITION BY doc_id, template ORDER BY CAST(pos AS DOUBLE) / total RANGE BETWEEN CURRENT ROW AND {REACH} FOLLOWING) AS ahead FROM h),
s AS (SELECT doc_id, template, total, pos AS low FROM c WHERE {2 - AT_LEAST} * ahead >= {AT_LEAST} * total - 1e-9),
w AS (SELECT s.*, c.pos AS high, sum(CASE WHEN c.before < s.low THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id, s.template, s.low ORDER BY c.pos) AS shared
  FROM s JOIN c ON s.doc_id = c.doc_id AND s.template = c.template AND c.pos >= s.low AND c.pos <= s.low + {REACH} * s.total),
d AS (SELECT doc_id, template, CAST(2.0 * shared AS DOUBLE) / (high - low + 1 + total) AS dice, low, high FROM w WHERE 2.0 * shared >= {AT_LEAST} * (high - low + 1 + total)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template ORDER BY dice DESC, low, high) AS r FROM d),
f AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, template) AS q FROM b WHERE r = 1)
SELECT x.doc_id, f.template AS license, coalesce(f.dice, 0.0) AS dice, CAST(coalesce(f.n, 0) AS BIGINT) AS n_licenses,
  CAST(f.low AS BIGINT) AS first_word, CAST(f.high + 1 AS BIGINT) AS last_word
FROM documents x LEFT JOIN f ON f.doc_id = x.doc_id AND f.q = 1
"""
