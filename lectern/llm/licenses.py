"""Licence scan: passages against licence templates by Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: licence notices as their authors word them; a sentence that several licences share stands
# under the family's name
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-sentence": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-sentence": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0-sentence": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0-sentence": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0-sentence": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

# words that ordinary prose is full of; they narrow nothing
_COMMON = {"a", "an", "and", "any", "as", "at", "by", "for", "in", "is", "may", "not", "of", "or", "the", "this", "to", "under", "with", "you"}
_NOT_WORD = r"[^\p{L}\p{N}\n]+"


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams in order of first use, of a template."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def anchors(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every text that reaches the threshold with some template holds at least one.

    Such a text lacks at most (2 - 2t) / (2 - t) of the template's bigrams, so words that lie in more
    of its bigrams than that can't all be absent. The longest words that aren't common are taken first, which other texts use least.
    """
    found: set[str] = set()
    for text in templates.values():
        pairs = [b.split() for b in bigrams(text)]
        most = math.floor(len(pairs) * (2 - 2 * threshold) / (2 - threshold) + 1e-9)
        for w in sorted({w for p in pairs for w in p}, key=lambda w: (w not in found, w in _COMMON, -len(w), w)):
            if sum(bool(found & set(p)) for p in pairs) > most:
                break
            found.add(w)
    return sorted(found)


def _units(norm: F.Column) -> F.Column:
    """Lines, paragraphs and the whole of a normalised text, as (unit, position, words)."""
    def words(c):
        return F.filter(F.split(c, "[ \n]+"), lambda w: w != "")

    def of(kind, parts):
        return F.transform(parts, lambda c, i: F.struct(F.lit(kind).alias("unit"), i.cast("int").alias("position"), words(c).alias("words")))

    return F.concat(of("line", F.split(norm, "\n")), of("paragraph", F.split(norm, "\n *\n")), of("text", F.array(norm)))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, license, unit, position, shared, unit_bigrams, template_bigrams, dice: the best match of
    each template in each document, if its Dice coefficient reaches the threshold.

    A unit counts for the template that it is most like only, so that a licence isn't reported beside a
    sibling whose notice differs in a word; of equal ones for the longer template, then the last name.

    A text is put in lower case and everything but letters and digits (and line ends) made blank. Its
    lines, its paragraphs (between blank lines) and its whole are compared by their distinct word
    bigrams. A unit of n bigrams can reach threshold t only with templates of t / (2 - t) * n to
    (2 - t) / t * n bigrams; the others are pruned by size. Before that, units without any of the
    words that such a match can't lack are passed over, whole documents first.

    Ties go to the first unit in the order line, paragraph, text, then position. Null and empty texts
    match nothing; a unit of one word has no bigrams. Rows with a null doc_id count as one document,
    rows that repeat a doc_id too. Other columns are ignored; no rows give no rows. Nothing but the
    matches is shuffled, and the templates are literals of the plan.
    """
    templates = templates or TEMPLATES
    need = r"(?<![\p{L}\p{N}])(?:" + "|".join(anchors(templates, threshold)) + r")(?![\p{L}\p{N}])"
    norm = F.regexp_replace(F.lower("text"), _NOT_WORD, " ")
    d = docs.select("doc_id", norm.alias("norm")).where(F.col("norm").rlike(need))
    u = d.select("doc_id", F.explode(_units(F.col("norm"))).alias("u")).select("doc_id", "u.*")
    sizes = {name: len(bigrams(t)) for name, t in templates.items()}
    lo, hi = threshold / (2 - threshold), (2 - threshold) / threshold
    u = u.where(F.size("words") > math.floor(lo * min(sizes.values()))).where(F.arrays_overlap("words", F.array(*[F.lit(a) for a in anchors(templates, threshold)])))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1))))
    u = u.where(F.size("words") > 1).withColumn("pairs", pairs).withColumn("n", F.size("pairs"))
    u = u.where(F.col("n").between(math.floor(lo * min(sizes.values())), math.ceil(hi * max(sizes.values()))))
    lit = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(sizes[name]).alias("m"), F.array(*[F.lit(b) for b in bigrams(t)]).alias("t")) for name, t in sorted(templates.items())])
    close = F.filter(lit, lambda t: (t["m"] * (2 - threshold) >= threshold * F.col("n") - 1e-9) & (F.col("n") * (2 - threshold) >= threshold * t["m"] - 1e-9))
    shared = lambda t: F.size(F.array_intersect("pairs", t["t"]))
    scored = F.transform(close, lambda t: F.struct((2.0 * shared(t) / (F.col("n") + t["m"])).alias("dice"), t["m"].alias("m"), t["license"].alias("license"), shared(t).alias("shared")))
    m = u.withColumn("t", F.array_max(scored)).where(F.col("t.dice") >= threshold).select("doc_id", "unit", "position", "n", "t", F.col("t.shared").alias("shared"), F.col("t.dice").alias("dice"))
    best = F.min_by(F.struct("unit", "position", "shared", "n", "t.m", "dice"), F.struct((-F.col("dice")).alias("d"), "unit", "position"))
    m = m.groupBy("doc_id", F.col("t.license").alias("license")).agg(best.alias("b"))
    return m.select("doc_id", "license", "b.unit", "b.position", F.col("b.shared").alias("shared"), F.col("b.n").alias("unit_bigrams"), F.col("b.m").alias("template_bigrams"), "b.dice")


def oracle_sql(threshold: float = 0.8) -> str:
    """The same over the view documents, in DuckDB's dialect."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(name)}, {quote(t)})" for name, t in TEMPLATES.items())
    words = "list_filter(string_split_regex({}, '[ \\n]+'), lambda w: w <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    template_words = words.format("regexp_replace(lower(txt), '[^\\p{L}\\p{N}\\n]+', ' ', 'g')")
    return f"""
WITH t AS (SELECT license, {pairs} AS p FROM (SELECT license, {template_words} AS w FROM (VALUES {rows}) AS v(license, txt))),
n AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS norm FROM documents WHERE text IS NOT NULL),
u AS (
  SELECT doc_id, 'line' AS unit, s, generate_subscripts(s, 1) - 1 AS position, unnest(s) AS c FROM (SELECT doc_id, string_split(norm, chr(10)) AS s FROM n)
  UNION ALL SELECT doc_id, 'paragraph', s, generate_subscripts(s, 1) - 1, unnest(s) FROM (SELECT doc_id, string_split_regex(norm, '\\n *\\n') AS s FROM n)
  UNION ALL SELECT doc_id, 'text', NULL, 0, norm FROM n),
b AS (SELECT doc_id, unit, position, {pairs} AS p FROM (SELECT doc_id, unit, position, {words.format("c")} AS w FROM u) WHERE len(w) > 1),
m AS (SELECT doc_id, license, unit, CAST(position AS INTEGER) AS position, CAST(len(list_intersect(b.p, t.p)) AS INTEGER) AS shared, CAST(len(b.p) AS INTEGER) AS unit_bigrams, CAST(len(t.p) AS INTEGER) AS template_bigrams
  FROM b JOIN t ON len(b.p) BETWEEN 0.6 * len(t.p) AND 1.7 * len(t.p)),
d AS (SELECT *, 2.0 * shared / (unit_bigrams + template_bigrams) AS dice FROM m
  QUALIFY row_number() OVER (PARTITION BY doc_id, unit, position ORDER BY dice DESC, template_bigrams DESC, license DESC) = 1)
SELECT doc_id, license, unit, position, shared, unit_bigrams, template_bigrams, CAST(dice AS DOUBLE) AS dice FROM d WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, unit, position) = 1
"""
