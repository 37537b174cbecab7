"""License scans by diagonal voting (DataFrame functions only).

Every text is split into words once. Its rolling word 3-grams are joined, by
hash, to the grams of the license templates (a fixed list, so that side is
broadcast); the gram itself is compared too, so a hash collision can't vote.
Grams whose words stand in no template at that place can't join and are left
out before. A hit at word ``p`` of the text and ``t`` of a template votes for
diagonal ``p - t``. Votes are summed by diagonal, diagonals at most ``GAP``
apart (words inserted or left out) are merged, and a merged span is verified
by the share of the template's words that its verified grams cover.

Defined results: null and empty texts have no words, no labels and score 0;
repeated rows each get their document's result, and so do documents that
share an id or have none; input columns named like a result (in any case) are
replaced, all others stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import carried, materialize, text_of

K, GAP, MIN_COVER = 3, 2, 0.7
#: What parts words: every ASCII character but digits and letters.
PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed phrases of the contract: (phrase, label).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Fixed texts by which licenses announce themselves, and license texts: (label, text).
NOTICES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
    # Short notices that stand alone; of three words, so that only the whole of one is enough.
    ("all-rights-reserved", "All rights reserved"),
    ("cc-by-nc", "CC BY NC"),
    ("cc-by-sa", "CC BY SA"),
    ("cc-by", "CC BY 4"),
    ("bsd", "BSD 2 Clause"),
    ("bsd", "BSD 3 Clause"),
    ("bsd", "the BSD License"),
    ("isc", "the ISC License"),
    ("mpl", "Mozilla Public License"),
)
TEXTS = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
        TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that
        you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
        such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered
        from any source distribution.""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
        author or authors of this software dedicate any and all copyright interest in the software to the public domain.
        We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
        We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
        this software under copyright law.""",
    ),
)
BASE = ("n_words", "n_base", "first_word", "last_word", "base_labels")
RESULT = (*BASE, "labels", "score", "license_spans")


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(PARTS, text.translate(str.maketrans(UPPER, LOWER))) if w]


TEMPLATES = tuple((label, " ".join(plain_words(text))) for label, text in NOTICES + TEXTS)


def words(text: str = "text") -> Column:
    return F.filter(F.split(F.translate(text_of(text), UPPER, LOWER), PARTS), lambda w: w != "")


def measured(rows: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``rows`` (in_row, l_text) as in_row, l_uid, the base columns and
    ``l_hits``: place and text of each gram that a template may have."""
    x = rows.select("in_row", F.monotonically_increasing_id().alias("l_uid"), words("l_text").alias("l_words"))
    w = F.col("l_words")

    def places(phrase):
        parts = phrase.split(" ")
        last = len(parts) - 1

        return F.filter(F.transform(w, lambda v, i: F.when((v == parts[last]) & (i >= last), F.when(_all(w, parts[:last], i - last), i - last))), lambda p: p.isNotNull())

    none = F.expr("CAST(array() AS array<int>)")
    has = F.array_contains(w, "license")
    grams = [t.split(" ")[p : p + K] for _, t in templates for p in range(len(t.split(" ")) - K + 1)]
    at = [sorted({g[d] for g in grams}) for d in range(K)]
    gram = lambda i: F.concat_ws(" ", *[F.get(w, i + d) for d in range(K)])
    fits = lambda i: _in(F.get(w, i), at[0]) & _in(F.get(w, i + 1), at[1]) & _in(F.get(w, i + 2), at[2]) & _in(gram(i), sorted({" ".join(g) for g in grams}))
    hits = F.when(F.size(w) >= K, F.transform(F.filter(F.sequence(F.lit(0), F.size(w) - K), fits), lambda i: F.struct(i.alias("p"), gram(i).alias("gram"))))
    x = x.withColumns({"l_hits": hits, **{f"l_{label}": F.when(has, places(phrase)).otherwise(none) for phrase, label in PHRASES}})
    found = F.concat(*[F.col(f"l_{label}") for _, label in PHRASES])
    labels = F.array_sort(F.filter(F.array(*[F.when(F.size(f"l_{label}") > 0, F.lit(label)) for _, label in PHRASES]), lambda v: v.isNotNull()))
    return x.select(
        "in_row", "l_uid", "l_hits",
        F.size(w).cast("long").alias("n_words"), F.size(found).cast("long").alias("n_base"),
        F.array_min(found).cast("long").alias("first_word"), F.array_max(found).cast("long").alias("last_word"), labels.alias("base_labels"),
    )


def _in(x: Column, values: list[str]) -> Column:
    return F.coalesce(x.isin(values), F.lit(False))


def _all(w: Column, parts: list[str], at: Column) -> Column:
    out = F.lit(True)
    for d, part in enumerate(parts):
        out = out & (F.get(w, at + d) == part)
    return out


def template_grams(spark, templates=TEMPLATES) -> DataFrame:
    rows = []
    for i, (label, text) in enumerate(templates):
        t = text.split(" ")
        rows += [(i, label, len(t), p, " ".join(t[p : p + K])) for p in range(len(t) - K + 1)]
    grams = spark.createDataFrame(rows, "template int, label string, template_words int, t int, t_gram string")
    return grams.withColumn("t_hash", F.xxhash64("t_gram"))


def spans(found: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Verified spans of ``measured`` rows: l_uid, label, start, end (words,
    end exclusive), score."""
    grams = found.select("l_uid", F.explode("l_hits").alias("x")).select("l_uid", "x.p", "x.gram", F.xxhash64("x.gram").alias("t_hash"))
    known = F.broadcast(template_grams(found.sparkSession, templates))  # a row a word of the fixed texts
    hits = grams.join(known, "t_hash").where("gram = t_gram")
    votes = hits.groupBy("l_uid", "template", "label", "template_words", (F.col("p") - F.col("t")).alias("diagonal")).agg(
        F.collect_set("t").alias("ts"), F.min("p").alias("start"), F.max("p").alias("end")
    )  # at most a template's length each
    side = Window.partitionBy("l_uid", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(side) > GAP).cast("int"), F.lit(1))
    runs = votes.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(side.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.select("l_uid", "template", "label", "template_words", "run", "start", "end", F.explode("ts").alias("t"))
    merged = each.groupBy("l_uid", "template", "label", "template_words", "run").agg(F.collect_set("t").alias("ts"), F.min("start").alias("start"), (F.max("end") + K).alias("end"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + K - 1)))))
    return merged.select("l_uid", "label", "start", "end", (covered / F.col("template_words")).cast("double").alias("score"))


def license_scan(docs: DataFrame, text: str = "text", min_cover: float = MIN_COVER, templates=TEMPLATES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) plus the base columns, ``labels``,
    ``score`` and ``license_spans`` (label, start, end, score of spans covered
    enough)."""
    named = docs if keep is None else docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*keep, text))])
    rows, back = carried(named, RESULT if keep is None or text in keep else (*RESULT, text), l_text=text)
    found = materialize(measured(rows, templates), "license-rows")
    best = spans(found, templates).groupBy("l_uid").agg(
        F.max("score").alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("score") >= min_cover, F.struct("start", "end", "label", "score")))).alias("license_spans"),
    ).withColumnRenamed("l_uid", "l_found")
    both = found.join(best, F.col("l_uid") == F.col("l_found"), "left")
    own = F.coalesce(F.transform("license_spans", lambda x: x["label"]), F.expr("CAST(array() AS array<string>)"))
    return both.select(*back, *BASE, F.array_sort(F.array_distinct(F.concat("base_labels", own))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "license_spans")
