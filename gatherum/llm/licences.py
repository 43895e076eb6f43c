"""Licence scan: Dice coefficient over word bigrams between passages and licence templates.

Passages are the lines of a text, its paragraphs of several lines, and the text itself where it has several paragraphs.
Words are runs of letters and digits in lower case, in a normal form: ``licence`` is spelt with s, lines that name a copyright holder
and the numbers of lists are left out. The Dice coefficient of sets of a and b bigrams is at most
2 min(a, b) / (a + b), so a template whose size is outside [t / (2 - t), (2 - t) / t] times the passage's is never compared.
The same bound says how many bigrams of its template a passage may lack at most; words that stand in more than so many of them
are marks of the template, and a text with no mark of any template is passed over without being cut.
DataFrame functions only, and no shuffle: templates are a literal of the plan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherum.llm.quality import let

#: Least Dice coefficient, in per cent.
THRESHOLD = 80
# Wordings of licence notices and licences, as they are published.
TEMPLATES = [
    ("apache-2.0-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd-style-notice", "BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd-redistribution", "BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0-notice", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0-short", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0-short", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0-short", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-notice", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-3.0-notice", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-header", "GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit-notice", "MIT", "Released under the MIT License."),
    ("mit-licensed", "MIT", "Licensed under the MIT License."),
    ("mit-permission", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mpl-2.0-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mit-warranty", "MIT", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("isc-full", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("0bsd", "0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("bsd-warranty", "BSD-2-Clause", "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."),
    ("gpl-2.0-header", "GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-warranty", "GPL", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details."),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0-header", "LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0-header", "AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("epl-2.0-header", "EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("zlib", "Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("bsl-1.0", "BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
]
#: Licences of several parts, from the parts above and what stands between them: (name, licence, parts).
_BSD_TERMS = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_parts = {name: text for name, _, text in TEMPLATES}
TEMPLATES += [
    ("mit-full", "MIT", " ".join([_parts["mit-permission"], _MIT_NOTICE, _parts["mit-warranty"]])),
    ("bsd-2-full", "BSD-2-Clause", " ".join([_parts["bsd-redistribution"], _BSD_TERMS, _parts["bsd-warranty"]])),
    ("bsd-3-full", "BSD-3-Clause", " ".join([_parts["bsd-redistribution"], _BSD_TERMS, _BSD_NAMES, _parts["bsd-warranty"]])),
    ("gpl-3.0-header-full", "GPL-3.0-or-later", " ".join([_parts["gpl-3.0-header"], _parts["gpl-warranty"]])),
    ("gpl-2.0-header-full", "GPL-2.0-or-later", " ".join([_parts["gpl-2.0-header"], _parts["gpl-warranty"]])),
    ("agpl-3.0-header-full", "AGPL-3.0-or-later", " ".join([_parts["agpl-3.0-header"], _parts["gpl-warranty"].replace("GNU General", "GNU Affero General")])),
]
WORDS = r"[\p{L}\p{N}]+"
#: Lines that name a copyright holder, and the number or letter of a list at the start of a line. Line feeds stay.
COPYRIGHT_LINE = r"(?im)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©)[^\n]*"
LIST_NUMBER = r"(?m)^[^\p{L}\p{N}\n]*(?:[0-9]{1,2}|[a-z])[.)][ \t]+"


def _spelt(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("licenc"), F.lit("licens"))


def normal_form(text: Column) -> Column:
    return _spelt(F.regexp_replace(F.regexp_replace(text, COPYRIGHT_LINE, ""), LIST_NUMBER, ""))


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower().replace("licenc", "licens"))
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def marks(templates: list[list[str]], threshold: int) -> list[str]:
    """Words of which every passage that reaches the threshold with any of the templates (as bigrams) has one at least.

    A passage lacks at most a share of its template's bigrams; words that stand in more of them than that can't all be missing. Words that
    other texts seldom have are taken first: abbreviations without a vowel and long words, and numbers last.
    """
    rarity = lambda w: 0 if not w.isalpha() else min(len(w), 8) if len(w) < 2 or set(w) & set("aeiouy") else 8
    chosen: set[str] = set()
    for bigrams in sorted(templates, key=len):
        n = len(bigrams)
        least = -(-(n + -(-n * threshold // (200 - threshold))) * threshold // 200)  # common bigrams with the smallest passage
        may_lack = n - least
        while sum(any(w in chosen for w in b.split()) for b in bigrams) <= may_lack:
            open_ones = [b.split() for b in bigrams if not any(w in chosen for w in b.split())]
            words = {w for b in open_ones for w in b}
            chosen.add(max(sorted(words), key=lambda w: (rarity(w), sum(w in b for b in open_ones))))
    return sorted(w for w in chosen if not any(o != w and o in w for o in chosen))  # a part of a mark is found with it


def _marked(text: Column, known: list[list[str]], threshold: int) -> Column:
    """Whether a text has a mark of some template."""
    low = _spelt(F.coalesce(text, F.lit("")))
    return let(low, lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in marks(known, threshold)]))


def _bigrams(words: Column) -> Column:
    made = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))
    return F.when(F.size(words) >= 2, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, unit, unit_no, passage."""
    text = normal_form(F.coalesce(F.col(text_col), F.lit("")))
    cut = lambda unit, parts, keep: F.filter(F.transform(parts, lambda x, i: F.struct(F.lit(unit).alias("unit"), i.cast("long").alias("unit_no"), x.alias("passage"))), keep)
    paragraphs = F.split(text, r"\n\s*\n", -1)
    units = F.concat(
        cut("line", F.split(text, "\n", -1), lambda x: x["passage"] != ""),
        cut("paragraph", paragraphs, lambda x: F.trim(x["passage"]).contains("\n")),
        F.when(text.rlike(r"\S\s*\n\s*\n\s*\S"), F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).cast("long").alias("unit_no"), text.alias("passage")))).otherwise(F.array()),
    )
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(units).alias("u")).select("doc_id", "u.*")


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """One row per passage that is a licence: doc_id, unit, unit_no, template, licence, n_bigrams, n_common, dice.

    The template with the largest coefficient counts, of equal ones the first by name. Null and empty texts, and passages
    of fewer than two words, are no licence; texts of any length are read whole. Repeated rows each give their rows; an empty
    table gives none; other columns are ignored.
    """
    known = [(name, licence, template_bigrams(text)) for name, licence, text in templates or TEMPLATES]
    forms = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(x).alias("licence"), F.array(*map(F.lit, b)).alias("b"), F.lit(len(b)).alias("n")) for n, x, b in known])
    low, high = threshold, 200 - threshold  # sizes a and b with a * high >= b * low and b * high >= a * low
    least = min(len(b) for _, _, b in known) * low // high

    def scores(mine: Column) -> Column:
        near = F.filter(forms, lambda t: (t["n"] * high >= F.size(mine) * low) & (F.size(mine) * high >= t["n"] * low))
        scored = F.transform(near, lambda t: F.struct(F.size(F.array_intersect(mine, t["b"])).alias("n_common"), t["n"].alias("n"), t["template"].alias("template"), t["licence"].alias("licence")))
        hits = F.filter(scored, lambda s: s["n_common"] * 200 >= (F.size(mine) + s["n"]) * threshold)
        ratio = lambda s: F.round(s["n_common"] * 2.0 / (F.size(mine) + s["n"]), 6)
        return F.transform(hits, lambda s: F.struct((-ratio(s)).alias("order"), s["template"].alias("template"), s["licence"].alias("licence"), F.size(mine).cast("long").alias("n_bigrams"), s["n_common"].cast("long").alias("n_common"), ratio(s).alias("dice")))

    words = F.regexp_extract_all("passage", F.lit(WORDS), F.lit(0))
    units = passages(docs.where(_marked(F.col(text_col), [b for _, _, b in known], threshold)), id_col, text_col).withColumn("words", words).where(F.size("words") > least)
    best = units.select("doc_id", "unit", "unit_no", F.array_min(let(_bigrams(F.col("words")), scores)).alias("best")).where("best is not null")
    return best.select("doc_id", "unit", "unit_no", "best.template", "best.licence", "best.n_bigrams", "best.n_common", "best.dice")


def embedded_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """One row per notice anywhere in a text: doc_id, first_word, n_words, template, licence, n_bigrams, n_common, dice.

    Windows of words slide over the whole text, so lines, comment marks and the sentence around a notice don't matter. A window begins and ends
    with a bigram of its template and has up to twice as many bigrams (repeats included); one that reaches the threshold counts
    unless an overlapping one has a larger coefficient, or the same and begins earlier, or the same again and a template first by name. Only
    texts that hold enough bigrams of a template anywhere get windows. Null and empty texts give no rows; repeated rows each give theirs.
    """
    known = [(name, licence, template_bigrams(text)) for name, licence, text in templates or TEMPLATES]
    forms = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(x).alias("licence"), F.array(*map(F.lit, b)).alias("b"), F.lit(len(b)).alias("n")) for n, x, b in known])
    union = sorted({b for _, _, bigrams in known for b in bigrams})
    low, high = threshold, 200 - threshold  # n_common * high >= n * low wherever the coefficient reaches the threshold

    def window(words: Column, p: Column, q: Column, t: Column) -> Column:
        def scored(mine: Column) -> Column:
            common = F.size(F.array_intersect(mine, t["b"]))
            row = F.struct((-F.round(common * 2.0 / (F.size(mine) + t["n"]), 6)).alias("order"), p["i"].alias("first"), t["template"].alias("template"), (q["i"] + 1).alias("last"), t["licence"].alias("licence"), F.size(mine).cast("long").alias("n_bigrams"), common.cast("long").alias("n_common"))
            return F.when(common * 200 >= (F.size(mine) + t["n"]) * threshold, row)

        return let(_bigrams(F.slice(words, p["i"] + 1, q["i"] - p["i"] + 2)), scored)

    def of_template(words: Column, hits: Column, t: Column) -> Column:
        ends = lambda mine, p: F.filter(mine, lambda q: (q["i"] >= p["i"]) & (q["i"] - p["i"] < t["n"] * 2))
        best = lambda mine: F.transform(mine, lambda p: F.array_min(F.transform(ends(mine, p), lambda q: window(words, p, q, t))))
        return F.filter(let(F.filter(hits, lambda h: F.array_contains(t["b"], h["b"])), best), lambda c: c.isNotNull())

    def of_hits(words: Column, hits: Column) -> Column:
        near = F.filter(forms, lambda t: F.size(F.array_intersect(F.transform(hits, lambda h: h["b"]), t["b"])) * high >= t["n"] * low)
        found = F.flatten(F.transform(near, lambda t: of_template(words, hits, t)))
        beaten = lambda c, x: F.exists(c, lambda y: (y["first"] <= x["last"]) & (x["first"] <= y["last"]) & (y < x))
        return let(found, lambda c: F.filter(c, lambda x: ~beaten(c, x)))

    def of_words(words: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)).alias("b"), i.alias("i")))
        return let(F.filter(pairs, lambda p: p["b"].isin(union)), lambda hits: of_hits(words, hits))

    words = F.regexp_extract_all(_spelt(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORDS), F.lit(0))
    rows = docs.where(_marked(F.col(text_col), [b for _, _, b in known], threshold)).select(F.col(id_col).cast("long").alias("doc_id"), F.explode(let(words, of_words)).alias("w"))
    return rows.select("doc_id", F.col("w.first").cast("long").alias("first_word"), (F.col("w.last") - F.col("w.first") + 1).cast("long").alias("n_words"), "w.template", "w.licence", "w.n_bigrams", "w.n_common", (-F.col("w.order")).alias("dice"))
