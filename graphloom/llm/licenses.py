"""Licence scan: texts compared to templates by the Dice coefficient over word bigrams, in DataFrame functions only."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontamination import lowered

#: Licence texts and notices, normalised before use.
DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
)
PERMISSION = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
)
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        PERMISSION,
        PERMISSION + ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + DISCLAIMER,
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + DISCLAIMER,
    ],
    "ISC": [
        "Licensed under the ISC License.",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "Zlib": [
        "Licensed under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "LGPL-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
}
LEAST = 0.8


def normal_words(text: Column) -> Column:
    """Words of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return F.array_remove(F.split(lowered(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words; a lone word is its own."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(words)


def needles(templates: list[list[str]], least: float) -> list[str]:
    """Words of which a text with Dice >= ``least`` to some template must hold one.

    Such a text shares more than least / (2 - least) of the template's bigrams;
    words are chosen until the bigrams without any of them are fewer.
    """
    chosen: set[str] = set()
    for grams in sorted(templates, key=len):
        left = [set(g.split(" ")) for g in grams if not chosen & set(g.split(" "))]
        while left and len(left) >= len(grams) * least / (2 - least):
            words = {w for g in left for w in g}
            pick = max(words, key=lambda w: (min(len(w), 8), sum(w in g for g in left), w))
            chosen.add(pick)
            left = [g for g in left if pick not in g]
    return sorted(chosen)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """``(doc_id, license, dice, matches)`` of every row.

    Lines, paragraphs (between blank lines) of several lines, and the whole
    text are compared to each template; ``matches`` lists (dice, name, unit)
    of those with Dice >= ``least``, best first, ties by name; license and dice
    are the best, or null. Between sets of a and b bigrams, Dice is at most
    2 min(a, b) / (a + b): templates whose size rules them out aren't compared,
    nor units without any word that each match must hold. Null counts as empty;
    whole texts are read; repeated rows each give the same row; other columns
    are ignored; without templates nothing matches.
    """
    spark = docs.sparkSession
    known = sorted((name, text) for name, texts in (TEMPLATES if templates is None else templates).items() for text in texts)
    # templates are parameters of the query: normalised by the same expressions, a row each, on the driver
    rows = [(r[0], r[1]) for r in spark.createDataFrame(known, "name string, text string").select("name", bigrams(normal_words(F.col("text"))).alias("b")).collect() if r[1]] if known else []
    none = F.expr("cast(array() as array<struct<dice:double,name:string,unit:string>>)")
    if not rows:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice"), none.alias("matches"))
    described = json.dumps([{"name": n, "grams": b, "low": len(b) * least / (2 - least), "high": len(b) * (2 - least) / least} for n, b in rows])
    table = F.from_json(F.lit(described), "array<struct<name:string,grams:array<string>,low:double,high:double>>")  # a constant
    must = "(?i)(?:" + "|".join(re.escape(w) for w in needles([b for _, b in rows], least)) + ")"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    units = F.array_distinct(F.concat(F.split(text, r"\r?\n"), F.filter(F.split(text, r"\r?\n[ \t]*\r?\n"), lambda u: u.contains("\n")), F.array(text)))

    def dice(b: Column, t: Column) -> Column:
        return F.when(F.size(b).between(t["low"], t["high"]), 2.0 * F.size(F.array_intersect(b, t["grams"])) / (F.size(b) + F.size(t["grams"]))).otherwise(0.0)

    def compared(unit: Column) -> Column:
        against = lambda b: F.transform(table, lambda t: F.struct(dice(b, t).alias("dice"), t["name"].alias("name"), unit.alias("unit")))
        return F.flatten(F.transform(F.transform(F.array(normal_words(unit)), bigrams), against))

    found = F.filter(F.flatten(F.transform(F.filter(units, lambda u: u.rlike(must)), compared)), lambda m: m["dice"] >= least)
    best = F.array_sort(found, lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    out = docs.select(F.col(id_col).alias("doc_id"), F.when(text.rlike(must), best).otherwise(none).alias("matches"))
    return out.select("doc_id", F.get("matches", F.lit(0))["name"].alias("license"), F.get("matches", F.lit(0))["dice"].alias("dice"), "matches")
