"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from directories.

*Sections* of a file are its headers: each run of adjoining lines that hold one of
``TRIGGERS``, and each paragraph (blank or ornamental lines part them) that holds one. A
*licence file* has a name that says so (``LICENSE``, ``COPYING``, ...); its sections are
its whole text, too, and all its paragraphs. A file of which at least half of the words
are a section that was recognised is a licence file as well. Templates are short notices,
the titles of long licences, and the whole texts of short ones.

A section takes the template with the largest cosine if that is at least ``MIN_COSINE``;
weights are term frequency times ln((1 + N) / (1 + df)) + 1 over the N templates, and
words of no template have df 0. A file takes its best section (ties: template order).

A file without a licence of its own takes that of the nearest ancestor directory (its
own first) that holds a licence file; of several the best cosine, then the least path.

Everything is DataFrame operations. A text is lower-cased and searched for the triggers
once; only sections are taken apart. Templates are a constant of this module, so what
is broadcast has a fixed size. Inheritance is resolved on distinct directories, and
files meet the result by an equi-join whose right side has one row for each directory.

Defined cases: null texts have no sections; a null path is a file of no directory and
inherits nothing; repeated paths are one file, each of their rows gets its result; very
long texts are lines like others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_COSINE = 0.6
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = "it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Notices, titles and texts of well-known licences (fixed values).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "redistribute it and/or modify it under the terms of the GNU General Public License, version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "redistribute it and/or modify it under the terms of the GNU General Public License, version 2 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved"),
    # whole texts
    (
        "MIT",
        "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        'and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", "BSD 2-Clause License Copyright (c) All rights reserved. " + _BSD + _BSD_TWO + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License Copyright (c) All rights reserved. " + _BSD + _BSD_TWO + _BSD_THIRD + _BSD_END),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
        "laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit "
        "of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
        "present and future rights to this software under copyright law. " + _AS_IS,
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
        "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
        "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    # titles of long texts
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    # notices in source files
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify " + _GNU.format("General Public License", 3)),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify " + _GNU.format("General Public License", 2)),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify " + _GNU.format("Affero General Public License", 3)),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify " + _GNU.format("Lesser General Public License", 3)),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify " + _GNU.format("Lesser General Public License", 2.1)),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
]
#: Identifiers of the short form, with the licence that each stands for (fixed values).
IDENTIFIERS = {
    "MIT": "MIT", "ISC": "ISC", "Zlib": "Zlib", "Unlicense": "Unlicense", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause",
    "MPL-2.0": "MPL-2.0", "EPL-2.0": "EPL-2.0", "CC0-1.0": "CC0-1.0", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0",
    **{f"{x}-{v}{e}": f"{x}-{v}" for x, v in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")) for e in ("", "-only", "-or-later")},
}
TEMPLATES += [(x, f"SPDX-License-Identifier: {name}") for name, x in IDENTIFIERS.items()]
TRIGGERS = ["licens", "licenc", "copyright", "rights reserved", "hereby granted", "redistribut", "public domain", "public license"]
FILE_NAMES = r"(?i)^(licen[sc]e|copying|copyright|notice|unlicense)([._-].*)?$"
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: A line break, a line without letters or digits (as comments have them between paragraphs), and its break.
PARAGRAPH = r"\n[ \t\r#*/;%!<>=-]*\n"
#: Stands for the lines without a trigger.
GAP = "\x01"


def _has_trigger(text: Column) -> Column:
    found = F.lit(False)
    for t in TRIGGERS:
        found = found | text.contains(t)
    return found


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def runs(text: Column) -> Column:
    """The runs of adjoining lines with a trigger; lines of a run are joined by a space."""
    marked = F.transform(F.split(text, "\n"), lambda line: F.when(_has_trigger(line), F.concat(line, F.lit(" "))).otherwise(F.lit(GAP)))
    return F.transform(F.filter(F.split(F.array_join(marked, ""), GAP + "+"), _has_trigger), F.trim)


def template_weights(df: DataFrame) -> DataFrame:
    """template, license, word, weight and norm of the templates; some two hundred rows."""
    spark = df.sparkSession
    rows = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(x).alias("license"), F.lit(t.lower()).alias("text")) for i, (x, t) in enumerate(TEMPLATES)))
    words = spark.range(1, numPartitions=1).select(F.explode(rows).alias("t")).select("t.template", "t.license", F.explode(_words(F.col("t.text"))).alias("word"))
    counts = words.groupBy("template", "license", "word").agg(F.count("*").alias("tf"))
    frequency = counts.groupBy("word").agg(F.count("*").alias("df"))
    weight = F.col("tf") * (F.log(F.lit(1.0 + len(TEMPLATES)) / (1.0 + F.col("df"))) + 1.0)
    weighted = counts.join(frequency, "word").select("template", "license", "word", weight.alias("weight"), (weight / F.col("tf")).alias("idf"))
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighted.join(norms, "template")


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", min_cosine: float = MIN_COSINE) -> DataFrame:
    """path, own_license, own_score, is_license_file, license, license_source and inherited_from of every row."""
    rows = files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    name = F.element_at(F.split("path", "/"), -1)
    named = F.coalesce(name.rlike(FILE_NAMES), F.lit(False))
    lowered = rows.select("path", F.lower("text").alias("text"), named.alias("named")).filter("path is not null").filter(F.col("named") | _has_trigger(F.col("text")))
    paragraphs = F.split("text", PARAGRAPH)
    headers = F.array_distinct(F.concat(runs(F.col("text")), F.filter(paragraphs, _has_trigger)))
    parts = F.when(F.col("named"), F.array_distinct(F.concat(F.array("text"), paragraphs))).otherwise(headers)
    total = F.size(_words(F.col("text"))).cast("long")
    # a path that comes more than once is one file, with the longest and then greatest of its contents
    content = lowered.select("path", F.struct(total.alias("n_words"), parts.alias("parts"), "named").alias("c"))
    sections = content.groupBy("path").agg(F.max("c").alias("c")).select("path", "c.named", "c.n_words", F.posexplode("c.parts").alias("section", "part"))
    words = sections.select("path", "named", "n_words", "section", F.explode(_words(F.col("part"))).alias("word"))
    counts = words.groupBy("path", "named", "section", "word").agg(F.count("*").alias("tf"), F.max("n_words").alias("n_words"))

    templates = template_weights(files)
    idf = templates.groupBy("word").agg(F.first("idf").alias("idf"))
    unseen = F.log(F.lit(1.0 + len(TEMPLATES))) + 1.0
    weighted = counts.join(F.broadcast(idf), "word", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", unseen))
    by_section = Window.partitionBy("path", "section")
    weighted = weighted.withColumn("size", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(by_section))).withColumn("section_words", F.sum("tf").over(by_section))
    dots = (
        weighted.withColumnRenamed("weight", "w")
        .join(F.broadcast(templates.select("word", "template", "license", "weight", "norm")), "word")
        .groupBy("path", "named", "section", "template", "license")
        .agg(
            F.sum(F.col("w") * F.col("weight") / (F.col("size") * F.col("norm"))).alias("cosine"),
            F.max("n_words").alias("n_words"),
            F.max("section_words").alias("section_words"),
        )
        .withColumn("score", F.round("cosine", 6))
        .filter(F.col("score") >= min_cosine)
    )
    best = F.max(F.struct("score", (-F.col("template")).alias("t"), "license", (2 * F.col("section_words") >= F.col("n_words")).alias("most")))
    own = dots.groupBy("path", "named").agg(best.alias("best")).select(
        "path",
        F.col("best.license").alias("own_license"),
        F.col("best.score").alias("own_score"),
        (F.col("named") | F.col("best.most")).alias("is_license_file"),
    )
    directory = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    declared = (
        own.filter("is_license_file")
        .withColumn("declares", directory)
        .groupBy("declares")
        .agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", F.col("own_license").alias("license")))["license"].alias("dir_license"))
    )
    slim = rows.select("path", directory.alias("dir"))
    parts = F.split("dir", "/")
    depth = F.sequence(F.lit(0), F.size(parts))
    ancestor = F.transform(depth, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("ancestor")))
    nearest = (
        slim.filter("path is not null")
        .select("dir")
        .distinct()
        .select("dir", F.inline(ancestor))
        .join(declared, F.col("ancestor") == F.col("declares"))
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "ancestor", "dir_license")).alias("near"))
        .select(F.col("dir").alias("dir_"), F.col("near.ancestor").alias("inherited_from"), F.col("near.dir_license").alias("inherited"))
    )
    joined = slim.join(own.withColumnRenamed("path", "path_"), F.col("path") == F.col("path_"), "left").join(nearest, F.col("dir") == F.col("dir_"), "left")
    mine = F.col("own_license").isNotNull()
    source = F.when(mine & F.col("is_license_file"), "file").when(mine, "header").when(F.col("inherited").isNotNull() & F.col("path").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        "path",
        "own_license",
        "own_score",
        F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"),
        F.coalesce("own_license", F.when(F.col("path").isNotNull(), F.col("inherited"))).alias("license"),
        source.alias("license_source"),
        F.when(source == "inherited", F.col("inherited_from")).alias("inherited_from"),
    )
