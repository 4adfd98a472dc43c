"""Licence scan by canonical digests, with DataFrame functions only.

A text becomes canonical: lower case, lines that state a copyright dropped, equivalent spellings made one, and every
run of characters that are neither letters nor digits made a single space. The digest of the whole canonical text is
hash-joined to the digests of known licences; so is each line's digest to those of licence notices, as notices stand
inside documents. A notice is a licence's name or SPDX id after `licensed under`, `released under` and the like, however
the line words that; names and wording are rules, not a list of sentences. Both tables are broadcast: they are as large
as the list of known licences, and `known` takes others or more (the limit KNOWN_ROWS is checked).

Defined cases: null and empty texts, and texts of punctuation or copyright lines only, are canonical '' and match
nothing; repeated rows are told apart by nothing and get equal results; a text that two known licences share gets the
smaller id; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KNOWN_ROWS = 100_000  # of a table of known licences, as it is broadcast

# Whole texts of public licences, in their published wording.
_WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WARRANTY_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
LICENCES = {
    "MIT": f"""MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_WARRANTY_MIT}""",
    "ISC": f"""ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
{_WARRANTY_ISC}""",
    "0BSD": f"""BSD Zero Clause License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
{_WARRANTY_ISC}""",
    "BSD-2-Clause": f"""BSD 2-Clause License
{_BSD_HEAD}
{_BSD_TAIL}""",
    "BSD-3-Clause": f"""BSD 3-Clause License
{_BSD_HEAD}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
{_BSD_TAIL}""",
    "Zlib": """zlib License
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
}
#: Title lines that some copies of a text carry, others not.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "ISC License (ISC)", "The ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"], "Zlib": ["zlib License", "The zlib/libpng License"], "Unlicense": ["The Unlicense"],
}
# Digests of the canonical texts of longer public licences; more than one where copies may end before the
# advice on how to apply them.
DIGESTS = {
    "Apache-2.0": [
        "045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847",
        "108490d21e2d3edc9128233e48fabc169818d0c7c5f0bbdd58231a367d2d6c87",
        "6ed232a1aaf66db92997c53c056b853f2a64b9f74585489f71cbae1bb4d6d166",
        "dd44101c8dda66bcebdc448ec6b0f0d4c73a1b6a3632b2637d6e4b2dd366e673",
    ],
    "Artistic-1.0-Perl": [
        "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    ],
    "CC0-1.0": [
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ],
    "GFDL-1.2": [
        "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",
        "1dbd72b6f124a1058e786b52a9d4afe44543b834a3aa44faf6c18b747c9de8e2",
        "280f2c9262681762983ac60a9d767e5ef5d719ef873d9b5d1483e3e0f8db7d32",
    ],
    "GFDL-1.3": [
        "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",
        "69b1562ff580444d989903cc5dc355ef6948c841d68d3e769a05a177559c5088",
        "911b9e1b02471fa9b19ec482d019380acd7e0fef00ffbd4395e8813b06533fe7",
    ],
    "GPL-1.0": [
        "37dc6b6af4e1acc5f08626e546a8e0b0241a02f6b373c62c94d25813d53ba5dc",
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
        "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",
        "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    ],
    "GPL-2.0": [
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
        "d448f7c42927e45c53fc6facc1632231421d30e7b50089821d834bce9a858bf2",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    ],
    "GPL-3.0": [
        "0d69d798e3e7de1a47a4394344dbb4f4f5fca5f845ec7b4c46af9a5c57af3b74",
        "3c7dd1dab9b12497c332318fc0edfdef5dfe1e9c0deca666be888aaab64b125d",
        "5fc5b48e8eeed6e5e77c32ad8641a6bc04d25011d6b500aa7dc7f3183ab812ea",
        "7e1ec759902e79fd98df32aeafb56e0fcc9348cebf7b52c7a875052ac012ad4a",
    ],
    "LGPL-2.0": [
        "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
        "6868b4a13dbc6350929749b46cfddc103d776960817bfb7dddba42cd02baca57",
    ],
    "LGPL-2.1": [
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
        "f0969de5e18619549553d207857aaf3b90b666aaf16cc32e41aab62324604dcd",
    ],
    "LGPL-3.0": [
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ],
    "MPL-1.1": [
        "0209c3e2a79c067a31e55c6912798d6df3b44d5a7d6ce82c3a8f0259c6eeb17f",
        "7fd2ba09350b32b984ddf731a1ddb0510c78a34df3a991edb94025d311fc434f",
        "ac6e9e73a17bbcb0775e7aa81f09a979e111e8a5145dfcb8aacc6c2ad0e9b31d",
        "b65bce84d4a1b96cee0c508f81d5b3746b150dbc0698bf18afa361bbbac08be3",
        "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6",
        "f8d73be44dfbd3d49e2f4d880da7f8d7957d77f6b52eee7b538bdf28cbcf66e3",
        "fb84cdb331a381edd811d3017d5400ac2c74d9d8470038f79413ac78b10c2a59",
    ],
    "MPL-2.0": [
        "2cec6f733aa157c2d0b72e9669f75ca354f332218fcb5a3a885931f385272a04",
        "90bbb5299b0da877b2cc3e8c12ef9a267077f6aafd0809379195b536046ebc17",
        "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
    ],
}
# Names by SPDX id. Each is also known with `License` after it.
NAMES = {
    "MIT": ["MIT", "Expat"], "ISC": ["ISC"], "0BSD": ["Zero-Clause BSD", "BSD Zero Clause"], "BSD-2-Clause": ["BSD 2-Clause", "2-Clause BSD", "Simplified BSD"], "BSD-3-Clause": ["BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache 2", "ASL 2.0", 'Apache License, Version 2.0 (the "License")'], "MPL-1.1": ["Mozilla Public License, version 1.1", "Mozilla Public License 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"], "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "EPL 1.0"], "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic 2.0"], "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"], "Zlib": ["zlib"], "Unlicense": ["Unlicense"], "WTFPL": ["WTFPL"], "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
}
# The GNU licences, their versions, and the parts of Creative Commons licences.
GNU = {"GPL": ("GNU General Public License", ["1.0", "2.0", "3.0"]), "LGPL": ("GNU Lesser General Public License", ["2.1", "3.0"]), "AGPL": ("GNU Affero General Public License", ["3.0"]), "GFDL": ("GNU Free Documentation License", ["1.2", "1.3"])}
CC_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
CC_KINDS, CC_VERSIONS = ["BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"], ["1.0", "2.0", "2.5", "3.0", "4.0"]
# Spellings and what they stand for, in lower case.
SPELLINGS = {"licence": "license", "acknowledgement": "acknowledgment", "favour": "favor", "organisation": "organization", "sub-license": "sublicense", "sub license": "sublicense", "non-commercial": "noncommercial", "merchantibility": "merchantability", "https://": "http://"}
#: The word before these states no copyright: it gets a mark that canonical text turns into a space again.
NO_STATEMENT = r"copyright (notice|holder|law|interest|owner|license|and )"
#: A line that starts by stating a copyright: (c), the sign or the word, and a year, a holder or nothing after it. Of the
#: flags that Java needs and others don't know, `d` makes the line feed the only end of a line.
COPYRIGHT = r"^[ \t/*#;%-]*(?:copyright(?:[^a-z0-9_\n][^\n]*)?|\(c\) [^\n]*|©[^\n]*|all rights reserved\.?[ \t]*)$"
OTHERS = r"[^\p{L}\p{N}\n]+"
#: How a line says under which licence something is; on canonical lines. All of it stands for `under`.
UNDER = r"^ ?(?:(?:this|the|all|our) (?:[a-z]+ )?[a-z]+ (?:is|are) |it is )?(?:(?:dual )?licensed|released|distributed|published|available|made available|provided) under (?:the terms of )?(?:the |an? )?"
SPDX = r"^ ?spdx license identifier "


def notice_names() -> dict[str, list[str]]:
    """What licences are called after `under`, by SPDX id."""
    out = {k: [*v, *(f"{x} License" for x in v if "License" not in x)] for k, v in NAMES.items()}
    for short, (name, versions) in GNU.items():
        for v in versions:
            for number in {v, v.removesuffix(".0")}:
                plain = [f"{n} {how}{number}" for n in (name, name.removeprefix("GNU "), f"GNU {short}", short) for how in ("", "v", "version ", "v. ")]
                for later, end in (("-only", ["", " only"]), ("-or-later", [" or later", " or any later version", " or at your option any later version"])):
                    out.setdefault(f"{short}-{v}{later}", []).extend(p + e for p in plain for e in end)
    for kind in CC_KINDS:
        parts = [CC_PARTS[p] for p in kind.split("-")]
        for v in CC_VERSIONS:
            long = [f"Creative Commons {'-'.join(parts)} {v}", f"Creative Commons {' '.join(parts)} {v}"]
            out[f"CC-{kind}-{v}"] = [f"CC {kind} {v}", f"CC-{kind}-{v}", *(x + e for x in long for e in ("", " International", " International License", " License", " Unported License"))]
    return out


def canonical_lines(text: Column) -> Column:
    """Canonical text with its line breaks."""
    c = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NO_STATEMENT, "copyright_$1")
    c = F.regexp_replace(c, "(?md)" + COPYRIGHT, "")
    for k, v in SPELLINGS.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.regexp_replace(c, OTHERS, " ")


def one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def notice_lines(lines: Column) -> Column:
    """Canonical lines, with what says `under` made one."""
    return F.regexp_replace(F.regexp_replace(lines, "(?md)" + UNDER, "under "), "(?md)" + SPDX, "spdx ")


def known_texts() -> list[tuple[str, str]]:
    """Licence and text, with each title that it may have and without one."""
    bodies = {k: t if k == "Unlicense" else t.split("\n", 1)[1] for k, t in LICENCES.items()}
    return [(k, f"{title}\n{t}" if title else t) for k, t in bodies.items() for title in ["", *TITLES[k]]]


def known_notices() -> list[tuple[str, str]]:
    """Licence and notice."""
    return [(k, f"under {n}") for k, names in notice_names().items() for n in names] + [(k, f"spdx {x}") for k in notice_names() for x in {k, k.removesuffix("-only"), k.replace("-or-later", "+")}]


def known_digests(spark: SparkSession) -> DataFrame:
    """license_id and digest of the whole texts that this module knows."""
    texts = spark.createDataFrame(known_texts(), "license_id string, text string").select("license_id", F.sha2(one_line(canonical_lines(F.col("text"))), 256).alias("digest"))
    return texts.unionByName(spark.createDataFrame([(k, d) for k, ds in DIGESTS.items() for d in ds], "license_id string, digest string"))


def _notice_ids(spark: SparkSession) -> dict[int, str]:
    """SPDX id by hash of a notice's canonical line; the smaller id where two share it."""
    rows = spark.createDataFrame(known_notices(), "id string, text string").select("id", F.xxhash64(one_line(canonical_lines(F.col("text")))).alias("line"))
    return {r["line"]: r["id"] for r in rows.groupBy("line").agg(F.min("id").alias("id")).collect()}


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, canonical_sha256, license_id (of the whole text, else null), notices (sorted ids of notice lines) and
    n_notice_lines for every document. known: license_id and digest of other whole texts than known_digests has."""
    spark = docs.sparkSession
    known = known_digests(spark) if known is None else known.limit(KNOWN_ROWS + 1)
    if known.count() > KNOWN_ROWS:
        raise ValueError(f"more than {KNOWN_ROWS} known licences")
    table = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    lines = docs.select(F.col("doc_id"), canonical_lines(F.col("text")).alias("lines"))
    # a set of hashes decides for each line; only the few that are in it are looked up
    ids = _notice_ids(spark)
    names = F.create_map(*[F.lit(x) for k in sorted(ids) for x in (k, ids[k])])
    hashed = F.transform(F.split(notice_lines(F.col("lines")), "\n"), lambda x: F.xxhash64(F.trim(x)))
    found = F.transform(F.filter(hashed, lambda h: h.isin(sorted(ids))), lambda h: F.try_element_at(names, h))
    digested = lines.select("doc_id", F.sha2(one_line(F.col("lines")), 256).alias("digest"), found.alias("found"))
    out = digested.join(F.broadcast(table), "digest", "left")
    return out.select("doc_id", F.col("digest").alias("canonical_sha256"), "license_id", F.array_sort(F.array_distinct("found")).alias("notices"), F.size("found").cast("long").alias("n_notice_lines"))


def scan_sql(table: str = "documents") -> str:
    """What scan gives, as DuckDB SQL: the same constants, and none of Spark's functions."""
    q = lambda x: "'" + x.replace("'", "''") + "'"

    def canonical(x: str) -> str:
        c = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), {q(NO_STATEMENT)}, 'copyright_\\1', 'g'), {q('(?m)' + COPYRIGHT)}, '', 'g')"
        for k, v in SPELLINGS.items():
            c = f"replace({c}, {q(k)}, {q(v)})"
        return f"regexp_replace({c}, {q(OTHERS)}, ' ', 'g')"

    one = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"
    notice = lambda x: f"regexp_replace(regexp_replace({x}, {q('(?m)' + UNDER)}, 'under ', 'g'), {q('(?m)' + SPDX)}, 'spdx ', 'g')"
    values = lambda rows: ", ".join(f"({q(a)}, {q(b)})" for a, b in rows)
    return f"""
        WITH known AS (
            SELECT digest, min(id) AS license_id FROM (
                SELECT id, sha256({one(canonical("x"))}) AS digest FROM (VALUES {values(known_texts())}) t(id, x)
                UNION ALL SELECT id, digest FROM (VALUES {values((k, d) for k, ds in DIGESTS.items() for d in ds)}) t(id, digest)) GROUP BY digest),
        named AS (SELECT {one(canonical("x"))} AS line, min(id) AS id FROM (VALUES {values(known_notices())}) t(id, x) GROUP BY 1),
        d AS (SELECT doc_id, {canonical("text")} AS lines FROM {table}),
        l AS (SELECT doc_id, unnest(string_split({notice("lines")}, chr(10))) AS line FROM d),
        m AS (SELECT doc_id, list_sort(list_distinct(list(id))) AS notices, count(*) AS n FROM l JOIN named ON trim(l.line) = named.line GROUP BY doc_id)
        SELECT d.doc_id, sha256({one("lines")}) AS canonical_sha256, license_id, coalesce(notices, CAST([] AS VARCHAR[])) AS notices, coalesce(n, 0) AS n_notice_lines
        FROM d LEFT JOIN known ON known.digest = sha256({one("lines")}) LEFT JOIN m USING (doc_id)"""
