"""Licence texts by canonical digest: two texts with the same digest say the same, whatever their layout.

A line is made canonical by case, punctuation and spelling; copyright lines are left out of a whole text. Whole texts
(and, for notices, single lines) are hash-joined to the digests of a table of known licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.session import settled

# Words that count as equal, rarer spelling first.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "acknowledgement": "acknowledgment",
    "organisation": "organization", "authorised": "authorized", "favour": "favor", "honour": "honor", "programme": "program",
    "merchantibility": "merchantability", "noninfringement": "non infringement", "redistributions": "redistribution", "owner": "holder", "owners": "holders",
    "whilst": "while", "fulfil": "fulfill", "judgement": "judgment", "behaviour": "behavior", "centre": "center",
}
COPYRIGHT = r"^[^\p{L}\p{N}©]*(?:copyright\b|\(c\)|©|all rights reserved)"

# Public licence texts and the one-line notices that stand for them.
_GRANT = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = {
    "MIT": f"""MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
{_GRANT}
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
}
# Canonical digests of the full public texts, as Debian has them; with and without what follows the terms.
DIGESTS = {
    "Apache-2.0": ("ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b", "98378616989e23431b15181388a001fdeac0999db741918e302c5162392bcfbd", "23c0498e738b86da84fa1ffb1ff43f4ef103f365367077ada18cd1db1813d6da",),
    "Artistic-1.0-Perl": ("f7fec2048e2502b8b653a12ac095bcb0601f72bbd1d535b2e8adf8e097d2f915",),
    "BSD-3-Clause": ("5b0f89b350aa652155e5991e00ac2a54363087be92803e07df14f4b0f0bd283e",),
    "CC0-1.0": ("de4b88a2c819a4661af54f735069ed878216da8b4992b919b84afa18cfc0e54c",),
    "GFDL-1.2": ("f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86",),
    "GFDL-1.3": ("80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb",),
    "GPL-1.0": ("9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",),
    "GPL-2.0": ("b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017",),
    "GPL-3.0": ("5272fb2d9117cba4ebb1b4a6612e61ab05ddddeff56bd30c3ac3798e23821b30", "f7bb29d9a31c3a1a68ccff0d8d9053350dc0b10b52b62d46d0f2e36a41e32975", "f37d587507fc579524cb06d1130d5899891a978ee008cfc033b3b4d95da28bee",),
    "LGPL-2.0": ("96685b4d8003c3671feddcde58622afa814a3ac15dcc419f38b388aff5e16d1d", "a07313094d4e63b099417491ebc80c933bf85c36d5afddbf13be9a11457c8513", "a745f6517e6dd821b7e0352067dcf8f32789a02694b661bfad965280370e9b1a",),
    "LGPL-2.1": ("22bd2802b7b313faf9750f494c8f07c9eaa0e00ba5b9f7a300e8fa36cfd1319e", "bfe8e5dc6cef43d0c4777d9c1891f596159cda682ef40545ad2105f66b9746f1", "4656c6936fdab5334aa4c4800c6a7881ffce24f3abb1f578c24da0bbb2735d0a",),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("1cfb6cca26abe2169c9c61164807107b2d4a0b64955a2cf2de46fad3483acda1",),
    "MPL-2.0": ("95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",),
}
_SAID = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT"),
    "BSD-3-Clause": ("SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    "GPL-3.0": ("SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GNU General Public License v3.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "LicenseRef-Proprietary": ("All rights reserved",),
}
_GNU = {"GPL": ("GNU General Public License", ("1.0", "2.0", "3.0")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3.0")), "AGPL": ("GNU Affero General Public License", ("3.0",)), "GFDL": ("GNU Free Documentation License", ("1.2", "1.3"))}
_NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License, Version 2", "Apache License 2.0", "Apache License v2.0", "Apache License v2", "Apache 2.0 License", "Apache 2.0", "Apache-2.0 License"),
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License", "ISC"),
    "0BSD": ("Zero-Clause BSD License", "BSD Zero Clause License", "0BSD License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause", "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"),
    "Zlib": ("zlib License",),
    "WTFPL": ("WTFPL",),
    "MPL-1.1": ("Mozilla Public License, version 1.1", "Mozilla Public License, v. 1.1", "Mozilla Public License v1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License, version 2", "Mozilla Public License, v. 2.0", "Mozilla Public License v2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL v2.0"),
    "LGPL-2.0": ("GNU Library General Public License, version 2", "GNU Library General Public License, version 2.0", "GNU Library General Public License v2", "LGPL-2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0 License"),
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial"}
_LEADS = ("", "This work is ", "This software is ", "This program is ", "This project is ", "This document is ", "This file is ")
_VERBS = ("Licensed under ", "Released under ", "Distributed under ")
_TERMS = ("", "the ", "the terms of the ")


def _notices() -> dict[str, tuple[str, ...]]:
    """The lines that name a licence: every lead, verb and name, versions written in the usual ways, and SPDX lines."""
    names, said = {k: list(v) for k, v in _NAMES.items()}, {k: list(v) for k, v in _SAID.items()}
    for short, (full, versions) in _GNU.items():
        for v in versions:
            numbers = [v] + ([v[:-2]] if v.endswith(".0") else [])
            plain = [f"{n}{sep}{x}" for n in (full, f"GNU {short}", short) for sep in (" version ", " v", " ") for x in numbers] + [f"{short}v{x}" for x in numbers]
            names[f"{short}-{v}"] = [p + end for p in plain for end in ("", " or later", " or any later version", " only")]
    for short, full in _CC.items():
        long = f"Creative Commons {full} 4.0"
        names[f"CC-{short}-4.0"] = [f"CC {short} 4.0", f"{long} International License", f"{long} International", f"{long} License", long]
    for k, plain in names.items():
        spdx = [k] + ([f"{k}-only", f"{k}-or-later", f"{k}+"] if k.split("-")[0] in _GNU else [])
        said[k] = [*said.get(k, ()), *(f"SPDX-License-Identifier: {x}" for x in spdx), *(lead + verb + term + p for lead in _LEADS for verb in _VERBS for term in _TERMS for p in plain)]
    return {k: tuple(dict.fromkeys(v)) for k, v in said.items()}


NOTICES = _notices()
HINTS = "license|licensed under|released under|distributed under|reserved"
MOST_BROADCAST = 200_000  # known notices, about 100 bytes each, that every executor may hold


def canonical(line: Column) -> Column:
    """Lower case, runs of other signs than letters and digits as one blank, one spelling of each word."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(line), F.lit(r"[^\p{L}\p{N}]+"), F.lit(" ")), F.lit(" "))
    for rare, usual in SPELLINGS.items():
        words = F.replace(words, F.lit(f" {rare} "), F.lit(f" {usual} "))
    return F.trim(words)


def _lines(text: Column) -> Column:
    """(canonical, whether it is a copyright line) of each line with a word."""
    each = F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), lambda x: F.struct(canonical(x).alias("line"), F.lower(x).rlike(COPYRIGHT).alias("copyright")))
    return F.filter(each, lambda x: x["line"] != "")


def _may_name(line: Column) -> Column:
    """Whether a canonical line can be one of ``NOTICES``: each of them has one of these."""
    return line.rlike(HINTS)


def _whole(lines: Column) -> Column:
    said = F.array_join(F.transform(F.filter(lines, lambda x: ~x["copyright"]), lambda x: x["line"]), " ")
    return F.when(said != "", F.sha2(said, 256))


def known(spark: SparkSession, texts: dict[str, str] | None = None, notices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(license, kind, digest) of known licences: kind ``text`` or ``notice``."""
    rows = [(k, "text", v) for k, v in (TEXTS if texts is None else texts).items()]
    rows += [(k, "notice", v) for k, vs in (NOTICES if notices is None else notices).items() for v in vs]
    t = spark.createDataFrame(rows, "license string, kind string, text string").withColumn("lines", _lines(F.col("text")))
    line = F.sha2(F.get("lines", F.lit(0))["line"], 256)
    t = t.select("license", "kind", F.when(F.col("kind") == "text", _whole(F.col("lines"))).otherwise(line).alias("digest")).where("digest IS NOT NULL")
    if texts is None:
        t = t.union(spark.createDataFrame([(k, "text", d) for k, ds in DIGESTS.items() for d in ds], "license string, kind string, digest string"))
    return t.distinct()


def licensed(docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license and notices of every row.

    ``digest``: of the whole canonical text, null where it has no words but copyright lines; ``license``: the known
    licence with that digest (the least name, if several); ``notices``: the licences that lines of the text name, each
    once, sorted, comma-joined, empty if none. A null text is like an empty one; a null doc_id stays; repeated rows
    give repeated results; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    own = licenses is None
    licenses = settled(known(spark) if own else licenses.select("license", "kind", "digest"), "licences")
    texts = licenses.where("kind = 'text'").groupBy("digest").agg(F.min("license").alias("license"))
    notices = licenses.where("kind = 'notice'").groupBy("digest").agg(F.min("license").alias("license"))
    if licenses.count() <= MOST_BROADCAST:
        texts, notices = F.broadcast(texts), F.broadcast(notices)
    d = docs.select(F.col(id_col).alias("doc_id"), _lines(F.col(text_col)).alias("lines"))
    lines = F.filter("lines", lambda x: _may_name(x["line"])) if own else F.col("lines")
    d = d.select("doc_id", _whole(F.col("lines")).alias("digest"), F.array_distinct(F.transform(lines, lambda x: F.unhex(F.sha2(x["line"], 256)))).alias("each"))
    # Texts are read once: what is left of them is written, a number to each row, and numbers can't change any more
    d = settled(d.withColumn("row", F.monotonically_increasing_id()), "digests")
    named = d.select("row", F.explode("each").alias("line")).withColumn("digest", F.lower(F.hex("line"))).join(notices, "digest")
    named = named.groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))  # of one text
    d = d.select("row", "doc_id", "digest").join(texts, "digest", "left").join(named, "row", "left")
    return d.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))
