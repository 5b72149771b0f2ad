"""Licences found whatever their layout; other texts by digest only."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillcheck.llm import licenses


def rows(docs, **kw):
    return {(r.doc_id): (r.license, r.notices, r.digest) for r in licenses.licensed(docs, **kw).collect()}


def test_layouts(docs_of):
    mit, bsd = licenses.TEXTS["MIT"], licenses.TEXTS["BSD-3-Clause"]
    wrapped = "\n".join(" ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9))
    texts = {
        1: mit, 2: mit.upper(), 3: "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + wrapped, 4: mit.replace("MIT License", "MIT Licence").replace('"', "“"), 5: mit + "\nmore",
        6: bsd.replace("HOLDERS", "OWNERS").replace("HOLDER ", "OWNER "), 7: None, 8: "", 9: "© 2021 me", 10: "text\n# Released under the MIT License.\nLicensed under CC BY-NC 4.0\nAll rights reserved", 11: "--- !!",
    }
    docs = docs_of([*texts.items(), (None, mit), (12, mit), (12, mit)]).selectExpr("*", "'x' AS license", "1 AS digest")
    found = rows(docs)
    assert [found[i][0] for i in (1, 2, 3, 4, 5, 6, None, 12)] == ["MIT", "MIT", "MIT", "MIT", None, "BSD-3-Clause", "MIT", "MIT"]
    assert found[7] == found[8] == found[11] == (None, "", None) and found[9][2] is None
    assert found[10][1] == "CC-BY-NC-4.0,LicenseRef-Proprietary,MIT" and found[10][0] is None and found[10][2]
    assert licenses.licensed(docs).count() == 14 and licenses.licensed(docs_of([])).collect() == []


def test_every_known_text_is_told_apart(spark, docs_of):
    names = list(licenses.TEXTS)
    found = rows(docs_of([(i, licenses.TEXTS[n]) for i, n in enumerate(names)]))
    assert [found[i][0] for i in range(len(names))] == names


def test_whole_table(sample_docs):
    found = licenses.licensed(sample_docs).collect()
    assert len(found) == sample_docs.count() and len({r.digest for r in found}) > 100 and any(r.notices for r in found)


def test_notices_in_other_words(docs_of):
    want = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under the GNU General Public License v3.0": "GPL-3.0",
        "# This program is distributed under the terms of the GNU General Public License, version 2 or later.": "GPL-2.0",
        "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
        "This software is released under the GNU LGPL v2.1": "LGPL-2.1",
        "Released under the GPLv3": "GPL-3.0",
        "Licensed under the Mozilla Public License, v. 2.0": "MPL-2.0",
        "Licensed under the BSD 2-Clause Licence": "BSD-2-Clause",
        "This work is released under CC0 1.0 Universal": "CC0-1.0",
        "This work is licensed under a": "",
        "This work is licensed under the GNU General Public License, version 3.1": "",
        "This project is licensed under the Apache License 2.0": "Apache-2.0",
        "This work is licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    }
    found = rows(docs_of([(i, f"Some text\n{line}\nmore") for i, line in enumerate(want)]))
    assert [found[i][1] for i in range(len(want))] == list(want.values())


def test_full_public_texts(docs_of):
    folder = Path("/usr/share/common-licenses")
    want = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    here = {f: name for f, name in want.items() if (folder / f).exists()}
    if not here:
        pytest.skip("no folder of licences")
    texts = [(folder / f).read_text() for f in here]
    found = rows(docs_of([*enumerate(texts), *((100 + i, t.upper().replace("\n", "\n\n  ")) for i, t in enumerate(texts)), (200, texts[0] + "\nmore")]))
    assert [found[i][0] for i in range(len(texts))] == [found[100 + i][0] for i in range(len(texts))] == list(here.values())
    assert found[200][0] is None


def test_every_notice_can_be_named(spark):
    """No known notice is kept out by the hints, and lines that many documents share are found in each."""
    rows = [(v,) for vs in licenses.NOTICES.values() for v in vs]
    lines = spark.createDataFrame(rows, "line string").select(licenses.canonical(F.col("line")).alias("line"))
    assert lines.where(~licenses._may_name(F.col("line"))).count() == 0 and len(rows) > 30_000


def test_own_table_of_licences(spark, docs_of):
    mine = spark.createDataFrame([("Mine", "notice", hashlib.sha256(b"do as you like").hexdigest())], "license string, kind string, digest string")
    docs = docs_of([(i, f"text {i}\nDo, as you like!") for i in range(300)] + [(300, "nothing")])
    found = rows(docs, licenses=mine)
    assert {found[i][1] for i in range(300)} == {"Mine"} and found[300][1] == ""
