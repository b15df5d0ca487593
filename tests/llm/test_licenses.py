"""Licence scan: canonical forms, whole texts and lines."""

from shopledger.llm import licenses


def scan(spark, rows, known=None):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as lines", "2 as digest")
    found = licenses.license_scan(df, known if known is not None else licenses.known_texts(spark))
    return sorted(
        ((r.doc_id, r.text_licenses, r.line_licenses, r.n_lines) for r in found.collect()),
        key=lambda r: (r[0] is None, r[0] or 0),
    )


def test_variants_of_whole_texts(spark):
    mit = licenses.KNOWN["MIT"][0]
    wrapped = "\n".join(line.strip() for line in mit.replace(", ", ",\n").split("\n"))
    rows = [
        (1, "MIT\n" + mit),  # a title is no part of the text
        (2, "Copyright (c) 2019, 2021 Some One\nAll rights reserved.\n\n" + wrapped.upper()),
        (3, "# " + mit.replace("\n", "\n# ").replace("sublicense", "sub-license")),
        (4, mit.replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("HOLDERS", "OWNERS")),
        (5, mit + " More."),
        (6, "© [year] <name>\n" + licenses.KNOWN["BSD-2-Clause"][0].replace('"AS IS"', "``AS IS''")),
        (7, licenses.KNOWN["BSD-3-Clause"][0]),
    ]
    assert [r[1] for r in scan(spark, rows)] == [
        [], ["MIT"], ["MIT"], ["MIT"], [], ["BSD-2-Clause"], ["BSD-3-Clause"],
    ]


def test_lines(spark):
    rows = [
        (1, "Some words.\nRELEASED under the mit licence!!\nMore words.\nLicensed under CC BY-NC 4.0"),
        (1, "Licensed under the Apache License, Version 2.0."),
        (2, "released under the MIT"),
        (3, "Released under the MIT License."),
    ]
    assert scan(spark, rows) == [
        (1, ["Apache-2.0"], ["Apache-2.0", "CC-BY-NC-4.0", "MIT"], 3),
        (2, [], [], 0),
        (3, ["MIT"], ["MIT"], 1),
    ]


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n.\n"), (None, "Released under the MIT License."),
            (4, "word " * 50_000), (5, "© 2020"), (5, "© 2020")]
    assert scan(spark, rows) == [
        (1, [], [], 0), (2, [], [], 0), (3, [], [], 0), (4, [], [], 0), (5, [], [], 0),
        (None, ["MIT"], ["MIT"], 1),
    ]
    assert scan(spark, []) == []
    known = spark.createDataFrame([("A", "..."), ("B", None)], "license_id string, text string")
    assert scan(spark, rows, known)[0] == (1, [], [], 0)


def test_titled_and_bulleted_texts(spark):
    short = {name: licenses.KNOWN[name][0] for name in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause")}
    owner = "\n\nCopyright (c) 2020, Some One\nAll rights reserved.\n\n"
    bsd = short["BSD-3-Clause"]
    rows = [
        (1, "MIT License" + owner + short["MIT"]),
        (2, "The MIT License (MIT)" + owner + short["MIT"]),
        (3, "ISC License" + owner + short["ISC"]),
        (4, "BSD 2-Clause License" + owner + short["BSD-2-Clause"]),
        (5, "BSD 3-Clause License" + owner + bsd),
        (6, bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")),
        (7, "BSD 3-Clause License" + owner + bsd.replace("1. ", "- ").replace("2. ", "- ").replace("3. ", "- ")),
        (8, "BSD 2-Clause License" + owner + bsd),  # the title of another licence
        (9, "BSD Zero Clause License" + owner + short["0BSD"]),
    ]
    assert [r[1] for r in scan(spark, rows)] == [
        ["MIT"], ["MIT"], ["ISC"], ["BSD-2-Clause"], ["BSD-3-Clause"], ["BSD-3-Clause"],
        ["BSD-3-Clause"], [], ["0BSD"],
    ]


def test_whole_long_texts(spark):
    folder = licenses.files("shopledger.llm").joinpath("known_licenses")
    texts = {name: folder.joinpath(f"{name}.txt").read_text() for name in licenses.LONG}
    apache = texts["Apache-2.0"]
    rows = [(k, " ".join(text.split(" "))) for k, text in enumerate(texts.values())]
    rows += [
        (10, apache.split("APPENDIX")[0]),
        (11, apache.replace("[yyyy] [name of copyright owner]", "2021 Some One")),
        (12, texts["GPL-3.0"].replace("https", "http").replace("\n", "\r\n")),
        (13, texts["MPL-2.0"][:-200]),
    ]
    found = scan(spark, rows)
    assert [r[1] for r in found[:7]] == [[name] for name in licenses.LONG]
    assert [r[1] for r in found[7:]] == [["Apache-2.0"], ["Apache-2.0"], ["GPL-3.0"], []]

# Heads of licence files, written apart from the module, and whether a licence text is found behind.
HEADS = [
    ("Copyright (c) The Foo Authors", True),
    ("Portions Copyright (c) 2001 B", True),
    ("Copyright (c) 2019 The Regents of the University\nof California", True),
    ("Copyright 1998 by A,\n  B, and\n  the C company\n  of D", True),
    ("(c) 2003 A", True),
    ("© The Foo Authors. 2010", True),
    ("Copyright © Foo", True),
    ("// Copyright (C) 2015-2020 A <a@b.c>\n// Parts Copyright (C) 2014 B", True),
    ("All rights reserved.", True),
    ("Copyright (c) 2020 A\n\nAll Rights Reserved", True),
    ("Copyright notices are kept below", False),
    ("This is by A", False),
    ("Written by A\nCopyright (c) 2020 A", False),
]


def test_heads_of_licence_texts(spark):
    mit = licenses.KNOWN["MIT"][0]
    rows = [(k, f"{head}\n\n{mit}") for k, (head, _) in enumerate(HEADS)]
    rows += [(100, f"Copyright (c) 2020 A\n{mit}"), (101, f"MIT License\n\nCopyright (c) A\nand others\n\n{mit}")]
    rows += [(102, "Copyright (c) 2020 A\n" + "more\n" * 20_000 + f"\n{mit}")]
    found = {r[0]: r[1] for r in scan(spark, rows)}
    assert {k: bool(found[k]) for k in range(len(HEADS))} == {k: ok for k, (_, ok) in enumerate(HEADS)}
    assert found[100] == found[101] == found[102] == ["MIT"]


def test_known_digests_were_worked_out_apart(spark):
    """The list the SQL uses is the table of this module, by another program's patterns."""
    text = licenses.files("shopledger.llm").joinpath("known_licenses", "digests.txt").read_text()
    forms = licenses.known_texts(spark).select("license_id", licenses.canonical_lines(licenses.F.col("text")).alias("x"))
    digest = licenses.F.sha2(licenses._spelled(licenses.F.array_join("x", " ")), 256)
    rows = forms.select("license_id", digest.alias("d")).distinct().collect()
    assert sorted(f"{r.license_id} {r.d}" for r in rows) == sorted(text.splitlines())
