import re
import textwrap

from oracle import rows_of, sql_rows

from tidelake.llm.licenses import ALLOWED, KNOWN, scan, texts
from tidelake.llm.queries import licenses_planted, op5_licenses
from tidelake.llm.sql import licenses_sql


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = rows_of(op5_licenses(spark, sf))
    assert got == sql_rows(licenses_sql(), sf)
    assert any("GPL-3.0" in r for r in got[1]) and any("MIT" in r for r in got[1])


def test_planted_texts_same_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    rows = licenses_planted(spark, sf)
    got = rows_of(rows)
    assert got == sql_rows(licenses_sql(planted=True), sf)
    found = {r.license for r in rows.collect()}
    assert found >= {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "Artistic-1.0-Perl", "LGPL-3.0", None}


def scanned(spark, rows):
    got = {r.doc_id: r for r in scan(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(4)).collect()}
    return [got[i] for i in range(len(rows))]


def test_cases(spark):
    mit = KNOWN[-1][1]
    texts = [
        mit,
        "The title\n" + mit,
        "Copyright (c) 2024 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-license").replace(",", " ,"),
        "(c) Me\nall rights reserved\n" + mit.replace("License", "Licence", 1),
        None,
        "",
        " \n--\n",
        "Some words.\nLicensed under CC BY-NC 4.0.\nMore.\nReleased under the MIT licence!",
        "Released under the MIT License but not quite.",
        "é " * 50_000,
        "MIT License\n\nCopyright (c) 2024 Someone\n",
        "\n" * 100 + mit,
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x")], "doc_id long, text string, license string")
    rows = scan(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 1
    assert [got[i].license for i in range(4)] == ["MIT", None, "MIT", "MIT"] and got[0].digest == got[2].digest
    assert all(got[i].digest is None and got[i].notices == "" and not got[i].restricted for i in (4, 5, 6, 10))
    assert got[7].notices == "CC-BY-NC-4.0,MIT" and got[7].restricted and not got[0].restricted and got[11].license == "MIT"
    assert got[8].notices == "" and scan(docs.limit(0)).count() == 0
    assert sorted(map(repr, scan(docs, most=3).collect())) == sorted(map(repr, rows))  # the other way to join
    none = scan(docs, spark.createDataFrame([], "license string, text string")).collect()
    assert len(none) == len(rows) and not any(r.license or r.notices or r.restricted for r in none)


def paragraphs(text):
    return [" ".join(p.split()) for p in re.split(r"\n\s*\n", text.strip())]


def forms(text):
    """The text at other widths, with one line a paragraph or in all, other line ends, statements in front."""
    out = {"as it is": text, "crlf": text.replace("\n", "\r\n"), "upper": "Copyright 2020-2024 Some One <a@b.org>\n" + text.upper()}
    for width in (50, 60, 80, 100, 10**9):
        out[f"width {width}"] = "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in paragraphs(text))
    out["one line"] = " ".join(text.split())
    out["holder"] = "Copyright (c) 2024, Some Holder & Co., Inc.\nAll rights reserved.\n\n" + text
    return out


ENTIRE = [x for x in KNOWN if "\n" in x[1]] + texts()


def test_entire_texts_in_all_forms(spark):
    want = {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-SA-4.0", "Zlib", "BSL-1.0", "Artistic-1.0-Perl", "MIT", "ISC", "0BSD"}
    assert want <= {name for name, _ in ENTIRE}
    made = [(name, form, t) for name, text in ENTIRE for form, t in forms(text).items()]
    got = scanned(spark, [t for _, _, t in made])
    assert [(n, f) for (n, f, _), r in zip(made, got, strict=True) if r.license != n or r.restricted != (n not in ALLOWED)] == []


def test_titles_and_holders(spark):
    mit, isc = KNOWN[-1][1].split("\n", 1)[1], KNOWN[8][1].split("\n", 1)[1]
    bsd = dict(texts())["BSD-2-Clause"].split("\n", 1)[1]
    apache = dict(reversed(texts()))["Apache-2.0"]
    made = [
        ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2015 A. B.\n\n" + mit),
        ("MIT", mit),
        ("MIT", "Copyright © 2015 A. B.\n" + mit),
        ("MIT", "MIT License Copyright (c) 2015 Some One " + " ".join(mit.split())),
        ("ISC", isc),
        ("ISC", "Copyright 2001, 2003 A\nCopyright 2004 B\n\n" + isc),
        ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2020, Me\nAll rights reserved.\n" + bsd),
        ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2021 The Example Authors")),
        (None, "Copyright (c) 2015 A. You may not use this at all.\n" + mit),
        (None, mit + "\nCopyright (c) 2015 A. B.\n"),
        (None, apache.replace("(c) You must retain", "(c) You need not retain")),
    ]
    got = scanned(spark, [t for _, t in made])
    assert [r.license for r in got] == [n for n, _ in made]


def test_one_changed_word_in_a_clause_loses_the_licence(spark):
    """In every paragraph of the terms, a word in its middle."""
    made = []
    for name, text in ENTIRE:
        ps = paragraphs(text)
        for i, p in enumerate(ps):
            words = p.split()
            if len(words) >= 12 and "opyright" not in p:
                k = len(words) // 2
                k = next(j for j in range(k, len(words)) if re.search("[a-z]", words[j].lower()))
                made.append((name, "\n\n".join([*ps[:i], " ".join([*words[:k], "xyzzy", *words[k + 1 :]]), *ps[i + 1 :]])))
    got = scanned(spark, [t for _, t in made])
    assert len(made) > 500 and [n for (n, _), r in zip(made, got, strict=True) if r.license] == []
