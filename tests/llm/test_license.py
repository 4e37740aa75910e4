import re
import textwrap
from collections import Counter

from odd import ROWS, no_documents, odd_documents
from replysift.llm import license_scan as ls

MIT, ISC = ls.KNOWN[0][1], ls.KNOWN[1][1]


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in ls.scan_licenses(df).collect()}


def test_whole_texts(spark):
    texts = [
        MIT, MIT.upper(), "Copyright (c) 2019 Some One\n\n" + MIT.replace(",", " ,").replace("\n", "\n\n"),
        "(c) 2020 X\n© Y\n" + ISC, MIT.replace("sublicense", "sub-license"), MIT + " Extra words.", MIT.replace("free of charge", "for a fee"),
        "copyrighted works\n" + MIT, "", "Copyright only",
    ]
    got = scan(spark, texts)
    assert [got[i].license_id for i in range(len(texts))] == ["MIT", "MIT", "MIT", "ISC", "MIT", None, None, None, None, None]
    assert got[8].canonical_md5 == got[9].canonical_md5


def test_notices(spark):
    got = scan(spark, ["Some prose.\nReleased under the MIT licence\nmore\nLICENSED UNDER CC BY-NC 4.0!", "released under the mit license today",
                       "This work is licensed under the GNU General Public License, version 3.0"])
    assert (got[0].notices, got[0].n_notice_lines) == (["CC-BY-NC-4.0", "MIT"], 2)
    assert (got[1].notices, got[1].n_notice_lines) == ([], 0) and got[2].license_id == "GPL-3.0"


def test_odd_documents(spark):
    out = ls.scan_licenses(odd_documents(spark, ("License_id", "digest", "id", "notices"))).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in ROWS)
    assert all(r.license_id is None and r.notices == [] and r.n_notice_lines == 0 for r in out)
    assert {r.digest for r in out} == {"own"}
    assert ls.scan_licenses(no_documents(spark)).count() == 0
    plan = ls.q_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_whole_texts_of_common_licenses_with_titles(spark):
    whole = dict(ls.TEXTS)
    texts = [(i, t) for i, t in ls.TEXTS] + [(i, "Copyright (c) 2020 X\n\n" + t.upper()) for i, t in ls.TEXTS]
    texts += [("MIT", f"{h}\n\nCopyright (c) 2020 X\n\n{MIT}") for h in ("MIT License", "The MIT License (MIT)", "# The MIT Licence")]
    texts += [("ISC", "ISC License\n\n" + ISC), ("0BSD", "BSD Zero Clause License\n" + ls.KNOWN[2][1]), ("Unlicense", "The Unlicense\n" + whole["Unlicense"])]
    bsd_2 = ls.BSD_3[:ls.BSD_3.index("3. Neither")] + ls.BSD_3[ls.BSD_3.index("THIS SOFTWARE"):]
    for i, t in (("BSD-3-Clause", ls.BSD_3), ("BSD-2-Clause", bsd_2)):
        texts += [(i, t), (i, f"{i[:5]} Clause License\n\nCopyright 2020 X\nAll rights reserved.\n\n{t}"), (i, t.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "))]
    texts += [("Apache-2.0", whole["Apache-2.0"].partition("END OF TERMS")[0]), (None, "MIT License"), (None, "MIT License\n\n" + MIT + "\nExtra."), (None, "\n".join(["MIT"] * 40))]
    got = scan(spark, [t for _, t in texts])
    assert [got[i].license_id for i in range(len(texts))] == [i for i, _ in texts]
    assert len({*ls.KNOWN, *ls.WHOLE}) <= ls.MOST_KNOWN


def test_known_texts_wrapped_at_any_width(spark):
    sign = re.compile(r"\(c\) *[<\[\d]|copyright\s+(?:\[|\(c\))|©", re.IGNORECASE)

    def wrapped(p, width):  # not between 'version' and its number, which SPELLINGS read together
        joined = re.sub(r"(?i)(version) (?=\d)", r"\1~", " ".join(p.split()))
        return textwrap.fill(joined, width, break_long_words=False, break_on_hyphens=False).replace("~", " ")

    rows, want = [], []
    for i, t in [(i, t) for i, t in (*ls.KNOWN[:3], ("BSD-3-Clause", ls.BSD_3), *ls.TEXTS)]:
        # headings stay lines of their own, and so do paragraphs with a notice
        parts = re.split(r"\n[ ]*\n", t)
        for width in (15, 30, 47, 60, 72, 80, 100, 10_000):
            body = [p if n < (3 if len(t) > 2000 else t.startswith("Boost")) or sign.search(p) else wrapped(p, width) for n, p in enumerate(parts)]
            rows.append("\n\n".join(body))
            want.append((i, width))
    usual = MIT.replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT").replace("The above copyright", "The above\ncopyright")
    rows, want = [*rows, usual], [*want, ("MIT", 0)]
    got = scan(spark, rows)
    assert [w for n, w in enumerate(want) if got[n].license_id != w[0]] == []


def test_copyright_lines(spark):
    notices = ["Copyright 2019 A", "copyright (c) 1999-2004, A B", "(C) 2020 X", "© X", "Copyright © X", "Copyright: A Person", "Copyright by A", "Copyright The Project Authors",
               "Copyright [yyyy] [name of copyright owner]", "Copyright (C) <year>  <name>", "  COPYRIGHT SOME ONE", "(c) Copyright 2001 X"]
    body = ["COPYRIGHT HOLDERS BE LIABLE", "copyright notice, this list", "copyright, patent and trademark", "(c) You must retain", "Copyright and Related Rights", "copyright law.",
            "Copyright Holder(s)", "copyright owner or contributors", "copyright the software, and"]
    got = scan(spark, [*notices, *body])
    nothing = scan(spark, [""])[0].canonical_md5
    assert [n for n, r in enumerate(notices) if got[n].canonical_md5 != nothing] == []
    assert [t for n, t in enumerate(body, len(notices)) if got[n].canonical_md5 == nothing] == []


def test_planted_licences_are_found(spark):
    docs = spark.createDataFrame([(i, f"prose {i}") for i in range(400)] + [(None, "no id")], "doc_id long, text string")
    rows = {r.doc_id: (r.text, r.license_id) for r in ls.scan_licenses(ls.planted(docs)).collect()}
    n = len(ls.PLANTED)
    assert n >= 12 and {rows[i][1] for i in range(0, 400, 5)} == {i for i, _ in ls.PLANTED}
    assert all(rows[i][1] == ls.PLANTED[i // 5 % n][0] for i in range(0, 400, 5))
    assert all(rows[i] == (f"prose {i}", None) for i in range(400) if i % 5) and rows[None] == ("no id", None)
    assert rows[5][0].startswith("Copyright (c) 2021 The Owners\n\n") and rows[5][0].endswith(ls.PLANTED[1][1].upper())


def test_texts_are_read_from_the_data_file():
    assert ls.BSD_3.startswith("Redistribution and use") and ls.BSD_3.endswith("DAMAGE.\n") and len(ls.TEXTS) == 16
    assert dict(ls.TEXTS)["Zlib"].strip() and not any(t.startswith("=== ") for _, t in ls.TEXTS)
