import math
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from parallax.llm import common
from parallax.llm import licenses as lic

FILES = [
    (1, "a/b/one.txt", "Some text.\nReleased under the MIT License."),
    (2, "a/b/two.txt", "nothing here at all"),
    (3, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    (4, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
    (5, "a/c/d/x.txt", "the of under this is by"),
    (6, "q/x.txt", "License?"),
    (7, "q/x.txt", None),
    (8, None, ""),
    (9, "a/b/long.txt", "word and more words " * 2000 + "\nLicensed under CC BY-NC 4.0."),
    (9, "a/b/long.txt", "word and more words " * 2000 + "\nLicensed under CC BY-NC 4.0."),
    (10, "z/y.txt", "ALL RIGHTS RESERVED!! released UNDER the mit license"),
    (None, "a/b/c/none.txt", "plain"),
]


def units_of(text):
    """(unit, whole text, first block) of a text, by walking its lines."""
    lines = re.split(r"[\r\n]+|(?<=[.!?])\s+", text)
    blocks = re.split(r"[\r\n][^A-Za-z0-9\r\n]*(?:\r\n|\n|\r)[\r\n]*", text)
    comments, run = [], []
    for line in [*text.split("\n"), "code"]:
        if re.match(r"[ \t]*(#|//|--|;|%|/?\*)", line):
            run.append(line)
        else:
            comments += ["\n".join(run)] if len(run) > 1 else []
            run = []
    head = [(b, False, True) for b in blocks if re.search("[A-Za-z0-9]", b)][:1]
    return [(s, False, False) for s in lines + [p for p in blocks if re.search(r"[\r\n]", p)] + comments] + head + [(text, True, False)]


def brute(files):
    """All units against all templates, by their common weight; ancestors walked one by one."""
    words = lambda s: re.findall("[a-z0-9]+", s.lower())
    n = len(files)
    seen = {}
    for _, _, t in files:
        for w in set(words(t or "")):
            seen[w] = seen.get(w, 0) + 1
    idf = lambda w: min(math.log((1 + n) / (1 + seen.get(w, 0))), math.log(1000)) + 0.1

    def vector(text):
        v = {w: words(text).count(w) * idf(w) for w in set(words(text))}
        return v, math.sqrt(sum(x * x for x in v.values()))

    templates = [(name, *vector(t), title) for title, table in ((False, lic.TEMPLATES), (True, lic.TITLES)) for name, ts in table.items() for t in ts]
    own, speaks = [], {}
    for i, path, text in files:
        best = aloud = None
        named = re.search(r"(^|/)(licen[cs]e|copying|unlicense)([._-][^/]*)?$", (path or "").lower())
        for s, whole, first in units_of(text or ""):
            v, size = vector(s)
            common = [sum(x * u.get(w, 0) for w, x in v.items()) / other for _, u, other, _ in templates]
            k = min(range(len(templates)), key=lambda k: (-round(common[k] / size, 6) if size else 0, k))
            if size and round(common[k] / size, 6) >= lic.COSINE:
                top = (templates[k][0] != "Proprietary", round(round(common[k] / size, 6) * size, 4), round(common[k] / size, 6), -k, templates[k][0])
                best = max(best or top, top)
                if whole or named or len(s) >= lic.FILE_SHARE * len(text) or first and templates[k][3]:
                    aloud = max(aloud or top, top)
        own.append(best)
        directory = (path or "").rpartition("/")[0]
        if aloud:
            speaks[directory] = min(speaks.get(directory, (9,)), (not aloud[0], -aloud[1], aloud[4], path or ""))
    out = []
    for (i, path, _), best in zip(files, own, strict=True):
        if best:
            out.append((i, path or "", best[4], "own", None))
            continue
        at = (path or "").rpartition("/")[0]
        while at not in speaks and at:
            at = at.rpartition("/")[0]
        out.append((i, path or "", speaks[at][2], "inherited", at) if at in speaks else (i, path or "", None, "none", None))
    return sorted(out, key=str)


def rows(spark, files):
    made = spark.createDataFrame([(*f, "clash") for f in files], "file_id long, path string, text string, license string")
    return sorted(((r["file_id"], r["path"], r["license"], r["origin"], r["directory"]) for r in lic.scan(made).collect()), key=str)


def test_against_brute_force(spark):
    assert rows(spark, FILES) == brute(FILES)
    by_id = {r[0]: r for r in rows(spark, FILES)}
    assert by_id[2][2:] == ("GPL-3.0", "inherited", "a/b") and by_id[5][2:] == ("Apache-2.0", "inherited", "a") and by_id[9][2] == "CC-BY-NC-4.0"


def test_many_plain_files(spark):
    files = [(i, f"s{i % 3}/f{i}", f"word{i} the license of nothing" if i % 5 else "Licensed under CC BY 4.0.") for i in range(120)]
    assert rows(spark, files) == brute(files)


def wrapped(text, width=78, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(" ".join(text.split()), width))


PLAIN = "int main(void) { return 0; }  // the sum of parts of a list of words"
TREE = [
    (1, "p/LICENSE", "MIT License\n\nCopyright (c) 2024 Some One\n\n" + wrapped(lic.MIT_TERMS)),
    (2, "p/src/a.c", PLAIN),
    (3, "q/readme.md", "Copyright 2020 A. Person\n\n" + wrapped(lic.BSD_START) + "\n\n" + wrapped(lic.BSD_NAMES) + "\n\n" + wrapped(lic.BSD_END)),
    (4, "q/b.c", PLAIN),
    (5, "g/COPYING", "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\n" + "Everyone may copy these terms as they are written down here. " * 300),
    (6, "g/x/y/c.c", PLAIN),
    (7, "h/d.py", wrapped(lic.APACHE_NOTICE, 70, "# ") + "\n#\n\n" + "\n".join(f"value_{i} = compute({i})" for i in range(300))),
    (8, "h/e.py", PLAIN),
    (9, "i/f.js", "/*\n" + wrapped(lic.GNU_NOTICE.format("Lesser General Public"), 70, " * ") + "\n *\n * Other words.\n */\n" + "var a = 1;\n" * 400),
]


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_whole_license_files_and_headers(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    got = rows(spark, TREE)
    assert got == brute(TREE)
    assert [r[2:] for r in got] == [
        ("MIT", "own", None), ("MIT", "inherited", "p"), ("BSD-3-Clause", "own", None), ("BSD-3-Clause", "inherited", "q"), ("GPL-3.0", "own", None),
        ("GPL-3.0", "inherited", "g"), ("Apache-2.0", "own", None), (None, "none", None), ("LGPL-3.0", "own", None),
    ]


HOLDER = lic.BSD_NAMES.replace("the copyright holder", "Umbrella Widgets Incorporated")
RESERVED = [
    (1, "a/LICENSE", "Copyright (c) 2019, Umbrella Widgets Incorporated\nAll rights reserved.\n\n" + wrapped(lic.BSD_START) + "\n\n" + wrapped(HOLDER) + "\n\n" + wrapped(lic.BSD_END)),
    (2, "a/src/x.c", PLAIN),
    (3, "b/LICENSE", "Copyright (c) 2020 Acme. All rights reserved.\n\n" + wrapped(lic.MIT_TERMS.replace("publish", "advertise"))),
    (4, "b/y.c", PLAIN),
    (5, "c/z.c", "/*\n * Copyright 2001 Acme.\n * All rights reserved.\n *\n" + wrapped(lic.BSD_START, 70, " * ") + "\n *\n" + wrapped(HOLDER, 70, " * ") + "\n *\n" + wrapped(lic.BSD_END, 70, " * ") + "\n */\n\n" + "int value = compute(3);\n" * 500),
    (6, "d/terms.txt", "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE\n\n" + "   Each party shall act under these terms and conditions as stated in this document.\n\n" * 150),
    (7, "d/x.c", PLAIN),
    (8, "e/notes.txt", "Copyright 2020 Acme. All rights reserved."),
    (9, "e/f/w.c", PLAIN),
    (10, "g/mpl.txt", "Mozilla Public License Version 2.0\n==================================\n\n" + "Terms of every kind are written down here.\n\n" * 100),
    (11, "g/h/v.c", PLAIN),
]


def test_terms_outweigh_a_notice_of_reserved_rights(spark):
    got = rows(spark, RESERVED)
    assert got == brute(RESERVED)
    assert {r[0]: r[2:] for r in got} == {
        1: ("BSD-3-Clause", "own", None), 2: ("BSD-3-Clause", "inherited", "a"), 3: ("MIT", "own", None), 4: ("MIT", "inherited", "b"), 5: ("BSD-3-Clause", "own", None),
        6: ("Apache-2.0", "own", None), 7: ("Apache-2.0", "inherited", "d"), 8: ("Proprietary", "own", None), 9: ("Proprietary", "inherited", "e"),
        10: ("MPL-2.0", "own", None), 11: ("MPL-2.0", "inherited", "g"),
    }


def test_scores_do_not_fall_with_the_number_of_files(spark):
    """Words beside a statement weigh no more in a larger table."""
    said = "Unless noted otherwise this page is licensed under CC BY 4.0."
    for n in (500, 3000):
        files = spark.range(n).selectExpr("id AS file_id", "concat('f/', id) AS path", f"CASE WHEN id % 100 = 0 THEN '{said}' WHEN id % 3 = 0 THEN 'this page is noted' ELSE concat('unless otherwise w', id) END AS text")
        scores = {r["score"] for r in lic.scan(files).filter("license = 'CC-BY-4.0' AND origin = 'own'").collect()}
        assert len(scores) == 1 and min(scores) > 0.6


def test_empty_table(spark):
    assert lic.scan(spark.createDataFrame([], "file_id long, path string, text string")).count() == 0


def test_anchors_leave_nothing_out(spark):
    scanner = lic.Scanner(spark.createDataFrame(FILES, "file_id long, path string, text string").withColumn("text", F.coalesce("text", F.lit(""))))
    for vector in scanner.vectors:
        assert sum(x * x for w, x in vector.items() if w not in scanner.anchors) < lic.COSINE**2
