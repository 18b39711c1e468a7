import math
import random
import re
from collections import Counter

from frames import messy_rows, prose
from pyspark.sql import functions as F

from seriesloom.llm.license_scan import LICENCE_FILE, TEMPLATES, THRESHOLD, WEAK, Templates, frequencies_of, scan_licenses, words


def test_pruning_loses_nothing():
    """Every segment that reaches a template has a key word."""
    idf = {w: 1 + len(w) % 4 for s in TEMPLATES.values() for t in s for w in words(t)}
    known = Templates(TEMPLATES, idf, 5.0, 0.75)
    rng = random.Random(4)
    statements = [(name, t) for name, s in TEMPLATES.items() for t in s]
    reached = 0
    for _ in range(4000):
        name, t = rng.choice(statements)
        kept = [w for w in words(t) if rng.random() < 0.8] + prose(rng.randrange(10**6), rng.randint(0, 2))
        if known.score(kept)[0] >= 0.75:
            reached += 1
            assert not known.keys.isdisjoint(kept)
    assert reached > 500


def test_score_is_the_cosine():
    known = Templates({"a": ("one two two",), "b": ("one three",)}, {"one": 1.0, "two": 2.0, "three": 1.5}, 3.0, 0.1)
    vector = lambda t: {w: (1 + math.log(n)) * {"one": 1.0, "two": 2.0, "three": 1.5}.get(w, 3.0) for w, n in Counter(t.split()).items()}
    a, b = vector("one two two"), vector("two other")
    want = sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    assert abs(known.score("two other".split())[0] - want) < 1e-12


def test_inheritance_from_the_nearest_directory(spark):
    mit, apache = "Released under the MIT License.", "text\n\nLicensed under the Apache License, Version 2.0.\n" + " ".join(prose(1, 300))
    rows = [
        (1, "LICENSE", mit), (2, "a/b/LICENSE.txt", apache), (3, "a/x.py", "code"), (4, "a/b/y.py", "code"), (5, "a/b/c/d/z.py", None), (6, "ab/q.py", ""),
        (7, "a/b/own.py", "head\nThis work is licensed under the GNU General Public License, version 3."), (8, None, "code"), (9, "top.py", "code"), (10, "a/b/y.py", "code"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, path string, text string").withColumn("score", F.lit("x")).withColumn("other", F.lit(1))
    found = {r["doc_id"]: (r["license"], r["origin"], r["directory"]) for r in scan_licenses(frame).collect()}
    assert found == {
        1: ("MIT", "stated", None), 2: ("Apache-2.0", "stated", None), 3: ("MIT", "inherited", ""), 4: ("Apache-2.0", "inherited", "a/b"), 5: ("Apache-2.0", "inherited", "a/b"),
        6: ("MIT", "inherited", ""), 7: ("GPL-3.0", "stated", None), 8: (None, None, None), 9: ("MIT", "inherited", ""), 10: ("Apache-2.0", "inherited", "a/b"),
    }
    assert scan_licenses(frame.limit(0)).count() == 0


def test_messy(messy):
    files = messy.withColumn("path", F.concat_ws("/", "source", "lang"))
    found = scan_licenses(files).collect()
    assert len(found) == len(messy_rows()) and {r["row"] for r in found} == {"row"} and {r["license"] for r in found} == {None}


def test_statements_inside_lines_and_near_versions(spark):
    """Statements need no line of their own, and near versions are told apart."""
    apache, bsd = TEMPLATES["Apache-2.0"][2], TEMPLATES["BSD-2-Clause"][1]
    cases = {
        "Copyright (c) 2020 Example Corp. All rights reserved.": "all-rights-reserved",
        "Copyright 2019 Jane Doe. Released under the MIT License.": "MIT",
        "MIT License": "MIT",
        "Apache License Version 2.0, January 2004": "Apache-2.0",
        "Copyright 2021 Someone Else " + apache: "Apache-2.0",
        "Copyright 2018 Some Body. All rights reserved. " + bsd: "BSD-2-Clause",
        "Copyright 2018 Some Body. All rights reserved. " + TEMPLATES["BSD-3-Clause"][2]: "BSD-3-Clause",
        TEMPLATES["GPL-2.0"][1]: "GPL-2.0",
        TEMPLATES["LGPL-2.1"][1]: "LGPL-2.1",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "SPDX-License-Identifier: EPL-2.0": None,
        "Licensed under the Apache License, Version 1.1.": None,
    }
    rows = [(i, f"d{i}/a.py", f"{' '.join(prose(i, 40))} {t} {' '.join(prose(i + 99, 40))}" if len(t) > 60 else t) for i, t in enumerate(cases)]
    rows += [(1000 + i, f"x{i}", " ".join(prose(i, 60))) for i in range(50)]
    found = {r["doc_id"]: r["license"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values())


def brute(rows):
    """License, score, origin and directory of (path, text): all segments of all texts, then a walk up the directories."""
    n = len(rows)
    counts = Counter(w for _, t in rows for w in set(words(t or "")))
    every = {w for s in TEMPLATES.values() for t in s for w in words(t)} | set(counts)
    known = Templates(TEMPLATES, {w: math.log((n + 1) / (counts[w] + 1)) + 1 for w in every}, 0.0, THRESHOLD)
    stated, files = [], {}
    for path, t in rows:
        near = {(s, k) for part in known.segments(t) for s, k in known.scores(part) if s >= THRESHOLD}
        s, k = max(near, key=lambda x: (known.names[x[1]] != WEAK, x[0] * math.log1p(known.lengths[x[1]]), known.names[x[1]]), default=(None, -1))
        stated.append((known.names[k] if k >= 0 else None, s))
        if k >= 0 and path is not None and re.search(LICENCE_FILE, path):
            at = path.rpartition("/")[0]
            files[at] = max(files.get(at, (-1, "")), (s, known.names[k]))
    out = []
    for (path, _), (name, s) in zip(rows, stated):
        if name or path is None:
            out.append((name, s, "stated" if name else None, None))
            continue
        at = path
        while at and at.rpartition("/")[0] not in files:
            at = at.rpartition("/")[0]
        at = at.rpartition("/")[0] if at else None
        out.append((files[at][1], None, "inherited", at) if at is not None else (None, None, None, None))
    return out


def test_scan_against_brute_force(spark):
    """Statements with words left out and others put in, in files of directories of any depth."""
    rng = random.Random(11)
    statements = [t for s in TEMPLATES.values() for t in s]
    rows = []
    for i in range(300):
        text = " ".join(prose(i % 40, rng.randint(0, 30)))
        if rng.random() < 0.3:
            own = [w for w in rng.choice(statements).split() if rng.random() < 0.95] + prose(rng.randrange(9), rng.randint(0, 2))
            text = rng.choice([" ".join(own), f"{text}\n{' '.join(own)}\n\n{text}", f"{text} {' '.join(own)} {text}"])
        path = "/".join([*rng.choices("abc", k=rng.randint(0, 4)), rng.choice(["LICENSE", "x.py", "y.py", "COPYING.txt"])])
        rows.append((None if i % 37 == 0 else path, None if i % 41 == 0 else text))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, path string, text string").repartition(4)
    found = {r["doc_id"]: r for r in scan_licenses(frame).collect()}
    want = brute(rows)
    assert sum(w[2] == "stated" for w in want) > 40 and sum(w[2] == "inherited" for w in want) > 40
    for i, w in enumerate(want):
        r = found[i]
        assert (r["license"], r["origin"], r["directory"]) == (w[0], w[2], w[3]), i
        assert r["score"] is None and w[1] is None or abs(r["score"] - w[1]) < 1e-9


def test_frequencies_through_a_full_filter(spark):
    """Words that pass the filter by chance are not counted as wanted ones."""
    texts = [" ".join(f"w{(i * k) % 97}" for k in range(20)) for i in range(50)]
    files = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string").repartition(3)
    wanted = spark.createDataFrame([(f"w{i}",) for i in range(60)], "word string")
    want = Counter(w for t in texts for w in set(t.split()))
    for bits in (3, 16, 23):
        got = {r["word"]: r["files"] for r in frequencies_of(files, "text", wanted, bits).collect()}
        assert got == {f"w{i}": want[f"w{i}"] for i in range(60) if want[f"w{i}"]}
