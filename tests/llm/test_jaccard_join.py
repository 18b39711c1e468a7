import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from frames import messy_rows, prose

from seriesloom.llm.components import components
from seriesloom.llm.jaccard_join import as_forests, chosen_paths, near_duplicates, runs_needed
from seriesloom.llm.shingles import WordRuns


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    """(id, class, links) of every row by comparing all."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and shared * (1 + threshold) >= threshold * (len(sets[i]) + len(sets[j])) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    names = {k: min((v for v in ids if v is not None), default=None) for k, ids in least.items()}
    return sorted(((r[0], names[find(i)] if sets[i] else r[0], links[i]) for i, r in enumerate(rows)), key=repr)


def found(frame, **options):
    return sorted((tuple(r) for r in near_duplicates(frame, **options).select("doc_id", "class_id", "n_links").collect()), key=repr)


def test_messy(messy, nothing):
    assert found(messy) == brute(messy_rows())
    assert found(nothing) == []


def test_large_group_of_near_copies_in_blocks(spark):
    """Groups larger than a bucket and a block: every link is counted once."""
    rng = random.Random(5)
    base = prose(7, 80)
    rows = []
    for i in range(150):
        words = list(base)
        words[rng.randrange(80)] = f"w{i}"
        rows.append((i, " ".join(words), "en", "a", 1))
    rows += [(1000 + i, " ".join(prose(100 + i, 20) + base[:15]), "en", "a", 1) for i in range(80)]  # a shared passage only
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    assert found(frame, small=8, block_sets=40, block_tokens=3000) == brute(rows)


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_recall(similarity):
    """Pairs at the threshold share a path in as many runs as promised."""
    rng = np.random.default_rng(3)
    runs, hits, n = runs_needed(0.999, 1.25, 3), 0, 400
    for _ in range(n):
        shared = rng.integers(1, 2**63, round(100 * 2 * similarity / (1 + similarity)), dtype=np.uint64)
        a, b = (np.unique(np.append(shared, rng.integers(1, 2**63, 100 - len(shared), dtype=np.uint64))) for _ in range(2))
        x, y = (chosen_paths(s, runs, 1.25, 0.8, 3)[-1][0] for s in (a, b))  # the nodes at which whole paths end
        hits += bool(set(x.tolist()) & set(y.tolist()))
    assert hits >= n * 0.99


def test_forests_hold_every_path():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(1, 2**63, n, dtype=np.uint64)) for n in (0, 1, 7, 300, 0)]
    levels = [chosen_paths(s, 10, 1.25, 0.8, 3) for s in sets]
    for forest, found in zip(as_forests(levels, 3).to_pylist(), levels):
        at = [[(x["node"], x.get("next")) for x in forest]]
        for _ in range(2):
            at.append([(y["node"], y.get("next")) for _, kids in at[-1] for y in kids])
        for level, (nodes, parents) in enumerate(found):
            assert [n for n, _ in at[level]] == nodes.view(np.int64).tolist()
            if level:
                assert [len(kids) for _, kids in at[level - 1]] == np.bincount(parents, minlength=len(at[level - 1])).tolist()
                assert len(set(nodes.tolist())) == len(nodes)


def test_null_and_repeated_ids(spark):
    """Rows of one id, or none, are known by their text; one row of each class is first."""
    rng = random.Random(9)
    base, rows = prose(3, 90), []
    for i in range(60):
        words = list(base) if i % 3 else prose(500 + i, 60)
        words[rng.randrange(50)] = f"v{i}"
        rows.append((None if i % 2 else 7, " ".join(words), "en", "a", 1))
    rows += [(7, "", "en", "a", 1), (None, None, "en", "a", 1), rows[0], rows[1]]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    assert found(frame, small=8, block_sets=16) == brute(rows)
    sets = [shingles(r[1]) for r in rows]
    close = lambda a, b: a and b and len(a & b) * 1.8 >= 0.8 * (len(a) + len(b)) - 1e-9
    classes, left = 0, list(range(len(rows)))
    while left:
        queue, classes = [left.pop(0)], classes + 1
        while queue:
            x = queue.pop()
            near = [y for y in left if close(sets[x], sets[y])]
            left, queue = [y for y in left if y not in near], queue + near
    assert near_duplicates(frame, small=8, block_sets=16).filter("first").count() == classes


def test_word_runs_match_strings():
    texts = ["A b\tc  d e f", "", None, "x", "a B c d e f", "é ü c d e f\n", "  "]
    runs, edges = WordRuns(pa.array(texts)).runs(5, short=True)
    got = [set(runs[a:b].tolist()) for a, b in zip(edges[:-1], edges[1:])]
    want = [shingles(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    assert got[0] == got[4] and not got[0] & got[5]
    alone = WordRuns(pa.array(["a b c d e f"])).runs(5)[0]
    assert set(alone.tolist()) == got[0]


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert {found[i] for i in range(41)} == {0} and {found[200 + i] for i in range(50)} == {100}
    for a, b in links:
        assert a == b or found[a] == found[b] <= min(a, b)
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
