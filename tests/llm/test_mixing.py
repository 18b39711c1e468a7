import hashlib
import re
from collections import Counter, defaultdict

import pytest
from frames import messy_rows

from seriesloom.llm.mixing import SEED, leaf_budgets, mix


def fill(budget, caps, weights):
    """Share a budget by weights under capacities, round by round."""
    given, open_ = dict.fromkeys(caps, 0.0), {c for c in caps if weights[c] > 0 and caps[c] > 0}
    while budget > 1e-9 and open_:
        unit = budget / sum(weights[c] for c in open_)
        full = {c for c in open_ if caps[c] - given[c] <= unit * weights[c] + 1e-12}
        for c in full or open_:
            more = caps[c] - given[c] if full else unit * weights[c]
            given[c] += more
            budget -= more
        open_ -= full or open_
    return given


@pytest.mark.parametrize("budget", [10, 100, 400, 10_000])
def test_budgets(spark, budget):
    """Shortages go to siblings before they go up."""
    supply = {("a", "x"): 10, ("a", "y"): 40, ("b", "x"): 100, ("b", "z"): 5, (None, "x"): 30, ("c", "x"): 0}
    leaves = spark.createDataFrame([(*k, v) for k, v in supply.items()], "g string, s string, supply bigint")
    found = {(r["g"], r["s"]): r["quota"] for r in leaf_budgets(leaves, ["g", "s"], {"g": "CASE WHEN g = 'a' THEN 3 ELSE 1 END", "s": "CASE WHEN s = 'z' THEN 0 ELSE 1 END"}, budget, 2).collect()}
    caps = {k: 0 if k[1] == "z" else 2.0 * v for k, v in supply.items()}
    top = fill(budget, {g: sum(v for k, v in caps.items() if k[0] == g) for g in ("a", "b", None, "c")}, {"a": 3, "b": 1, None: 1, "c": 1})
    for g, b in top.items():
        for k, want in fill(b, {k: v for k, v in caps.items() if k[0] == g}, {k: 0 if k[1] == "z" else 1 for k in caps}).items():
            assert abs(found[k] - want) <= 1, (k, found[k], want)


def test_prefix_of_seeded_epochs(messy, nothing):
    found = Counter((r["doc_id"], r["source"], r["epoch"]) for r in mix(messy, ["source"], {}, 0.7, epochs=3).collect())
    words = {}
    groups = defaultdict(list)
    for i, text, _, source, _ in messy_rows():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        groups[source].append((i, n))
        words[source] = words.get(source, 0) + n
    given = fill(0.7 * sum(words.values()), {s: 3.0 * n for s, n in words.items()}, dict.fromkeys(words, 1))
    want = Counter()
    for s, docs in groups.items():
        quota = int(given[s] + 1e-6)
        whole, rest = divmod(quota, words[s]) if words[s] else (0, 0)
        for e in range(1, whole + 1):
            want.update((i, s, e) for i, _ in docs)
        key = {d: (hashlib.md5(f"{SEED}:{whole + 1}:{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[1]) for d in docs}
        for d in docs:
            if rest and sum(n for o, n in docs if key[(o, n)] <= key[d]) <= rest:
                want[d[0], s, whole + 1] += 1
    assert found == want
    assert mix(nothing, ["lang", "source"], {}, 0.5).count() == 0
    assert mix(messy, ["lang", "source"], {"lang": "0"}, 1.0).count() == 0
    taken = mix(messy, ["source"], {}, 1.0, epochs=1)
    assert taken.columns == [*(c for c in messy.columns if c not in ("epoch", "tokens")), "epoch", "tokens"] and {r["row"] for r in taken.collect()} == {"row"}
