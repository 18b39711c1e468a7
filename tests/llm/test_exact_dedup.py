import re
from collections import defaultdict

import pytest
from frames import messy_rows
from pyspark.sql import functions as F

from seriesloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates, sha256


def wanted() -> list[tuple]:
    groups = defaultdict(list)
    for doc_id, text, *_ in messy_rows():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        left = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), i == keep and left))
            left &= i != keep
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [sha256, lambda norm: F.length(norm) % 3])
def test_against_brute_force(messy, digest):
    """A weak digest stands for many texts; the texts themselves decide."""
    found = exact_duplicates(messy, salts=2, digest=digest).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted((tuple(r) for r in found), key=repr) == wanted()


def test_rows_that_stay(messy, nothing):
    kept = drop_exact_duplicates(messy)
    assert kept.columns == messy.columns
    rows = kept.collect()
    assert len(rows) == sum(w[3] for w in wanted())
    assert {r["row"] for r in rows} == {"row"} and {r["digest"] for r in rows} == {"digest"}
    assert exact_duplicates(nothing).count() == 0 and drop_exact_duplicates(nothing).count() == 0
