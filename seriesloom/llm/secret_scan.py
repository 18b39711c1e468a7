"""Secret scan by grammar inference.

The base patterns find credentials by their form and label their values. From a bounded sample
of those (``sample`` values per kind, the smallest by hash) one probabilistic automaton per
kind is inferred: the values make a prefix tree with counts, and states whose frequencies are
compatible by the Hoeffding bound, down to all their continuations, are merged (ALERGIA).

Every run of credential characters in every text, or what base spans leave of it, is a
candidate. Its format likelihood under each automaton, the chance to end where it does
included, is held against a character-pair model
counted over all different candidates; those that an automaton explains better by ``least_bits`` a character
are found secrets of kind ``format``. Texts of any length are read whole; as Python objects
exist only those of about a megabyte of text, or one longer text, at a time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.session import cut_lineage

KINDS = ("assign", "access", "hex", "format")
SAMPLE = 1000
LONGEST = 256
ALPHA = 0.05
LEAST_BITS = 0.3
SHORTEST = 8
#: Chance of a character that an automaton has not seen at a state, spread over all characters.
SMOOTH = 1e-3
SYMBOLS = 67
#: What becomes Python objects at a time.
TEXT_BYTES, SPANS_AT_ONCE = 1 << 20, 20_000
# The base patterns. Letters of the first are matched in a lower-case copy.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def text_spans(text: str | None) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, value`` of base spans and free candidates, in code points, by start and kind.

    A candidate has the kind ``format``: a run, or the parts of it before, between and after base spans.
    """
    raw = (text or "").encode()
    found = [(m.start(), m.end(), 0, raw[m.start(2) : m.end(2)]) for m in _ASSIGN.finditer(raw.lower()) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(raw)]
    found += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(raw)]
    taken = sorted((a, b) for a, b, _, _ in found)
    k, reach = 0, 0
    for m in _CANDIDATE.finditer(raw):
        at, end = max(m.start(), min(reach, m.end())), m.end()
        while k < len(taken) and taken[k][0] < end:
            if taken[k][0] - at >= SHORTEST:
                found.append((at, taken[k][0], 3, raw[at : taken[k][0]]))
            reach = max(reach, taken[k][1])
            at = max(at, min(reach, end))
            k += 1
        if end - at >= SHORTEST:
            found.append((at, end, 3, raw[at:end]))
    found.sort(key=lambda x: (x[0], x[2]))
    if not text or text.isascii():
        return [(a, b, KINDS[k], v.decode()) for a, b, k, v in found]
    at, points, place = 0, 0, {}
    for p in sorted({p for a, b, _, _ in found for p in (a, b)}):
        points += len(raw[at:p].decode())
        at, place[p] = p, points
    return [(place[a], place[b], KINDS[k], v.decode()) for a, b, k, v in found]


class Automaton:
    """A deterministic automaton with counts: states are numbers, 0 is the start."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.ends = [0]
        for word in words:
            state = 0
            for c in word:
                self.count[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                    self.ends.append(0)
                state = self.next[state][c]
            self.ends[state] += 1

    def visits(self, state: int) -> int:
        return self.ends[state] + self.count[state].total()

    def compatible(self, p: int, q: int, alpha: float) -> bool:
        """Whether all frequencies at p and q, and at what follows them alike, could be equal."""
        scale = math.sqrt(0.5 * math.log(2 / alpha))
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            na, nb = self.visits(a), self.visits(b)
            bound = scale * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if bound < 1:
                pairs = [(self.ends[a], self.ends[b])] + [(self.count[a][c], self.count[b][c]) for c in {**self.count[a], **self.count[b]}]
                if any(abs(x / na - y / nb) > bound for x, y in pairs):
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[b] if c in self.next[a]]
        return True

    def fold(self, p: int, q: int) -> None:
        """Add the counts of the tree below q to p and what follows it."""
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.count[a].update(self.count[b])
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def merge(self, alpha: float) -> None:
        """Merge compatible states, from the start on; what is left are the kept states."""
        kept, seen = [0], {0}
        while True:
            fringe = [(p, c, q) for p in kept for c, q in sorted(self.next[p].items()) if q not in seen]
            if not fringe:
                return
            p, c, q = max(fringe, key=lambda x: self.visits(x[2]))
            for r in kept:
                if self.compatible(r, q, alpha):
                    self.next[p][c] = r
                    self.fold(r, q)
                    break
            else:
                kept.append(q)
                seen.add(q)


END = "\n"  # no candidate holds one; it stands for the begin of a word in pairs, and for its end


def _bits(share: float) -> float:
    return -math.log2(share * (1 - SMOOTH) + SMOOTH / SYMBOLS)


def infer(words: list[str], alpha: float = ALPHA) -> pd.DataFrame:
    """``state, symbol, next, bits`` of the automaton of some words: the moves, the ends, and their costs."""
    found = Automaton(sorted(words))
    found.merge(alpha)
    rows, todo, known = [], [0], {0}
    while todo:
        state = todo.pop()
        total = found.visits(state)
        rows.append((state, END, state, _bits(found.ends[state] / total)))
        for c, nxt in sorted(found.next[state].items()):
            rows.append((state, c, nxt, _bits(found.count[state][c] / total)))
            if nxt not in known:
                known.add(nxt)
                todo.append(nxt)
    return pd.DataFrame(rows, columns=["state", "symbol", "next", "bits"])


def word_bits(moves: dict[tuple[int, str], tuple[int, float]], word: str, most: float = math.inf) -> float:
    """The cost of a word and its end, or part of it that is above ``most``; a character without a move costs the smoothing and leads to the start."""
    state, bits, unseen = 0, 0.0, (0, -math.log2(SMOOTH / SYMBOLS))
    for c in word:
        state, cost = moves.get((state, c), unseen)
        bits += cost
        if bits > most:
            return bits
    return bits + moves.get((state, END), unseen)[1]


def pair_counts(words: list[str]) -> Counter:
    """How often each character, or the end, follows another or the start."""
    counts: Counter = Counter()
    for word in words:
        counts.update(zip(END + word, word + END))
    return counts


def pair_costs(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """Costs of each character after another, with one added to each count."""
    totals: Counter = Counter()
    for (a, _), n in counts.items():
        totals[a] += n
    return {(a, b): -math.log2((n + 1) / (totals[a] + SYMBOLS)) for (a, b), n in counts.items()}


def pair_bits(words: list[str]) -> dict[tuple[str, str], float]:
    """Costs of each character after another in some words."""
    return pair_costs(pair_counts(words))


def smallest_by_hash(values: DataFrame, n: int) -> DataFrame:
    """At most n distinct values, those with the smallest hashes."""
    return values.groupBy("value").agg(F.min("kind").alias("kind")).orderBy(F.md5("value"), "value").limit(n)


def learn_formats(spans: DataFrame, sample: int, alpha: float) -> tuple[dict[str, dict], dict]:
    """The moves of the automaton of each base kind, and the costs of character pairs."""
    found = spans.select(F.explode("spans").alias("s")).select("s.kind", "s.value")
    every = found.filter(F.length("value") <= LONGEST)
    labelled = None
    for kind in KINDS[:3]:
        part = smallest_by_hash(every.filter(F.col("kind") == kind), sample)
        labelled = part if labelled is None else labelled.unionByName(part)

    def moves(frame: pd.DataFrame) -> pd.DataFrame:
        return infer(frame["value"].tolist(), alpha).assign(kind=frame["kind"].iloc[0])[["kind", "state", "symbol", "next", "bits"]]

    formats: dict[str, dict] = {}
    for r in labelled.groupBy("kind").applyInPandas(moves, "kind string, state long, symbol string, next long, bits double").collect():
        formats.setdefault(r["kind"], {})[(r["state"], r["symbol"])] = (r["next"], r["bits"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts += pair_counts(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in counts], pa.string()), pa.array([p[1] for p in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["a", "b", "n"])

    cells = found.filter("kind = 'format'").select("value").distinct().mapInArrow(pairs, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return formats, pair_costs({(r["a"], r["b"]): r["n"] for r in cells.collect()})


def portions(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], pa.Array], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``most`` in all, at least one row each; Python objects are made of one slice at a time."""
    for batch in batches:
        upto = np.cumsum(size(batch).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            spent = int(upto[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, spent + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def find_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_bits: float = LEAST_BITS, sample: int = SAMPLE, alpha: float = ALPHA
) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs``, spans with kind, start, end, value and score.

    Base spans are always there; spans of kind ``format`` are those that the automata add.
    They stand by start and then kind, in code points with the end excluded. The score is by
    how many bits a character the best automaton explains the value better than the pairs of
    characters usual in candidates do. Null and empty texts have no spans. Rows keep their
    number: ids may be null or repeat. Without labelled values nothing is added and scores are
    0. Only the two columns are read; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
    scored = pa.struct([*span, ("score", pa.float64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, lambda b: pc.binary_length(b.column(1)), TEXT_BYTES):
            spans = [[{"kind": k, "start": a, "end": b, "value": v} for a, b, k, v in text_spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    spans = cut_lineage(rows.mapInArrow(extract, f"doc_id {kind}, spans {SPANS}"))
    formats, pairs = learn_formats(spans, sample, alpha)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = math.log2(SYMBOLS)
        for batch in portions(batches, lambda b: pc.list_value_length(b.column(1)), SPANS_AT_ONCE):
            out = []
            for found in batch.column(1).to_pylist():
                kept = []
                for s in found:
                    v = s["value"]
                    usual = sum([pairs.get(p, rare) for p in zip(END + v, v + END)])
                    # A free candidate that costs more than this is not kept, whatever its score.
                    most = usual - least_bits * len(v) + 1e-6 if s["kind"] == KINDS[3] else math.inf
                    bits = min((word_bits(moves, v, most) for moves in formats.values()), default=usual)
                    s["score"] = (usual - bits) / len(v)
                    if s["kind"] != KINDS[3] or s["score"] >= least_bits:
                        kept.append(s)
                out.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(scored))], ["doc_id", "spans"])

    return spans.mapInArrow(score, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>")
