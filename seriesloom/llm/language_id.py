"""Language identification by compression with one raw-content dictionary per language.

The dictionary of a language is text of that language. A text is cut into blocks, each block
is compressed by zstandard once per language with its dictionary, and the language whose
frames are smallest in sum wins. Blocks keep a long text from becoming its own dictionary.
A fast level decides where it leaves a wide margin; a strong level encodes the rest again.
Texts are compressed as lower-case words: runs of other characters than letters become one
blank, so digits, marks and markup have no say.

The dictionaries are the model: ``dictionary_bytes`` per language, taken from a bounded sample
of the different labelled texts (``sample_texts`` per language, those with the smallest hashes).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import cut_lineage

DICTIONARY_BYTES = 1 << 17
SAMPLE_TEXTS = 400
SNIPPET = 256
FAST = (3, 2048)
STRONG = (12, 1024)
WIDE = 0.08
MARGIN = 0.002
MOST_LANGUAGES = 500
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def words_only(text: str | None) -> str:
    """Lower case, with one blank for each run of characters that are no letters."""
    return _NOT_LETTERS.sub(" ", (text or "").lower()).strip()


def train_dictionaries(
    labelled: DataFrame, text: str = "text", lang: str = "lang", dictionary_bytes: int = DICTIONARY_BYTES, sample_texts: int = SAMPLE_TEXTS, seed: int = 8
) -> dict[str, bytes]:
    """A dictionary per language found in ``labelled``; rows with a null text or language take no part.

    Each language gives the ``sample_texts`` different texts with the smallest hashes, or all
    if it has fewer: copies have no say, and any order and partitioning of the rows gives the
    same model. Each language gives the snippets with the smallest hashes
    of its sampled texts, up to ``dictionary_bytes``. The number of languages is checked.
    """
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    languages = rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    # Different texts by their hashes; the limit by rank acts before the shuffle.
    hashed = rows.withColumn("hash", F.xxhash64(F.lit(seed), "text"))
    ranked = hashed.select("lang", "hash").distinct().withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("hash")))
    chosen = cut_lineage(ranked.filter(F.col("place") <= sample_texts).select("lang", "hash"))
    sampled = hashed.join(F.broadcast(chosen), ["lang", "hash"]).groupBy("lang", "hash").agg(F.min("text").alias("text"))

    def snippets(frame: pd.DataFrame) -> pd.DataFrame:
        pieces = set()
        for t in frame["text"]:
            t = words_only(t)
            pieces |= {t[a : a + SNIPPET].encode() for a in range(0, len(t), SNIPPET)}
        found = sorted((hashlib.md5(piece).digest(), piece) for piece in pieces)
        out, room = [], dictionary_bytes
        for _, piece in found:
            if room <= 0:
                break
            out.append(piece[:room])
            room -= len(piece)
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "content": [b" ".join(out)]})

    trained = sampled.groupBy("lang").applyInPandas(snippets, "lang string, content binary")
    return {r["lang"]: bytes(r["content"]) for r in trained.collect()}


class Coder:
    """Sizes of a text under every dictionary at one level, in blocks of ``block`` bytes."""

    def __init__(self, contents: list[bytes], level: int, block: int):
        self.block, self.coders = block, []
        for content in contents:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, raw: bytes) -> tuple[np.ndarray, float, int]:
        """The sizes, the margin of the smallest in its own size, and the number of blocks."""
        blocks = [raw[a : a + self.block] for a in range(0, len(raw), self.block)]
        sizes = np.array([sum(len(coder.compress(b)) for b in blocks) for coder in self.coders], float)
        if len(sizes) == 1:
            return sizes, np.inf, len(blocks)
        first, second = np.partition(sizes, 1)[:2]
        return sizes, (second - first) / first, len(blocks)


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN,
    fast: tuple[int, int] = FAST, strong: tuple[int, int] = STRONG, wide: float = WIDE,
) -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected``; columns of these names are replaced.

    ``score`` is the weight of the winner where each byte less per block halves the others':
    near 1 where the winner leads, 1 / languages where all tie. ``rejected`` is true where
    the second language needs less than ``margin`` more bytes, in a part of the winner's,
    and for texts without a letter; those, null and empty texts are ``und`` with score 0.
    Ties go to the language whose dictionary holds more of the words, then to the first in
    the alphabet. Without dictionaries all texts are ``und``. ``fast`` and ``strong`` are
    (level, block bytes); the strong level is asked where the fast margin is below ``wide``.
    """
    names = sorted(dictionaries)
    contents = [dictionaries[n] for n in names]
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Coder(contents, *fast), Coder(contents, *strong)
        for batch in batches:
            found, scores, narrow = [], [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                raw = words_only(value.as_py()).encode()
                if not raw or not names:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    narrow.append(True)
                    continue
                sizes, lead, blocks = first(raw)
                if lead < wide:
                    sizes, lead, blocks = second(raw)
                tied = np.flatnonzero(sizes == sizes.min())
                if len(tied) > 1:
                    words = {b" %b " % w for w in raw.split()}
                    tied = sorted(tied, key=lambda k: -sum(w in contents[k] for w in words))
                found.append(names[tied[0]])
                scores.append(float(1 / np.exp2((sizes.min() - sizes) / blocks).sum()))
                narrow.append(bool(lead < margin))
            rest = [f.name for f in fields]
            columns = [*(batch.column(batch.schema.get_field_index(n)) for n in rest), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(narrow, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "lang_pred", "score", "rejected"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double, rejected boolean"])
    return docs.mapInArrow(run, schema)
