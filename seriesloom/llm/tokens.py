"""Token ids of a text by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import numpy as np

VOCABULARY = "byte_bpe_50k"
SPECIAL = {"<|endoftext|>": 50256}


@functools.cache
def _encoders(vocabulary: str):
    """The fast and the reference encoder; one pair per Python worker."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return fast, Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


def token_encoder(vocabulary: str | None = None, end_id: int = 0) -> Callable[[str | None], np.ndarray]:
    """A function from a text to its ids, then ``end_id``; null is the empty text.

    The ids are those of ``tokenizers`` with the JSON vocabulary and without special tokens
    added. The same vocabulary as ranks gives them six times as fast (the tests compare both,
    over all code points); a text on which the fast encoder gives up, such as one with a
    million blanks in a row, goes to the reference one.
    """
    fast, reference = _encoders(vocabulary or VOCABULARY)

    def encode(text: str | None) -> np.ndarray:
        try:
            ids = fast.encode_to_numpy(text or "", allowed_special="all")
        except Exception:
            ids = np.array(reference.encode(text or "", add_special_tokens=False).ids, np.uint32)
        return np.append(ids, np.uint32(end_id))

    return encode
