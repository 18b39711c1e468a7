"""Token ids by a public vocabulary of words, each different word encoded once per worker."""

from __future__ import annotations

import operator
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k"
#: Words are forgotten beyond this many bytes, and texts are read in segments of about this size.
KEPT_BYTES = 64 << 20
SEGMENT_BYTES = 1 << 20
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Letters that are whole characters in any normal form, with one lower case. Digits and marks beside
#: them are words of their own, but an apostrophe may belong to a word and "<|" open a special token.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
DIGITS = "0123456789"
_MARKS = "!\"#$%&()*+,-./:;=>?@[]^_`{|}~\\"
MARKS = re.escape(_MARKS)
#: Longer words go to the whole library, whose time does not grow with the square of a piece.
_PLAIN = re.compile(f"[{LETTERS}{DIGITS}{MARKS}]{{1,256}}")
#: Behind the last byte of a piece, where the vocabulary writes "</w>"; plain words have no such byte.
_END = 0x1F
_LETTER, _DIGIT, _MARK, _LINE = range(4)
_KIND = np.full(256, _LETTER, np.uint8)  # of each byte of plain words; those beyond ASCII are parts of letters
_KIND[list(DIGITS.encode())], _KIND[list(_MARKS.encode())], _KIND[ord("\n")] = _DIGIT, _MARK, _LINE


def vocabulary_size(vocabulary: str | None = None) -> int:
    """How many ids the vocabulary has, those of special tokens among them."""
    return _tokenizer(vocabulary).get_vocab_size()


def _tokenizer(vocabulary: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary or VOCABULARY}.json"))


def byte_of() -> dict[str, int]:
    """The byte that a character of the vocabulary stands for: visible ones for themselves, from 256 on the others in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*visible}))}


def _merger(tokenizer):
    """The merges of the vocabulary by ``tiktoken``, for pieces that each close with ``_END``, and line ends.

    The id of a merged token is its rank, and that of a byte with "</w>" comes before all merges. Each
    token comes out of the merges of its own bytes (tested), so the least rank of two neighbours is
    always that of a merge, and the ids are those of ``tokenizers``.
    """
    import tiktoken

    byte, ranks = byte_of(), {}
    for token, rank in tokenizer.get_vocab(with_added_tokens=False).items():
        part = token.removesuffix("</w>")
        text = bytes(map(byte.__getitem__, part))
        if _END not in text:
            ranks[text if part == token else text + bytes([_END])] = rank
        elif len(token) == 1:
            ranks[text] = rank
    special = {t.content: k for k, t in tokenizer.get_added_tokens_decoder().items()}  # plain words have none
    return tiktoken.Encoding("words", pat_str="[^\x1f\n]+\x1f|\n", mergeable_ranks=ranks, special_tokens=special)


def segments(text: bytes, size: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The text cut at blanks into segments of about ``size`` bytes; at least one."""
    begin = 0
    while len(text) - begin > size:
        blank = _BLANK.search(text, begin + size)
        if blank is None:
            break
        yield text[begin : blank.start()]
        begin = blank.end()
    yield text[begin:]


class WordEncoder:
    """Ids of texts, as ``tokenizers`` gives them without adding special tokens.

    The vocabulary drops white space before it merges, and neither its normaliser nor its
    words reach over an ASCII blank. So the ids of a text are those of its blank-separated
    words, and a word met before needs no second encoding. The tests compare with whole texts
    over all code points.
    """

    def __init__(self, vocabulary: str | None = None, end_id: int = 1):
        self._tokenizer = _tokenizer(vocabulary)
        self._merge = _merger(self._tokenizer)
        self._line = self._merge.encode_single_token("\n")
        self._end_id = end_id
        self._forget()

    def _forget(self) -> None:
        self._number: dict[bytes, int] = {b"": 1}  # number 0 is the end of a document
        self._ids, self._starts, self._lengths = np.array([self._end_id], np.uint32), np.array([0, 1]), np.array([1, 0])
        self._bytes = 0

    def _merged(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain lower-case words, and how many each has; they need merges alone."""
        text = np.frombuffer("".join(f"{line}\n" for line in lines).encode(), np.uint8)
        kind = _KIND[text]
        closed = ((kind[:-1] != kind[1:]) | (kind[:-1] == _DIGIT)) & (kind[:-1] != _LINE)
        pieces = np.insert(text, np.flatnonzero(closed) + 1, _END).tobytes().decode()
        ids = self._merge.encode_to_numpy(pieces, disallowed_special=())
        line = ids == self._line
        return ids[~line], np.diff(np.flatnonzero(line), prepend=-1) - 1

    def _learn(self, words: list[bytes]) -> None:
        """Give numbers to new words: plain ones need merges alone, all else the whole library."""
        lines = b"\n".join(words).decode("utf-8", "replace").lower().split("\n")
        plain = [bool(_PLAIN.fullmatch(line)) for line in lines]
        other = list(compress(words, map(operator.not_, plain)))
        ids, lengths = self._merged(list(compress(lines, plain)))
        found = [self._tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids for w in other]
        words = [*compress(words, plain), *other]
        lengths = np.concatenate([lengths, np.fromiter(map(len, found), np.int64, len(found))])
        known = len(self._starts)
        self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(lengths) - lengths])
        self._lengths = np.concatenate([self._lengths, lengths])
        self._ids = np.concatenate([self._ids, ids, np.fromiter(chain.from_iterable(found), np.uint32)])
        self._bytes += sum(map(len, words)) + 4 * int(lengths.sum()) + 100 * len(words)
        self._number.update(zip(words, range(known, known + len(words))))  # last: a word with a number has ids

    def __call__(self, texts: Sequence[bytes], ends: Sequence[bool]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts``, after a text with ``ends`` the end id, and how many each has."""
        if self._bytes > KEPT_BYTES:
            self._forget()
        lower = [t.lower() if t.isascii() and b"<|" not in t else t for t in texts]
        split = pc.ascii_split_whitespace(pa.array(lower, pa.large_binary()).view(pa.large_string()))
        words = split.flatten().dictionary_encode()  # each different word is looked up once
        different = words.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self._number.get, different, repeat(-1)), np.int64, len(different))
        if len(unknown := np.flatnonzero(numbers < 0)):
            new = different[unknown].tolist()
            self._learn(new)
            numbers[unknown] = [self._number[w] for w in new]
        ended, edges = np.asarray(ends, bool), split.offsets.to_numpy().astype(np.int64)
        numbers = np.insert(numbers[words.indices.to_numpy()], edges[1:][ended], 0)
        edges[1:] += np.cumsum(ended)
        lengths = self._lengths[numbers]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = self._ids[np.repeat(self._starts[numbers] - upto[:-1], lengths) + np.arange(upto[-1])]
        return ids, np.diff(upto[edges])


@lru_cache(maxsize=1)
def kept_encoder(vocabulary: str | None = None, end_id: int = 1) -> WordEncoder:
    """The encoder of this process: what one task has learned, the next one in the same worker knows."""
    return WordEncoder(vocabulary, end_id)
