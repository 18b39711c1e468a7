import json
import random
import sys
import unicodedata
import uuid
import zlib

import numpy as np
import pytest
from frames import messy_rows
from pyspark.sql import functions as F

from seriesloom.llm.q_token_files import op13_token_files
from seriesloom.llm.token_files import Shard, ShardWriter, id_bits, pack_bits, read_tokens, unpack_bits, write_tokens
from seriesloom.llm.word_tokens import MARKS, WordEncoder, _tokenizer, byte_of, kept_encoder, segments
from seriesloom.session import WRITTEN, use_checkpoint_dir


def whole(text, tokenizer=_tokenizer(None)):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def folder(spark):
    return f"{use_checkpoint_dir(spark)}/{WRITTEN}{uuid.uuid4().hex}"


def in_order(rows):
    """Brute force: (doc_id, start, ids) of rows without tied ids."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = whole(text)
        out.append((doc, start, ids))
        start += len(ids)
    return out


def test_words_give_the_ids_of_whole_texts():
    points = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cs", "Cn", "Co")]
    encode = WordEncoder()
    texts = ["".join(f"{c}a{c}\t" for c in points[a : a + 400]) for a in range(0, len(points), 400)]
    rng = random.Random(1)
    marks = [c for c in points if unicodedata.combining(c)] + list(" \n\x0b\x1c\u0085  ΑΣ'sIİ<|>한ᄒ") * 40
    texts += ["".join(rng.choices(marks, k=300)) for _ in range(200)]
    texts += ["".join(rng.choices("aAé'<|>.,!-_(/\\\"9 ", k=200)) for _ in range(200)]
    texts += [c + m for c in "IiJjKAÅeHwWS" for m in marks]
    texts += ["", " ", "a<|endoftext|>b <|startoftext|> <|end oftext|>", "it's 'S we'll", "x" * 5000]
    ids, lengths = encode([t.encode() for t in texts], [True] * len(texts))
    edges = np.cumsum(lengths)
    for text, a, b in zip(texts, edges - lengths, edges):
        assert ids[a:b].tolist() == whole(text)


def test_plain_words_give_the_ids_of_whole_texts():
    rng = random.Random(2)
    marks = MARKS.replace("\\", "") + "\\"
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZßàâäçéèêëíîïñôöùüýþÿÀÉÍÑÖÜ"
    words = ["".join(rng.choices(marks, k=rng.choice([0, 0, 0, 1, 2]))) + "".join(rng.choices(letters[: rng.choice([26, 32, 60])], k=rng.randint(0, 12))) + "".join(rng.choices(marks, k=rng.choice([0, 0, 1, 2, 3, 9]))) for _ in range(20_000)]
    words += ["e\u0301.", "İ.", "K,", "ſs;", "ab\u0301)", "a'", "a',", "'s.", "x<|", "a<|endoftext|>.", "aªb,", "ab0.", "a²", "\u00d7a,"]
    texts = [" ".join(words[a : a + 50]) for a in range(0, len(words), 50)]
    encode = WordEncoder()
    for _ in range(2):  # as new words, and as known ones
        ids, lengths = encode([t.encode() for t in texts], [True] * len(texts))
        edges = np.cumsum(lengths)
        for text, a, b in zip(texts, edges - lengths, edges):
            assert ids[a:b].tolist() == whole(text)


def test_tasks_of_a_worker_share_known_words(spark):
    """A second task of the same process encodes none of the words that the first one met."""

    def learned(batches):
        from seriesloom.llm import token_files, word_tokens

        calls, learn = [0], word_tokens.WordEncoder._learn

        def count(self, words):
            calls[0] += len(words)
            return learn(self, words)

        word_tokens.WordEncoder._learn = count
        try:
            encoder = getattr(token_files, "kept_encoder", word_tokens.WordEncoder)(None, 1)
            for _ in token_files._encoded(batches, encoder):
                pass
        finally:
            word_tokens.WordEncoder._learn = learn
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(calls, pa.int64())], ["calls"])

    docs = spark.createDataFrame([(k, b"worker words that were met once") for k in range(40)], "doc_id bigint, text binary").repartition(40)
    counts = [r["calls"] for r in docs.mapInArrow(learned, "calls bigint").collect()]
    workers = 16  # more than the local session has
    assert sum(counts) <= workers * 6 < 40 * 6


def test_kept_encoder_forgets_and_stays_right(monkeypatch):
    from seriesloom.llm import word_tokens

    monkeypatch.setattr(word_tokens, "KEPT_BYTES", 500)
    encode, first = kept_encoder(None, 1), kept_encoder(None, 1)
    assert encode is first and kept_encoder(None, 2) is not first
    for k in range(20):
        text = " ".join(f"w{chr(97 + k)}{chr(97 + j)}, é{chr(97 + j)}." for j in range(9))
        ids, _ = encode([text.encode()], [True])
        assert ids.tolist() == whole(text) and encode._bytes < 5000


def test_each_token_comes_out_of_its_own_merges():
    """What the ids by ranks rely on: ids rise with the merges, and no token is out of reach of its bytes."""
    from tokenizers.pre_tokenizers import ByteLevel

    model = json.loads(_tokenizer(None).to_str())["model"]
    ids, merges = model["vocab"], [tuple(m) for m in model["merges"]]
    rank = {pair: k for k, pair in enumerate(merges)}
    assert [ids[a + b] for a, b in merges] == [*range(512, 512 + len(merges))] and all(max(ids[a], ids[b]) < ids[a + b] for a, b in merges)
    assert {c: b for c, b in byte_of().items()}.keys() == set(ByteLevel.alphabet()) and sorted(byte_of().values()) == [*range(256)]
    for token in ids:
        part = token.removesuffix("</w>")
        symbols = [*part[:-1], part[-1] + token[len(part) :]]
        while len(symbols) > 1:
            k = min(range(len(symbols) - 1), key=lambda k: rank.get((symbols[k], symbols[k + 1]), len(rank)))
            assert (symbols[k], symbols[k + 1]) in rank, token
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        assert symbols == [token]


def test_plain_words_are_learned_at_once_and_looked_up_once_a_portion():
    class Counted(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

    rng = random.Random(3)
    words = ["".join(rng.choices("abcéß0123.,(-_/", k=rng.randint(1, 12))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(20)]
    encode = WordEncoder()
    encode._tokenizer, encode._number = None, Counted(encode._number)  # the whole library is not asked
    for _ in range(2):
        ids, lengths = encode([t.encode() for t in texts], [True] * len(texts))
        edges = np.cumsum(lengths)
        assert [ids[a:b].tolist() for a, b in zip(edges - lengths, edges)] == [whole(t) for t in texts]
    assert encode._number.asked <= 2 * (len(set(words)) + 1)


def test_any_bytes_and_blanks():
    texts = [b"a" + bytes([b]) + b"Bc" + bytes([b]) for b in range(256)]
    texts += [b"", b" ", b"\x0b\x0c", b"x\xe2\x82\n\x82y", b"\x1f\x1fa\x1f b\x1c", b"\xf0\x9f\x98", b"a1" * 200 + b" " + b"b" * 257]
    encode = WordEncoder()
    ends = [k % 3 != 1 for k in range(len(texts))]
    ids, lengths = encode(texts, ends)
    edges = np.cumsum(lengths)
    for text, end, a, b in zip(texts, ends, edges - lengths, edges):
        assert ids[a:b].tolist() == whole(text.decode("utf-8", "replace"))[: None if end else -1]


def test_segments_lose_nothing_but_a_blank():
    text = b"ab  cd\nefghi j" * 9 + b"x" * 50
    parts = list(segments(text, 10))
    assert b" ".join(parts).split() == text.split() and len(parts) > 5
    assert list(segments(b"", 10)) == [b""]
    encode = WordEncoder()
    ids, lengths = encode(parts, [k == len(parts) - 1 for k in range(len(parts))])
    assert ids.tolist() == whole(text.decode()) and len(lengths) == len(parts)


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 31, 32])
def test_round_trip_at_any_width(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    packed = pack_bits(ids, bits)
    assert len(packed) == -(-1000 // 64) * 8 * bits
    assert unpack_bits(packed, bits)[:1000].tolist() == ids.tolist()
    plain = int.from_bytes(packed, "little")
    assert [plain >> (k * bits) & ((1 << bits) - 1) for k in range(1000)] == ids.tolist()


def test_least_bits():
    assert [id_bits(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access_and_damage():
    rng = np.random.default_rng(3)
    writer, kept = ShardWriter(15, 128), []
    for doc in (None, -5, 7, 7):
        writer.begin(doc)
        kept.append(rng.integers(0, 1 << 15, int(rng.integers(1, 500)), dtype=np.uint32))
        writer.add(kept[-1])
    data = writer.close(3, 4)
    shard, all_ids = Shard(data), np.concatenate(kept)
    assert (shard.partition, shard.number, shard.n_ids) == (3, 4, len(all_ids))
    assert shard.lengths.tolist() == [len(k) for k in kept] and shard.known.tolist() == [False, True, True, True]
    for start in range(0, len(all_ids), 37):
        for count in (0, 1, 63, 200, 5000):
            assert shard.ids(start, count).tolist() == all_ids[start : start + count].tolist()
    assert np.concatenate([shard.block(k) for k in range(len(shard.block_at))]).tolist() == all_ids.tolist()
    broken = bytearray(data)
    broken[40] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        Shard(bytes(broken)).block(0)
    with pytest.raises(ValueError, match="whole"):
        Shard(data[:-3])


@pytest.mark.parametrize("shard_bytes, block_ids", [(32 << 20, 65536), (300, 64)])
def test_against_brute_force(spark, shard_bytes, block_ids):
    rng = random.Random(5)
    rows = [(i * 3 - 40, " ".join(rng.choices(["Aa", "b?", "ünd", "1234", "\n", "tokens"], k=rng.randint(0, 60)))) for i in range(150)]
    rows += [(None, None), (999, ""), (998, "y" * 3000)]
    rng.shuffle(rows)
    at = folder(spark)
    write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), at, shard_bytes=shard_bytes, block_ids=block_ids)
    expected = in_order(rows)
    found = read_tokens(spark, at).collect()
    assert sorted(((r["start"], r["doc_id"], r["ids"]) for r in found), key=lambda r: r[0]) == [(s, d, ids) for d, s, ids in expected]
    short = {r["start"]: r["ids_crc32"] for r in read_tokens(spark, at, ids=False).collect()}
    assert short == {s: zlib.crc32(np.array(ids, "<u4")) for _, s, ids in expected}
    if shard_bytes == 300:
        assert spark.read.format("binaryFile").load(at).count() > 10


def test_messy_rows(spark, messy, nothing):
    at = folder(spark)
    write_tokens(messy, at, shard_bytes=1000)
    found = sorted(read_tokens(spark, at).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in messy_rows()), key=lambda d: (d is not None, d))
    assert sorted((str(r["doc_id"]), r["ids"]) for r in found) == sorted((str(d), whole(t)) for d, t, *_ in messy_rows())
    assert [r["start"] for r in found] == [sum(x["n_tokens"] for x in found[:k]) for k in range(len(found))]
    at = folder(spark)
    write_tokens(nothing, at)
    assert read_tokens(spark, at).count() == 0


def test_many_equal_rows_spread(spark):
    at = folder(spark)
    write_tokens(spark.range(0, 4000, 1, 8).select(F.lit(5).alias("doc_id"), F.lit("same text").alias("text")), at)
    found = read_tokens(spark, at, ids=False)
    assert found.agg(F.countDistinct("start"), F.max("start")).first()[:] == (4000, 3999 * len(whole("same text")))


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    found = op13_token_files(spark, small).collect()
    expected = [(d, s, len(ids), zlib.crc32(np.array(ids, "<u4"))) for d, s, ids in in_order([tuple(r) for r in docs])]
    assert sorted(tuple(r) for r in found) == sorted(expected)
