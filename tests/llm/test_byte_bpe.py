"""Byte-level BPE against the tiktoken library, and exact round trips."""

import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tmweave.llm import byte_bpe
from tmweave.llm.byte_bpe import RANKS, decode, encode, load_ranks, piece_encoder

PATH = public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH),
                             special_tokens={})


def texts(seed=1):
    rng = random.Random(seed)
    odd = ["", " ", "\n\n  x", "a" * 5000, "ab" * 3000, "<|endoftext|> don't we'll", "é" * 700, "中文字" * 300,
           "🙂👍🏽 ‍́", "\x00\x01\r\n\t", "1234567890" * 50, "    x  ", "A.B,C;;;;"]
    for n in (3, 30, 99, 100, 101, 400):
        odd += ["".join(rng.choice("aeinorstThe N'") for _ in range(n)) for _ in range(60)]
        odd += ["".join(chr(rng.randrange(1, 0x3000)) for _ in range(n)) for _ in range(20)]
    return odd


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_equals_library(spark, library, monkeypatch):
    data = list(enumerate(texts())) + [(-1, None), (-2, "the cat"), (-2, "the cat"), (None, "x")]
    df = spark.createDataFrame(data, "doc_id long, t string").repartition(3)
    got = decode(encode(df, PATH, public_tokenizers.PATTERN, text="t"), PATH).collect()
    assert len(got) == len(data)
    by = {r["doc_id"]: r for r in got}
    for i, t in data:
        want = library.encode_ordinary(t or "")
        assert ids(by[i]["ids"]) == want and by[i]["n_tokens"] == len(want)
        assert bytes(by[i]["decoded"]) == (t or "").encode()


def test_windows_and_memory_change_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "WHOLE_CHARS", 50)
    monkeypatch.setattr(byte_bpe, "MATCHES", 7)
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 5)
    monkeypatch.setattr(byte_bpe, "MEMO_CHARS", 3)
    coder = byte_bpe._Coder(load_ranks(PATH), public_tokenizers.PATTERN)
    some = texts(2)
    assert [ids(p) for p in coder.texts(some)] == [library.encode_ordinary(t) for t in some]


def plain(ranks, piece):
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks),
                   default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_any_ranks(library):
    """Ranks in any order, also such that a join makes a lower one possible."""
    rng = random.Random(4)
    for _ in range(60):
        tokens = [bytes([c]) for c in b"abc"] + list({bytes(rng.choices(b"abc", k=rng.randrange(2, 6)))
                                                      for _ in range(30)})
        order = rng.sample(range(400), len(tokens))
        ranks = dict(zip(tokens, order))
        run = piece_encoder(ranks)
        pieces = [bytes(rng.choices(b"abc", k=rng.randrange(1, 40))) for _ in range(30)]
        assert [ids(p) for p in run(pieces)] == [plain(ranks, p) for p in pieces]


@pytest.mark.parametrize("many", [1, 4, 24])
def test_any_ranks_in_arrays(monkeypatch, many):
    """Buckets joined as arrays: any ranks, repeats that overlap, a byte that is no token, empty pre-tokens."""
    monkeypatch.setattr(byte_bpe, "MANY", many)
    rng = random.Random(many)
    for letters in (b"a", b"ab", b"abc", b"abcd"):
        for _ in range(25):
            tokens = [bytes([c]) for c in b"abcd"] + list({bytes(rng.choices(letters, k=rng.randrange(2, 6)))
                                                           for _ in range(30)})
            ranks = dict(zip(tokens, rng.sample(range(400), len(tokens))))
            pieces = [bytes(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(60)]
            assert [ids(p) for p in piece_encoder(ranks)(pieces)] == [plain(ranks, p) for p in pieces]
    run = piece_encoder({b"a": 0, b"xa": 1, b"axa": 2})          # x alone is no token and gives no id
    assert [ids(p) for p in run([b"xa", b"x", b"axa", b"xax", b"aaxaxa"] * 9)] == [[1], [], [2], [1], [0, 2, 1]] * 9


def test_many_pieces_are_joined_together(library):
    """Distinct pre-tokens of one bucket are joined as arrays, not one after the other in Python."""
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return dict.get(self, *a)

    ranks, rng = Counted(load_ranks(PATH)), random.Random(5)
    words = list({"".join(rng.choices(["th", "he", "in", "er", "an", "on", "st", "ing"], k=rng.randrange(2, 6)))
                  for _ in range(20_000)})
    run = piece_encoder(ranks)
    ranks.asked = 0
    assert [ids(p) for p in run([w.encode() for w in words])] == [library.encode_ordinary(w) for w in words]
    assert ranks.asked < len(words)


def test_very_long_piece(library):
    run = piece_encoder(load_ranks(PATH))
    piece = "ab" * 2_200_000 + "c"            # over the size held as lists
    got = run([b"", b"x", piece.encode(), b"yz"])
    assert got[0] == b"" and b"".join(library.decode_single_token_bytes(i) for i in ids(got[2])) == piece.encode()
    short = library.encode_ordinary("ab" * 1000)
    assert ids(got[2])[:len(short) - 2] == short[:-2]


def test_edges(spark):
    schema = "doc_id string, text string, ids string, n_tokens int, decoded string, t int"
    empty = encode(spark.createDataFrame([], schema), PATH, public_tokenizers.PATTERN)
    assert decode(empty, PATH).count() == 0
    df = spark.createDataFrame([("a", "b c", "i", 1, "d", 2)], schema)
    got = encode(df, PATH, public_tokenizers.PATTERN).collect()
    assert [tuple(got[0])[:2]] == [("a", 2)]
    packed = spark.createDataFrame([(1, None, "o"), (2, bytearray(), "o")], "k int, ids binary, decoded string")
    assert {r["k"]: r["decoded"] for r in decode(packed, PATH).collect()} == {1: None, 2: bytearray()}
    bad = spark.createDataFrame([(bytearray(struct.pack("<I", 60000)),)], "ids binary")
    with pytest.raises(Exception):
        decode(bad, PATH).collect()


def test_query_digests(spark, library):
    import hashlib
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in byte_bpe.op13_byte_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect():
        want = library.encode_ordinary(r["t"])
        assert got[r["doc_id"]] == (len(want), hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest(),
                                    hashlib.sha256(r["t"].encode()).hexdigest())
