"""Byte-level BPE and packing against the public libraries and brute force."""

import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from decilog.llm import byte_bpe, packing

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "É", "'s", " ", "  ", "\n", "½", "٣", "日本", "😀", "\x1c", "\x85", "\xa0", "_", "1", "’", "st", "the", " the", "́", "Ⅷ", "²"]


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.TextCoder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.coder.ranks, special_tokens={})


def test_encode_equals_the_library(coder, reference):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))
        ids = coder.encode(text)
        assert ids == reference.encode_ordinary(text), repr(text)
        assert coder.decode(ids) == text.encode()


def test_long_piece_without_spaces(coder, reference):
    rng = random.Random(2)
    text = "".join(rng.choice("abethins") for _ in range(3000))
    assert coder.encode(text) == reference.encode_ordinary(text)


def test_appends_and_edits_equal_a_fresh_table(coder):
    rng = random.Random(3)
    table = byte_bpe.PrefixTable(coder.coder)
    for _ in range(200):
        if rng.random() < 0.5:
            table.append("".join(rng.choice("thaeinos") for _ in range(rng.randint(1, 4))).encode())
        else:
            a = rng.randint(0, len(table.data))
            b = rng.randint(a, len(table.data))
            table.replace(a, b, "".join(rng.choice("thaeinos") for _ in range(rng.randint(0, 3))).encode())
        assert table.ids() == coder.coder.encode(table.data)


def test_round_trip_query_rows(spark, reference):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "again", None)]
    got = byte_bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, len(reference.encode_ordinary("Hello world"))), (2, 0), (3, 0), (3, 1)]
    ids = byte_bpe.encode_texts(spark.createDataFrame([(1, "Hello world")], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN)
    assert bytes(byte_bpe.decode_ids(ids, RANKS).first()["bytes"]) == b"Hello world"


def check_packing(rows, docs, size):
    tokenizer = Tokenizer.from_file(JSON)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in docs.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        at = 0
        for k, r in enumerate(sorted(pieces.pop(doc), key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= size and (k == 0 or r.length == size)
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert not pieces
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(sequences)


def test_packing_places_every_piece(spark):
    rng = random.Random(4)
    docs = {k: " ".join(rng.choice(["the", "river", "Ünder", "x1"]) for _ in range(rng.choice([0, 1, 5, 20, 60, 200]))) for k in range(150)}
    docs[7] = None
    docs[8] = "hello <|endoftext|> world<|endoftext|>" + " the river" * 80
    df = spark.createDataFrame([(k, t, 1) for k, t in docs.items()], "doc_id long, text string, piece int").repartition(5)
    rows = packing.pack_documents(df, JSON, public_tokenizers.PATTERN, size=64).collect()
    used = check_packing(rows, docs, 64)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 64) + 2


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), JSON, public_tokenizers.PATTERN).collect() == []


def test_plan_replaces_the_smallest_by_two():
    # greedy: 6 + 3, gap 1; the 3 gives way to 2 + 2, which fills the sequence
    plan = packing.plan_patterns({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0] == ((6, 2, 2), 1) and plan[1] == ((3,), 1)


def test_plan_uses_every_piece_once():
    rng = random.Random(5)
    for _ in range(50):
        histogram = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(12)}
        seen = defaultdict(int)
        for lengths, times in packing.plan_patterns(histogram, 40):
            assert sum(lengths) <= 40
            for length in lengths:
                seen[length] += times
        assert seen == histogram
