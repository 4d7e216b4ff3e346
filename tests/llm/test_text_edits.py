"""Edits of encoded texts against encoding the whole text again."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from decilog.llm import byte_bpe  # noqa: E402

PARTS = ["word", " and", "'", "ll", "'re", "I'l", "l", " ", "  ", "\n", "\n\n", "12", "3.5", "é", "日本", "🙂", "...", "x" * 90, "ab" * 200, "A", "_", "\t "]


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.TextCoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_edited_texts_equal_texts_encoded_anew(coder):
    rng = random.Random(2)
    for _ in range(60):
        table = byte_bpe.TextTable(coder, "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 40))))
        for _ in range(25):
            n = len(table.text)
            start = rng.randrange(n + 1)
            end = min(n, start + rng.choice([0, 0, 1, 3, 20]))
            new = "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 1, 2])))
            want = table.text[:start] + new + table.text[end:]
            table.replace(start, end, new)
            assert table.text == want == "".join(table.pieces) and table.ids() == coder.encode(want), (want, start, end, new)
            assert table.starts == [sum(map(len, table.pieces[:k])) for k in range(len(table.pieces))]


def test_an_edit_cuts_few_pieces_anew(coder):
    table = byte_bpe.TextTable(coder, " ".join(f"word{k}" for k in range(5000)))
    assert table.replace(12_000, 12_003, "new") <= 12 and table.append(" more") <= 8 and table.ids() == coder.encode(table.text)


def test_a_piece_is_filled_again_only_near_the_edit(coder):
    rng = random.Random(7)
    data = "".join(rng.choice("abcdefgh") for _ in range(6000)).encode()
    table = byte_bpe.PrefixTable(coder.coder, data)
    for start, end, new in ((3000, 3001, b"z"), (10, 10, b"qq"), (2500, 2700, b""), (5990, 5995, b"k" * 9)):
        filled = table.replace(start, end, new)
        data = data[:start] + new + data[end:]
        assert table.data == data and table.ids() == coder.coder.encode(data) and filled <= 4 * coder.coder.longest + len(new)
