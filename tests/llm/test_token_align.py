"""Cross-tokenizer alignment against whole-text encodings by both libraries and plain counting."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from decilog.llm import token_align  # noqa: E402

A, B, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_level():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


def brute(rows, libraries):
    """rows: (doc_id, text); whole texts, every pair of tokens compared by their byte ranges."""
    tokenizer, pieces = libraries
    named, found = byte_level(), []
    for doc, text in rows:
        if not text:
            found.append((doc, [], [], [], 0))
            continue
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        a_bytes = [bytes(named[c] for c in tokenizer.id_to_token(t)) for t in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(pieces.id_to_piece, b)]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            found.append((doc, [], [], [], 0))
            continue
        cuts_a, cuts_b = np.cumsum([0, *map(len, a_bytes)]), np.cumsum([0, *map(len, b_bytes)])
        links = []
        for i in range(len(a)):
            for j in range(max(0, int(np.searchsorted(cuts_b, cuts_a[i], "right")) - 1), len(b)):
                if cuts_b[j] >= cuts_a[i + 1]:
                    break
                links.append((a[i], b[j]))
        both = sorted(set(cuts_a[1:].tolist()) & set(cuts_b[1:].tolist()))
        texts, i, j = [], 0, 0
        for end in both:
            i2, j2 = int(np.searchsorted(cuts_a, end)), int(np.searchsorted(cuts_b, end))
            texts.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        found.append((doc, a, b, links, texts))
    count = Counter(pair for x in found for pair in set(x[3]))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for doc, a, b, links, texts in found:
        sha = hashlib.sha256(";".join(texts).encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(texts) if a else 0, len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), sha))
    return sorted(out, key=str), count, most


def got(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("chunk", "place", "radix", "head", "n_a")}).repartition(parts)
    return sorted((tuple(r[c] for c in COLUMNS) for r in token_align.align_documents(df, A, B, PATTERN).collect()), key=str)


def edges():
    rng = random.Random(6)
    parts = ["river", "Größe", "naïve", "日本語", "a", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "x▁y", "▁", "é", "ﬁ", " ", "\t", "\n", "\n\n", "  ", " ", "   ", "　", "\x1c", "\x00", "12.5", "don't", "I'LL", "🙂", "�", "»", "_", "..."]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "  ", "\n"]) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    return texts + [None, "", " ", "  ", "\n", "x" * 20_000, "word " * 3000, "a  b", " lead", "trail ", "trail\n", "q" * 64, "q" * 65]


def test_edges_equal_whole_texts(spark, libraries):
    rows = [(k, t) for k, t in enumerate(edges())] + [(None, "no id"), (7, "twice"), (7, "twice"), (None, None)]
    assert got(spark, rows) == brute(rows, libraries)[0]
    assert got(spark, []) == []


@pytest.fixture(scope="module")
def some(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(250).collect()]


def test_documents_in_many_runs(spark, libraries, some, monkeypatch):
    want, count, most = brute(some, libraries)
    assert got(spark, some) == want
    for name, value in (("RUN_LINKS", 3000), ("FAN_IN", 3), ("SHARED", 4), ("CACHE", 50)):
        monkeypatch.setattr(token_align, name, value)
    assert got(spark, some, 2) == want
    df = spark.createDataFrame(some, "doc_id long, text string")
    pairs = token_align.vocabulary_map(df, A, B, PATTERN).collect()
    assert {(r.a, r.b): r.docs for r in pairs} == count and all(r.best == (r.docs == most[r.a]) for r in pairs)


def test_copies_share_a_hot_pair(spark, libraries):
    rows = [(k, "one text that many rows share") for k in range(300)] + [(1000 + k, f"one other text {k}") for k in range(30)]
    assert got(spark, rows, 5) == brute(rows, libraries)[0]


def test_group_lists(spark):
    df = spark.createDataFrame([(1, "unbelievable words"), (2, None)], "doc_id long, text string")
    one, two = (r.groups for r in token_align.group_lists(df, A, B, PATTERN).orderBy("doc_id").collect())
    assert two == [] and ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in one) and hashlib.sha256(";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in one).encode()).hexdigest() == got(spark, [(1, "unbelievable words")])[0][-1]


def test_packed_arrays_come_back():
    for n in (0, 1, 5000):
        x, y = np.sort(np.random.default_rng(n).integers(0, 1 << 40, n)), np.arange(n)
        a, b = token_align.unpack(token_align.pack(x, y), "i8", "i8")
        assert (a == x).all() and (b == y).all()
