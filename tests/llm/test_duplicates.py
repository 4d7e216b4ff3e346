"""Exact and near duplicates, and components, against brute force."""

import hashlib
import random
import re

import pytest

from decilog.llm import components as cc
from decilog.llm import common, exact_dedup, ngram_join

SPACE = re.compile(r"[\x20\x09-\x0D]")
DOCS = "doc_id long, text string, n string"


def exact_truth(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(SPACE.sub("", text or ""), []).append((-len(text or ""), doc))
    out = {}
    for norm, own in groups.items():
        for _, doc in own:
            keep = min(own)[1]
            out[doc] = (keep, len(own), doc == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


ROWS = [(1, "a b c"), (2, "abc"), (3, " a b c\n"), (4, None), (5, ""), (6, "\t"), (7, "é à"), (8, "éà"), (9, "abcd"), (10, "a\xa0b"), (11, "ab")] + [(100 + k, "same text") for k in range(40)]


@pytest.mark.parametrize("bits,capacity", [(256, 3), (2, 1), (256, 10**6)])
def test_exact_groups(spark, bits, capacity):
    """With two bits of hash every chain holds different texts, told apart by their bytes."""
    df = spark.createDataFrame([(a, b, "clash") for a, b in ROWS], DOCS).repartition(4)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup_groups(df, capacity, digest_bits=bits).collect()}
    assert got == exact_truth(ROWS)


def test_exact_empty_table(spark):
    assert exact_dedup.dedup_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_directory_doubles_only_where_needed():
    counts = {0: 5, 1: 4, 8: 1, 12: 2}  # by four bits
    d = exact_dedup.grow_directory(counts, 5, 4)
    assert d.depth == 4 and d.slots[0] == (0, 4) and d.slots[1] == (1, 4) and d.slots[8] == d.slots[15] == (8, 1)
    assert exact_dedup.grow_directory({}, 5, 4).depth == 0


def test_directory_has_no_overfull_bucket():
    rng = random.Random(2)
    counts = {rng.getrandbits(30): rng.randint(1, 5) for _ in range(3000)}
    d = exact_dedup.grow_directory(counts, 7, 30)
    held = {}
    for prefix, n in counts.items():
        first, local = d.slots[prefix >> (30 - d.depth)]
        held[first, local] = held.get((first, local), 0) + n
    assert max(held.values()) <= 7 and len(d.slots) == 1 << d.depth


def test_rows_find_their_entry_through_the_directory(spark, monkeypatch):
    """A directory that sends rows elsewhere loses them."""
    df = spark.createDataFrame([(a, b, "clash") for a, b in ROWS], DOCS)
    whole = exact_dedup.dedup_groups(df, 3).collect()
    assert len({r.bucket for r in whole}) > 2
    calls, real = [], exact_dedup.with_bucket

    def shifted(entries, directory):
        calls.append(1)
        return real(entries, directory) if len(calls) == 1 else real(entries, directory).withColumn("bucket", exact_dedup.F.col("bucket") + 1)

    monkeypatch.setattr(exact_dedup, "with_bucket", shifted)
    assert len(exact_dedup.dedup_groups(df, 3).collect()) < len(whole)


def near_truth(rows, width, threshold):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two"), (6, "x y z"), (7, "X  Y\tz")]
    base = [[rng.choice(words) for _ in range(rng.randint(5, 80))] for _ in range(12)]
    for k in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.2:
            text += passage
        rows.append((10 + k, " ".join(text)))
    return rows


@pytest.mark.parametrize("width,threshold,hot", [(4, 85, 200), (5, 80, 3), (2, 60, 5)])
def test_near_components(spark, monkeypatch, width, threshold, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "PAIRED", hot)
    rows = corpus(width, 250)
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], DOCS).repartition(3)
    got = ngram_join.jaccard_components(df, width, threshold, bits=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_truth(rows, width, threshold)


def test_near_chain_is_followed_to_its_end(spark):
    """Neighbours in a chain link, its ends do not; all are one component."""
    words = [f"v{k}" for k in range(200)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(40)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.component_id for r in got} == {0}


def test_near_empty_table(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], DOCS)).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(k + 1, k) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5000, 5000)]
    got = {r.id: r.comp for r in cc.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch()).collect()}
    assert all(got[k] == 0 for k in range(301)) and all(got[1000 + k] == 1000 for k in range(50)) and 5000 not in got


def test_rows_that_share_an_id_are_compared_each(spark):
    """Near copies under one id, an id with two texts, rows without an id: components by texts, named by the smallest id."""
    words = [f"w{k}" for k in range(60)]
    a, near, b = " ".join(words), " ".join([*words[:59], "other"]), " ".join(words[::-1])
    rows = [(5, a), (5, b), (3, near), (None, b), (None, near), (9, None), (9, None), (None, "lone words here"), (4, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.jaccard_components(df, 4, 85).collect())
    assert got == sorted([("5", 57, "3"), ("5", 57, "4"), ("3", 57, "3"), ("None", 57, "4"), ("None", 57, "3"), ("9", 0, "9"), ("9", 0, "9"), ("None", 1, "None"), ("4", 57, "4")])
    one = [(k, a) for k in range(3)] + [(7, near)]
    assert {r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(one, "doc_id long, text string"), 4, 85).collect()} == {0}
