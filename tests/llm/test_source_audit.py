"""The source audit against plain Python on small tables, with its edges."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from decilog.llm import source_audit

ONE = 10**9


def brute(rows, top=200, least=3):
    """rows: (text, lang, source)."""
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        n[lang, source].update(terms)
        df[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t in df[lang] if df[lang][t] >= least]
        v = len(kept)
        p = {}
        for s in sources:
            size = sum(n[lang, s][t] for t in kept)
            p[s] = {t: 1 + ONE * (n[lang, s][t] + 1) // (size + v) for t in kept}
        total = {t: sum(n[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + ONE * (total[t] + 1) // (sum(total.values()) + v) for t in kept}
        for s in sources:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("n", "term", "p", "item", "value", "block")})
    return sorted(map(tuple, source_audit.audit(df.repartition(3), **kw).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{chr(97 + k)}" for k in range(20)] + ["Éa", "ZU", "a1b", "naïve", "日本", "x"]
    made = []
    for k in range(300):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "é", "Z"])
        made.append((" ".join(rng.choice(words[: 5 + k % 22]) for _ in range(rng.randrange(0, 30))), lang, source))
    return made + [(None, "en", "s1"), ("", "en", "empty"), ("12 34", "fr", "only"), (None, "it", "a"), ("", "it", "b"), ("only here", "en", "s9")]


def test_equals_plain_arithmetic(spark, rows, monkeypatch):
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, top_terms=3, least_docs=1) == brute(rows, 3, 1)
    monkeypatch.setattr(source_audit, "BLOCK_ROWS", 7)  # many blocks
    monkeypatch.setattr(source_audit, "SMALL", 0)  # no broadcast
    monkeypatch.setattr(source_audit, "HELD", 5)  # counts handed on often
    assert got(spark, rows) == brute(rows)


def test_ties_repeats_and_one_hot_source(spark):
    rows = [("same words here", "en", s) for s in ("a", "b", "B", "é")] * 4 + [("same words here other", "en", "hot")] * 50
    assert got(spark, rows) == brute(rows)


def test_languages_without_terms_and_empty_tables(spark):
    rows = [("...", "en", "a"), (None, "en", "b"), ("rare", "en", "c")]
    assert got(spark, rows) == [("en", s, "pair", o, 0, k) for s in "abc" for k, o in enumerate([x for x in "abc" if x != s], 1)]
    assert got(spark, []) == [] == got(spark, [(None, None, None)])


def test_very_long_text_and_exact_probabilities(spark):
    rows = [("word " * 200_000 + "tail", "en", "a"), ("tail word", "en", "b"), ("word tail tail", "en", "c")]
    assert got(spark, rows) == brute(rows)
    df = spark.createDataFrame([(4_000_000_000_000, 9_999_999_999_999), (0, 3), (6, 7)], "n long, t long")
    assert [r.p for r in df.select(source_audit.probability("n", "t").alias("p")).collect()] == [1 + ONE * (n + 1) // t for n, t in [(4_000_000_000_000, 9_999_999_999_999), (0, 3), (6, 7)]]


def test_scatter_gathers_in_parts(monkeypatch):
    rng = random.Random(2)
    table = pa.table({"lang": ["en"] * 60, "source": [f"s{k % 6}" for k in range(60)], "term": [f"t{k // 6}" for k in range(60)], "p": [rng.randrange(1, ONE) for _ in range(60)], "p0": [5 + k % 6 for k in range(60)]})
    whole = source_audit.scatter(table)
    monkeypatch.setattr(source_audit, "GATHER", 8)
    assert source_audit.scatter(table).equals(whole)
