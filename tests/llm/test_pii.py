"""Personal data: the four forms against the contract's expressions, disclosure against plain counting, and edges."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from decilog.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        odd, even = digits[-1::-2], digits[-2::-2]
        return 12 <= len(digits) <= 19 and (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    """(start, place of the kind, end), by the contract's words."""
    return sorted((m.start(), k, m.end()) for k, (kind, form) in enumerate(FORMS.items()) for m in re.finditer(form, text or "") if holds(kind, m.group()))


def test_forms_equal_the_expressions():
    rng = random.Random(3)
    parts = ["a.b", "@", "x-1", ".", "..", "example.com", "1", "12", "255", "256", "0001", "+", "(", ")", " ", "-", "4952935900253052", "49529359", "00253052", "+1 (243) 555-5526", "10.0.0.1", "é", "\n", "_%", "４", "٣", "@@", "a@b.c@d.e"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert pii.base_spans(text) == brute(text), text


def test_forms_equal_the_expressions_on_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert pii.base_spans(r.text or "") == brute(r.text)


def test_time_is_linear_in_the_text():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "a@b" + "." * 400_000, "+1" * 200_000, "+1" + "(" * 400_000, "1 " * 200_000, "@" * 400_000):
        pii.base_spans(text)


def texts(rng):
    """A person's name near an address in different surroundings, one that is often elsewhere too, copies, and plain texts."""
    words = [f"word{k}" for k in range(60)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [f"{some(5)} Zacharias {some(2)} zk@mail.example.com {some(6)}" for _ in range(6)]
    out += [f"{some(4)} zacharias came home {some(9)}", f"Zacharias, {some(20)}"]
    out += [f"{some(5)} Quellfeld {some(1)} +1 (243) 555-5526 {some(6)}" for _ in range(4)] + [f"{some(8)} quellfeld {some(4)}" for _ in range(9)]
    out += ["onlycopies near 10.20.30.40 in one text that is copied"] * 30
    return out + [some(30) for _ in range(50)] + ["", None, "10.20.30.40"]


def expected(rows):
    """entity, term -> (both, docs, bits) by plain counting."""
    near, docs = defaultdict(list), defaultdict(int)
    for doc, text in enumerate(rows):
        base = brute(text)
        found = [m for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text or "")]
        low = lambda m: re.sub("[A-Z]", lambda x: x.group().lower(), m.group())
        for term in {low(m) for m in found}:
            docs[term] += 1
        clear = [m for m in found if not any(s < m.end() and m.start() < e for s, _, e in base)]
        for s, k, e in base:
            value = text[s:e].lower() if k < 2 else re.sub("[^0-9]", "", text[s:e])
            left, right = [low(m) for m in clear if m.end() <= s][-8:], [low(m) for m in clear if m.start() >= e][:8]
            for term in set(left + right):
                pairs = [f"{a} {b}" for side in (left, right) for a, b in zip(side, side[1:])] or [" ".join([*left, *right])]
                near[f"{list(FORMS)[k]}:{value}", term].append((doc, min(xxhash.xxh64_intdigest(p) for p in pairs)))
    out = {}
    for (entity, term), at in near.items():
        both = len({d for d, _ in at})
        if len({x[1] for x in at}) >= 3 and both * 4 >= docs[term]:
            out[entity, term] = (both, docs[term], math.log2(docs[term] / both))
    return out


@pytest.fixture(scope="module")
def rows():
    return texts(random.Random(8))


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("term", "docs", "own", "spans", "entity")}).repartition(3)


def test_disclosures_equal_plain_counts(spark, rows, monkeypatch):
    want = expected(rows)
    assert {t for _, t in want} >= {"zacharias", "quellfeld"} and "onlycopies" not in {t for _, t in want}
    monkeypatch.setattr(pii, "HELD", 10)
    got = {(r.entity, r.term): (r.both, r.docs, r.bits) for r in pii.disclosures(frame(spark, rows)).collect()}
    assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-9 for k in want)


@pytest.mark.parametrize("most", [pii.MOST, 0])
def test_terms_are_removed_or_generalised_everywhere(spark, rows, most, monkeypatch):
    monkeypatch.setattr(pii, "MOST", most)
    gone = defaultdict(list)
    for (_, term), (_, _, bits) in expected(rows).items():
        gone[term].append(bits <= 1)
    gone = {t: any(x) for t, x in gone.items()}
    assert gone["zacharias"] and gone["quellfeld"] is False
    found = {r.doc_id: r for r in pii.find_personal_data(frame(spark, rows)).collect()}
    names = [*FORMS, "term"]
    for doc, text in enumerate(rows):
        base = brute(text)
        extra = [(m.start(), 4, m.end()) for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text or "") if m.group().lower() in gone and not any(s < m.end() and m.start() < e for s, _, e in base)]
        line = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))
        r = found[doc]
        assert r.spans == line([*base, *extra]) and r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert "[EMAIL]" in clean[0] and "[REMOVED]" in clean[0] and "acharias" not in clean[6] + clean[7] and "[NAME]" in clean[8] and "uellfeld" not in clean[8]
    assert clean[len(rows) - 1] == "[IP]" and clean[len(rows) - 2] == "" and "onlycopies near [IP] in" in clean[25]


def test_edges(spark):
    rows = [(None, "a@b.co"), (None, None), (1, ""), (1, "a@b.co"), (2, "w " * 100_000 + "10.0.0.1"), (3, "🙂 10.0.0.1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.spans) for r in pii.find_personal_data(df).collect())
    assert got == sorted([("None", 1, 0, "email:0:6"), ("None", 0, 0, ""), ("1", 0, 0, ""), ("1", 1, 0, "email:0:6"), ("2", 0, 1, "ip:200000:200008"), ("3", 0, 1, "ip:2:10")])
    assert pii.find_personal_data(df.limit(0)).collect() == []
    nothing = {r.doc_id: r.base_sha256 for r in pii.find_personal_data(df.where("text = ''")).collect()}
    assert nothing == {1: hashlib.sha256(b"").hexdigest()}
