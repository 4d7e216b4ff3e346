"""Extraction, URL verdicts, licences, toxicity, line labels and chats on small fixtures."""

import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from decilog.llm import chat, html_extract, license_scan, line_crf, toxicity, url_filter
from decilog.llm.html_pages import labelled_pages

# --- HTML ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def tree():
    return html_extract.fit(labelled_pages())


def test_labelled_pages_are_learned(tree):
    parse = html_extract.Parser()
    for page in labelled_pages():
        nodes = parse(page)
        gold, found = html_extract.gold_labels(nodes), tree.marginals(nodes)
        assert [(n.text, g) for n, g, p in zip(nodes, gold, found) if n.text and (p >= 0.5) != g] == []


def test_messages_equal_enumeration(tree):
    nodes = html_extract.Parser()("<body><nav><a href=1>Home</a></nav><div><p>A text that is long enough to be read by somebody.</p><p>x</p></div></body>")
    assert len(nodes) <= 12

    def weight(y):
        total = sum(tree.odds(n.features) for n, v in zip(nodes, y) if v)
        for k in range(1, len(nodes)):
            pair = tree.pair["element" if nodes[k].text is None else "run"]
            total += [0.0, *pair][2 * y[nodes[k].up] + y[k]]
        return math.exp(total)

    sums = np.zeros(len(nodes))
    whole = 0.0
    for y in itertools.product((0, 1), repeat=len(nodes)):
        w = weight(y)
        whole += w
        sums += w * np.array(y)
    assert np.allclose(sums / whole, tree.marginals(nodes))


PAGE = """<html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>Menu</a><li><a href=/b>More</a></ul></nav><!-- ad -->
<div class="cookie-banner">We use cookies to make this site better for everybody.</div><article><h1>Title &amp; more</h1><p>First   paragraph of the text,
with <b>bold</b> words&nbsp;in it.<p>Second one is here as well, &lt;tag&gt; and all.</p>{}</article><section class="comments"><p>I liked this text very much, thank you.</p></section><aside><p>Read also</p></aside><footer>&copy; 2020 All rights reserved.</footer>"""


def test_article_without_the_rest(tree):
    text = html_extract.main_text(PAGE.replace("{}", "<p>All rights reserved."), html_extract.Parser(), tree)
    assert text == "Title & more\n\nFirst paragraph of the text, with bold words in it.\n\nSecond one is here as well, <tag> and all.\n\nAll rights reserved."


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", None), (4, "w", "<article><p>Cut off in the mid", "y"), (4, "w", "no markup at all <", "y")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = {(r.page_id, r.text): r for r in got}
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and (2, "") in by and (3, "") in by and (4, "Cut off in the mid") in by
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


SENTENCE = "The survey followed the river for nine days and noted every change of its banks."


@pytest.mark.parametrize("inner,want", [
    ('<p><a href="broken>link text</a> goes on, here and there.</p>', "link text goes on, here and there."),
    (f'<p><a href="/x">{SENTENCE}</a></p>', SENTENCE),
    ('<p title="a > b">A title with a mark in it is no text.</p>', "A title with a mark in it is no text."),
    ("<!--> <p>An empty comment ends at once, and text goes on.</p>", "An empty comment ends at once, and text goes on."),
    ("<p>The page is cut off within a tag. <a hre", "The page is cut off within a tag."),
])
def test_broken_markup_and_links_in_an_article(tree, inner, want):
    page = f"<body><nav><a href=/x>Menu</a></nav><article><h1>Survey</h1><p>{SENTENCE}</p>{inner}"
    assert html_extract.main_text(page, html_extract.Parser(), tree) == f"Survey\n\n{SENTENCE}\n\n{want}"


@pytest.mark.parametrize("junk", ["<p ", '<p class="', "<a href='", "<!", "<![CDATA[", "<![CDATA[>", "<!--", "</p", "</script", "<script>", "<span>"])
def test_long_broken_pages_take_linear_time(tree, junk):
    began = time.process_time()
    html_extract.main_text(f"<article><p>{junk * (1_000_000 // len(junk))}", html_extract.Parser(), tree)
    assert time.process_time() - began < (4 if junk == "<span>" else 2)  # a second on a free machine


# --- URLs ---------------------------------------------------------------------


def rule_truth(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for _, rule in url_filter.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


URLS = [None, "", "no scheme", "http://A.Example.NET/en/x", "http://x.net", "http://x.net/", "https://example.com/de/", "https://notexample.com/de/", "ftp://a.org/fr/1?x=://b.net/", "http://a.org?p=/fr/", "http://h.example.net/de/#/en/", "x://y://z.net/", "http://é.NET/", "http://www.casino-win.example.com/1", "http://good.example.com/2?a=1&b=2"]


def test_url_rules(spark):
    rows = [(k, u, "clash") for k, u in enumerate(URLS * 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.judge(df, url_filter.listed_labels(df.select("url"))).collect()
    assert len(got) == len(rows)
    verdicts = {r: v for v, r in url_filter.RULES}
    for r in got:
        assert (r.host, r.path, r.rule) == rule_truth(URLS[r.page_id % len(URLS)])
        assert r.verdict == verdicts[r.rule] if r.rule else r.verdict in ("allow", "block")


def test_url_trees_learn_listed_hosts(spark):
    rng = random.Random(1)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    urls = [f"http://{name()}.example.com/{rng.randint(1, 99)}" for _ in range(200)] + [f"http://{rng.choice(['adult', 'casino', 'bets'])}-{name()}.example.com/{k}" for k in range(80)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(df, url_filter.listed_labels(df)).collect()
    assert sum((r.verdict == "block") == (r.page_id >= 200) for r in got) >= 0.95 * len(urls)


def test_url_trees_on_hosts_without_labels(spark):
    """Hosts are split: no URL of a judged host is labelled, and blocked hosts show in their form."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioubdfgklmnprst") for _ in range(rng.randint(4, 8)))
    rows = []
    for h in range(160):
        bad = h % 3 == 0
        host = f"{word()}-{word()}{rng.randint(10, 999)}.{rng.choice(['top', 'win', 'com'])}" if bad else f"{word()}.{rng.choice(['com', 'org', 'edu'])}"
        rows += [(h, f"http://{host}/{word()}/{rng.randint(1, 99999)}" + ("?a=1&b=2&c=3" if bad and k % 2 else ""), float(bad)) for k in range(12)]
    known = spark.createDataFrame([(u, y) for h, u, y in rows if h % 2], "url string, label double")
    got = url_filter.judge(spark.createDataFrame([(i, u) for i, (h, u, _) in enumerate(rows) if h % 2 == 0], "page_id long, url string"), known).collect()
    truth = {i: y for i, (_, _, y) in enumerate(rows)}
    right = [(r.verdict == "block", truth[r.page_id] == 1) for r in got]
    assert sum(p for p, y in right if y) >= 0.9 * sum(y for _, y in right)
    assert sum(p for p, y in right if not y) <= 0.1 * sum(not y for _, y in right)


def test_url_statistics_leave_the_own_host_out(spark):
    rows = [("http://a.x.com/1", 1.0), ("http://a.x.com/2", 1.0), ("http://b.x.com/1", 0.0)]
    known = url_filter.with_lexical(spark.createDataFrame(rows, "url string, label double"))
    got = {r.host: r for r in url_filter.with_suffix_statistics(known, url_filter.share_tables(known)).distinct().collect()}
    prior = url_filter.PRIOR * 2 / 3
    assert got["a.x.com"].domain_share == pytest.approx(prior / (1 + url_filter.PRIOR)) and got["b.x.com"].suffix_share == pytest.approx((2 + prior) / (2 + url_filter.PRIOR))
    assert got["a.x.com"].domain_log_n == pytest.approx(math.log(2))


def test_url_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty, url_filter.listed_labels(empty)).collect() == []
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge(one, url_filter.listed_labels(one)).first().verdict == "allow"


# --- licences -----------------------------------------------------------------


def test_licences_and_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/x.py", "print()"), (3, "a/b/c/LICENSE", "intro\n" + apache + "\nend"), (4, "a/b/c/d/y.py", None), (5, "z/w.py", "licensed to kill the river"), (6, None, mit),
        (7, None, ""), (8, "top.py", ""), (9, "a/b/c/own.py", "x\n" + mit),
    ]
    df = spark.createDataFrame([(a, b, c, "clash") for a, b, c in rows], "file_id long, path string, text string, license string")
    got = {r.file_id: (r.own_license, r.license, r.found_in) for r in license_scan.scan(df).collect()}
    assert got == {
        1: ("MIT", "MIT", "a/LICENSE"), 2: (None, "MIT", "a"), 3: ("Apache-2.0", "Apache-2.0", "a/b/c/LICENSE"), 4: (None, "Apache-2.0", "a/b/c"), 5: (None, None, None),
        6: ("MIT", "MIT", None), 7: (None, None, None), 8: (None, None, None), 9: ("MIT", "MIT", "a/b/c/own.py"),
    }
    assert license_scan.scan(df.limit(0)).collect() == []


def test_wrapped_notices_and_licence_texts(spark):
    gpl = "/* This program is free software: you can redistribute it and/or modify it\n * under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version {} of the License, or\n * (at your option) any later version.\n */\nint main() {{}}"
    mit = "The MIT text\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal\nin the Software without restriction"
    bsd = "are met:\n\nNeither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission."
    rows = [(1, "a/x.c", gpl.format(3)), (2, "a/y.c", gpl.format(2)), (3, "b/LICENSE", mit), (4, "b/c/d/e.py", "print()"), (5, "c/LICENSE", bsd), (6, "c/z.py", "the river and the software of the bank")]
    df = spark.createDataFrame(rows, "file_id long, path string, text string")
    got = {r.file_id: (r.license, r.found_in) for r in license_scan.scan(df).collect()}
    assert got == {1: ("GPL-3.0", "a/x.c"), 2: ("GPL-2.0", "a/y.c"), 3: ("MIT", "b/LICENSE"), 4: ("MIT", "b"), 5: ("BSD-3-Clause", "c/LICENSE"), 6: ("BSD-3-Clause", "c")}


def test_licence_scores_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = sorted({t for _, _, t, _ in license_scan.template_terms()}) + ["river", "bank"]
    texts = ["\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9))) for _ in range(3)) for _ in range(60)] + [t for ts in license_scan.TEMPLATES.values() for t in ts]
    df = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    got = {(r.file_id, r.line): (r.license, r.score) for r in license_scan.match_lines(df, 0.7).collect()}
    terms_of = [re.findall(license_scan.TERM, t.lower()) for t in texts]
    idf = {t: license_scan.rarity(len(texts), sum(t in x for x in terms_of)) for t in vocabulary}
    unknown = license_scan.rarity(len(texts), 0)
    templates = {}
    for name, number, t, n in license_scan.template_terms():
        templates.setdefault((name, number), {})[t] = n * idf[t]
    truth = {}
    known = {t for _, _, t, _ in license_scan.template_terms()}
    for f, text in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            own = re.findall(license_scan.TERM, line.lower())
            v = {t: own.count(t) * (idf[t] if t in known else unknown) for t in set(own)}
            norm = math.sqrt(sum(x * x for x in v.values()))
            scores = [(round(sum(v.get(t, 0) * w for t, w in tt.items()) / norm / math.sqrt(sum(w * w for w in tt.values())), 6), name) for (name, _), tt in templates.items()] if norm else []
            if scores and max(scores)[0] >= 0.7:
                truth[f, k] = max(scores)[::-1]
    assert {k: (n, pytest.approx(s, abs=2e-6)) for k, (n, s) in truth.items()} == got


# --- toxicity -----------------------------------------------------------------


def toxic_rows(seed, n):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    bad = ["stupid", "loser", "idiot", "moron"]
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows(1, 900)
    docs = spark.createDataFrame([(k, t, "1") for k, t, _ in rows] + [(5000, None, "0"), (5001, "", "0")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(k, y, 1) for k, _, y in rows], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == 902 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values()) and not got[5000].predicted
    held = [(got[k].predicted, y) for k, _, y in rows if got[k].held_out]
    assert len(held) > 200 and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert sum(p for p, y in held if not y) == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got.values())


def test_toxicity_never_learns_from_held_out_labels(spark):
    rows = toxic_rows(2, 300)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    base = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    turned = base.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda labels: {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    assert score(base) == score(turned)


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert toxicity.score_documents(docs, none).first().score == 0.5
    assert toxicity.score_documents(docs.limit(0), none).collect() == []


# --- lines --------------------------------------------------------------------


def base_truth(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines = text.split("\n")
    dup = sum(1 for k, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line) and line in lines[:k])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_equal_brute_force():
    rng = random.Random(3)
    bits = ["a", "b b", "c\xa0d", "é", "#*", "|", "\n", "\t", "\x0b", " ", "a a a a a a", "x y z u v", "\x1c", "\u2028"]
    for _ in range(400):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        assert line_crf.describe(text)[0] == base_truth(text), repr(text)
    assert line_crf.describe(None)[0] == (0, 0, 0, 0, 0)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(4)
    for n in range(1, 8):
        crf = line_crf.LineCrf(rng.normal(size=(2, line_crf.N_FEATURES)), rng.normal(size=(2, 2)))
        rows = rng.integers(0, 2, size=(n, line_crf.N_FEATURES)).astype(float)
        score = lambda y: sum(rows[k] @ crf.weights[v] for k, v in enumerate(y)) + sum(crf.trans[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert tuple(crf.viterbi(rows)) == best


def test_quality_verdicts(spark):
    rng = random.Random(5)
    good = lambda: "\n".join(" ".join(rng.choice("river bank bird depth map course night old new".split()) + str(rng.randint(1, 999)) for _ in range(14)) + "." for _ in range(6))
    bad = lambda: " | ".join(str(rng.randint(1, 10**6)) for _ in range(60))
    rows = [(k, good() if k % 2 else bad(), k % 2) for k in range(120)]
    docs = spark.createDataFrame([(k, t, True) for k, t, _ in rows] + [(500, None, True), (501, "", True), (502, "too few words", True)], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k < 80], "doc_id long, quality int")
    got = {r.doc_id: r for r in line_crf.judge_documents(docs, labels).collect()}
    assert len(got) == 123 and all(got[k].base_failed and not got[k].kept for k in (500, 501, 502))
    assert all(got[k].kept == bool(y) for k, _, y in rows if k >= 80)
    kept = line_crf.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 60
    assert line_crf.judge_documents(docs.limit(0), labels.limit(0)).collect() == []


# --- chats --------------------------------------------------------------------


def chat_truth(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r, x))
    turns = {c: tuple((r, x) for _, r, x in sorted(v, key=lambda t: (t[0], t[1] or "", t[1] is not None, t[2] or "", t[2] is not None))) for c, v in convs.items()}
    kept = {c: t for c, t in turns.items() if not any(len(o) > len(t) and o[: len(t)] == t for o in turns.values())}
    return {c: len(t) for c, t in kept.items() if c == min(x for x, y in kept.items() if y == t)}


def test_snapshots_collapse(spark):
    rng = random.Random(6)
    rows = []
    for c in range(60):
        base = rng.choice([["hi", "a", "b", "c", "d"], ["hi", "x", "y"], ["yo", "a"]])
        n = rng.randint(1, len(base))
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", base[t]) for t in range(n)]
    rows += [(90, 0, "user", None), (91, 0, "user", ""), (92, 0, None, ""), (93, 0, "user", None), (93, 1, "assistant", "z"), (94, 0, "us", "erx"), (95, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, chat string").repartition(4)
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert {c: r.n_turns for c, r in got.items()} == chat_truth(rows)
    assert got[95].chat == "<|im_start|>user\nx<|im_end|>\n" and got[92].chat == "<|im_start|>user\n<|im_end|>\n"
    assert chat.format_chats(df.limit(0)).collect() == []


def test_rows_without_a_conversation_stand_alone(spark):
    rows = [(None, 5, "user", "a"), (None, 1, "user", "a"), (None, 2, "user", "lone"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "x"), (None, 0, "user", "x")]
    got = sorted(((r.conv_id, r.n_turns, r.copies, r.chat) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    say = lambda *t: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)
    assert got == sorted([(1, 2, 1, say(("user", "a"), ("assistant", "b"))), (2, 1, 2, say(("user", "x"))), (None, 1, 1, say(("user", "lone")))], key=str)


def test_long_conversation_and_its_snapshots(spark):
    rows = [(c, t, "user", f"turn {t}") for c, n in ((1, 3000), (2, 2999), (3, 1)) for t in range(n)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.n_turns, r.copies) for r in got] == [(1, 3000, 1)]


def mixed_texts(seed, n=200):
    """(text, quality, words of content lines): texts of prose, and of separators under a line of prose."""
    rng = random.Random(seed)
    prose = lambda: " ".join(rng.choice("river bank bird depth map course night old new".split()) + str(rng.randint(1, 99)) for _ in range(14)) + "."
    menu = lambda: " | ".join(rng.choice("home news sport shop help about".split()) + str(rng.randint(1, 999)) for _ in range(12))
    rows = []
    for k in range(n):
        good = k % 2
        rows.append(([prose() for _ in range(rng.randint(3, 8))] + [menu()] * (k % 4 == 1) if good else [prose()] + [menu() for _ in range(rng.randint(3, 8))], good))
    return rows


def test_lines_of_one_text_get_different_labels():
    """Only documents are labelled; a tail of separators is split off at the right line."""
    texts = mixed_texts(3)
    model = line_crf.fit_lines([(*line_crf.describe("\n".join(lines))[1:], y) for lines, y in texts])
    assert all(abs(model.trans[a, b]) > 0 for a in (0, 1) for b in (0, 1))
    right = total = 0
    for lines, _ in mixed_texts(4):
        found = model.viterbi(line_crf.describe("\n".join(lines))[1])
        right += sum(int(v) == ("|" not in line) for v, line in zip(found, lines))
        total += len(lines)
    assert right >= 0.98 * total


def test_all_lines_of_long_texts_are_learned_from():
    """What tells good from bad stands after line 200 only."""
    head = ["A plain line of ten words stands here, again and again."] * 200
    rows = [(*line_crf.describe("\n".join(f"{i} {h}" for i, h in enumerate(head)) + "\n" + "\n".join(["a | b | c | d | e"] * (400 if k % 2 else 0)))[1:], 1 - k % 2) for k in range(12)]
    model = line_crf.fit_lines(rows)
    assert model.viterbi(line_crf.describe("x | y | z | w\n" * 3)[1]).sum() == 0
