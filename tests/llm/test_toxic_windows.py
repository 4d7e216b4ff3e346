"""Toxicity of phrases, of words with symbols inside and of scripts without spaces."""

import random

import pytest

from decilog.llm import toxicity

COMMON = "go back home you are not one of us they went to the river and then came along river bank".split()
HAN = "我你他们来去天地山水火木中国大小上下左右前后东西南北"


def rows_of(kind, seed, n=600):
    rng = random.Random(seed)
    bad = {"phrase": ["go", "home", "you"], "symbol": ["river#7"], "dense": ["山火你"]}[kind]
    rows = []
    for k in range(n):
        words = ["".join(rng.choice(HAN) for _ in range(12)) if kind == "dense" else rng.choice(COMMON) for _ in range(rng.randint(40, 80))]
        if kind == "dense":
            words = [w.replace("山火你", "山水你") for w in words]
        else:
            words = [w for i, w in enumerate(words) if words[max(0, i - 2) : i + 1] != ["go", "home", "you"]]
        toxic = k % 4 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [words[at][:5] + bad[0] + words[at][5:]] if kind == "dense" else bad
        rows.append((k, ("" if kind == "dense" else " ").join(words), int(toxic)))
    return rows


@pytest.mark.parametrize("kind", ["phrase", "symbol", "dense"])
def test_more_than_single_words_is_found(spark, kind):
    rows = rows_of(kind, 7)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [(got[k].predicted, y) for k, _, y in rows if got[k].held_out]
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held) > 20
    assert sum(p for p, y in held if not y) <= 0.02 * len(held)


def test_nothing_selected_is_dropped():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    bad, rows = [word() for _ in range(900)], []
    for k in range(1200):
        words = [word() for _ in range(20)]
        rows.append((" ".join(words + (rng.sample(bad, 40) if k % 3 == 0 else [])), int(k % 3 == 0)))
    pair = toxicity.train_dictionaries(rows)
    assert all(f" {w} ".encode() in pair.toxic for w in bad if sum(f" {w} " in f" {t} " for t, _ in rows) >= 16)
    packer = pair.compressors()[1]
    assert max(len(packer.compress(toxicity.window(w))) for w in bad[:300] if toxicity.window(w) in pair.toxic) <= pair.base + 2
