"""Toxicity by compression distance between two zstandard dictionaries.

One dictionary is made of windows of ordinary text, the other of windows of toxic
text (what marks toxic texts, over the same ordinary stock). A window is one to three
neighbouring tokens between two fixed marks, and windows overlap. If it is typical of
toxic text, the toxic dictionary packs it into about one match while the ordinary one
spells it out; the gain in bytes, less what the toxic dictionary needs beyond one
match, is the window's distance. A text's counts of windows over several distances are
calibrated to a score on labelled texts that the dictionaries in question have not
seen (two halves, each judged by the other's dictionaries).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decilog.llm.common import labelled_texts, need, with_verdict

WORD = re.compile(r"[^\W\d_]+")
#: Letters of scripts without spaces between words: South-East Asian, kana, Han.
DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: One such letter; a word with the digits and symbols inside it; or a run of symbols.
TOKEN = re.compile(rf"[{DENSE}]|[^\W_{DENSE}](?:[^\s{DENSE}]*[^\W_{DENSE}])?|(?:[^\w\s{DENSE}]|_)+")
#: Tokens in the longest window.
WIDTH = 3
#: Marks around a window, and the distances over which windows are counted.
MARK, STEPS = b"<0123>", (1, 3, 6, 9)
#: A level whose search finds a window's match in a dictionary of any size.
LEVEL = 19
#: Distances a worker remembers before it starts afresh.
CACHE = 400_000


def window(words: str) -> bytes:
    return MARK + f" {words} ".encode() + MARK


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def phrases(words: list[str], n: int, within: Container[str]) -> Iterator[tuple[int, str]]:
    """Place and text of the windows of ``n`` tokens that are all ``within``."""
    run = 0
    for k, word in enumerate(words):
        run = run + 1 if word in within else 0
        if run >= n:
            yield k + 1 - n, " ".join(words[k + 1 - n : k + 1])


@dataclass(frozen=True)
class Distances:
    """A pair of dictionaries; ``base``: bytes that a window known to the toxic one takes.

    ``linked``: the tokens of the toxic dictionary's windows of several tokens. It has
    no match for a whole window with any other token, so those are not compressed.
    """

    ordinary: bytes
    toxic: bytes
    base: int
    linked: frozenset[str] = frozenset()

    def compressors(self):
        import zstandard as zs

        made = []
        for content in (self.ordinary, self.toxic):
            shared = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            made.append(zs.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made


class WindowDistance(dict):
    """tokens of a window -> distance, compressed when first asked for."""

    def __init__(self, pair: Distances) -> None:
        self.ordinary, self.toxic = pair.compressors()
        self.base, self.linked = pair.base, pair.linked

    def __missing__(self, words: str) -> int:
        data = window(words)
        toxic = len(self.toxic.compress(data))
        found = len(self.ordinary.compress(data)) - toxic - max(0, toxic - self.base)
        if len(words) <= 64:
            self[words] = found
        return found


def features(text: str | None, distance: WindowDistance) -> list[float]:
    """Largest distance, log counts of windows from each step on, log count of tokens."""
    if len(distance) > CACHE:
        distance.clear()
    words = tokens(text)
    if not words:
        return [0.0] * (len(STEPS) + 2)
    counts = Counter(map(distance.__getitem__, words))
    if distance.linked:
        for n in range(2, WIDTH + 1):
            counts.update(distance[p] for _, p in phrases(words, n, distance.linked))
    at_least = [math.log1p(sum(n for d, n in counts.items() if d >= step)) for step in STEPS]
    return [float(min(max(counts), 12)), *at_least, math.log(len(words))]


def text_key(text: str) -> int:
    """The same for nearly all copies of a text: the least hash of its word triples."""
    words = WORD.findall(text.lower())
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def train_dictionaries(rows: list[tuple[str, int]]) -> Distances:
    """Dictionaries of (text, toxic) rows; all that is selected goes in.

    Windows go to the toxic dictionary if their G statistic against ordinary texts
    exceeds what the best of that many windows would reach by chance (2 ln of their
    number). A longer window must exceed so the toxic share of the chosen windows in
    it; a shorter one must still exceed where it is not inside a chosen longer one.
    """
    known: dict[str, str] = {}  # one string for each distinct token
    split = [(words, toxic, bytearray(len(words))) for words, toxic in (([known.setdefault(w, w) for w in tokens(text)], toxic) for text, toxic in rows)]
    share = sum(toxic for _, toxic in rows) / len(rows)
    seen = (Counter(), Counter())
    for words, toxic, _ in split:
        seen[toxic].update(set(words))
    twice = {w for w, n in seen[1].items() if n >= 2}

    def g(a: int, b: int, share: float) -> float:
        expected = (a + b) * share
        if a <= expected:
            return 0.0
        return 2 * (a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0.0))

    def count(n: int, kind: int, among: Container[str] | None = None) -> Counter:
        texts = ((words, inside) for words, toxic, inside in split if toxic == kind)
        return Counter(p for words, inside in texts for p in {p for k, p in phrases(words, n, twice) if (among is None or p in among) and not all(inside[k : k + n])})

    shares: dict[str, float] = {}
    least = {}
    for n in range(1, WIDTH + 1):
        found = count(n, 1)
        least[n] = 2 * math.log(1 + (len(seen[0]) + len(seen[1]) if n == 1 else len(found)))
        often = {p: k for p, k in found.items() if k >= 2 and g(k, 0, share) > least[n]}
        others = count(n, 0, often)
        for p, k in often.items():
            words = p.split(" ")
            parts = [shares.get(" ".join(words[i:j]), 0.0) for i in range(n) for j in range(i + 1, n + 1) if j - i < n]
            if k > 1.5 * share * (k + others[p]) and g(k, others[p], max([share, *parts])) > least[n]:
                shares[p] = k / (k + others[p])
    marked: dict[str, int] = {}
    for n in range(WIDTH, 0, -1):
        these = {p for p in shares if p.count(" ") == n - 1}
        a, b = count(n, 1, these), count(n, 0, these)
        these = {p for p in these if a[p] >= 2 and a[p] > 1.5 * share * (a[p] + b[p]) and g(a[p], b[p], share) > least[n]}
        marked.update((p, a[p]) for p in these)
        for words, _, inside in split if n > 1 and these else ():
            for k, p in phrases(words, n, twice):
                if p in these:
                    inside[k : k + n] = b"\1" * n
    linked = {w for p in marked if " " in p for w in p.split(" ")}
    ranked = sorted(marked, key=lambda w: (marked[w], w))
    stock = sorted((w for w, n in seen[0].items() if n >= 5), key=lambda w: (seen[0][w], w))
    ordinary = b"".join(f" {w} ".encode() for w in stock) + MARK
    toxic = b"".join(map(window, ranked)) + ordinary
    pair = Distances(ordinary, toxic, 0, frozenset(linked))
    packer = pair.compressors()[1]
    sizes = sorted(len(packer.compress(window(w))) for w in ranked)
    return Distances(ordinary, toxic, sizes[len(sizes) // 2] if sizes else 0, pair.linked)


@dataclass(frozen=True)
class Model:
    """Dictionaries with the calibration: a logistic curve over scaled features."""

    pair: Distances
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = (rows - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights[:-1]) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrate(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit_rows(rows: list[tuple[str, int]]) -> Model:
    """The model of (text, toxic 0/1) rows; with one class alone, its share is the score.

    Of rows with one :func:`text_key` (copies, most near copies, and all texts without
    words) the last in the given order is learned from, whatever its label: else a text in
    both halves would be judged by itself. The others are not used.
    """
    rows = list({text_key(t): (t, y) for t, y in rows}.values())
    n_toxic = sum(y for _, y in rows)
    blank = Distances(MARK, MARK, 0)
    if n_toxic == 0 or n_toxic == len(rows):
        odds = math.log((n_toxic + 0.5) / (len(rows) - n_toxic + 0.5))
        size = len(STEPS) + 2
        return Model(blank, (0.0,) * size, (1.0,) * size, (0.0,) * size + (odds,))
    halves = [[r for k, r in enumerate(rows) if k % 2 == half] for half in (0, 1)]
    x, y = [], []
    for half in (0, 1):
        judge = WindowDistance(train_dictionaries(halves[1 - half]) if halves[1 - half] else blank)
        x += [features(t, judge) for t, _ in halves[half]]
        y += [toxic for _, toxic in halves[half]]
    mean, scale, w = calibrate(np.array(x), np.array(y, float))
    return Model(train_dictionaries(rows), tuple(mean), tuple(scale), tuple(w))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_toxic: int = 2000, max_ordinary: int = 4000, max_chars: int = 50_000_000) -> Model:
    """Fit on labelled documents: at most ``max_toxic`` and ``max_ordinary`` of them (see :func:`labelled_texts`).

    ``usable`` restricts the labels. Labels without a class and documents without text are
    not used; of copies one is, see :func:`fit_rows`.
    """
    rows = labelled_texts(docs, labels, "toxic", {1: max_toxic, 0: max_ordinary}, usable, max_chars)
    return fit_rows([(t, y) for _, t, y in sorted(rows, key=lambda r: (zlib.crc32(b"%d" % r[0]), r))])


def scores(texts: pa.Array, model: Model, distance: WindowDistance) -> np.ndarray:
    rows = np.array([features(t.as_py(), distance) for t in texts], float).reshape(len(texts), -1)
    return model.score(rows) if len(texts) else np.zeros(0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every whole text; null and empty texts get the score of no windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = WindowDistance(model.pair)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), model, distance), pa.float64())], ["doc_id", "score"])

    rows = need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are kept for testing: crc32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels of held-out rows are never learned from. A missing id counts as not held
    out. With no usable label at all every score is one half.
    """
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose score is under ``threshold``, with all their columns.

    Each row is judged by its own text: null and repeated ids do no harm, null and empty
    texts stay unless the model scores no windows at all as toxic. An empty table gives an
    empty one, and without labels of both classes every row has the same score.
    """
    model, judge = fit(docs, labels, ~held_out(F.col("doc_id"))), []

    def verdicts(texts: pa.Array) -> list[bool]:
        if not judge:
            judge.append(WindowDistance(model.pair))  # one for each task
        return list(scores(texts, model, judge[0]) < threshold)

    return with_verdict(docs, verdicts)
