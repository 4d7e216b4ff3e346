"""Document quality by labelling lines with a linear-chain conditional random field.

Each line of a text is content or boilerplate. Line features (symbol, capital and
separator shares, repeats, length) weigh in for each label, and neighbouring labels
for each other; Viterbi decoding finds the best labels of all lines together. The
share of words in content lines decides whether the document stays. Documents are
labelled, lines are not: their labels are inferred in turns with the fit, so that a good
paragraph in a bad text is content and a block of separators in a good one is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decilog.llm.common import labelled_texts, need, with_verdict

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
N_FEATURES = 11


def repeated_words(words: list[bytes], width: int = 5) -> np.ndarray:
    """For each word, whether a window of ``width`` words over it is found twice or more."""
    covered = np.zeros(len(words), bool)
    if len(words) <= width:
        return covered
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.uint64, len(words))
    if len(names) == len(words):
        return covered
    mixed = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):  # a 64-bit mix of the window's word numbers
        mixed = (mixed ^ ids[k : len(ids) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    _, where, counts = np.unique(mixed, return_inverse=True, return_counts=True)
    again = counts[where] > 1
    for k in range(width):
        covered[k : k + len(again)] |= again
    return covered


def describe(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), line features, words per line.

    Lines without a word are no lines of the sequence.
    """
    text = text or ""
    lines, words, per_line, kept = text.split("\n"), [], [], []
    seen: set[str] = set()
    dup = []
    for line in lines:
        own = line.encode("utf-8", "surrogatepass").split()
        if own:
            words += own
            per_line.append(len(own))
            kept.append(line)
            dup.append(line in seen)
            seen.add(line)
    covered = repeated_words(words)
    base = (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), sum(dup), int(covered.sum()))
    counts = np.array(per_line, int)
    rows = np.zeros((len(kept), N_FEATURES))
    if len(kept):
        ends = np.cumsum(counts)
        total = np.r_[0, np.cumsum(covered)]
        for k, line in enumerate(kept):
            n = per_line[k]
            marks = sum(map(line.count, SYMBOLS))
            pipes = line.count("|")
            upper = line != line.lower() and line == line.upper()
            rows[k] = (
                1, n >= 10, n <= 2, marks - pipes > 0.3 * n, pipes > 0.1 * n, upper, line.count("!") > 0.3 * n, dup[k],
                0, line.rstrip()[-1:] in ".!?:;", sum(map(line.count, "0123456789")) > 0.2 * len(line),
            )
        rows[:, 8] = (total[ends] - total[ends - counts]) > 0.5 * counts
    return base, rows, counts


class LineCrf:
    """Two labels (0 boilerplate, 1 content): weights[label, feature] and trans[from, to]."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray) -> None:
        self.weights, self.trans = weights, trans

    def viterbi(self, rows: np.ndarray) -> np.ndarray:
        """The best label of each line."""
        unary = rows @ self.weights.T
        n = len(unary)
        if n == 0:
            return np.zeros(0, int)
        (a0, a1), t = unary[0], self.trans
        back = np.zeros((n, 2), np.int8)
        for k in range(1, n):
            from0, from1 = (a0 + t[0, 0], a1 + t[1, 0]), (a0 + t[0, 1], a1 + t[1, 1])
            back[k] = from0[1] > from0[0], from1[1] > from1[0]
            a0, a1 = max(from0) + unary[k, 0], max(from1) + unary[k, 1]
        out = np.zeros(n, int)
        out[-1] = a1 >= a0
        for k in range(n - 1, 0, -1):
            out[k - 1] = back[k, out[k]]
        return out


#: Lines of the longest training sequence; longer texts are several sequences, all of them used.
PIECE = 60


def batch_of(parts: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, live lines, gold labels and weights of sequences, padded to the longest."""
    n, longest = len(parts), max(len(x) for x, _, _ in parts)
    x, live, gold = np.zeros((n, longest, N_FEATURES)), np.zeros((n, longest)), np.zeros((n, longest, 2))
    for k, (one, y, _) in enumerate(parts):
        x[k, : len(one)], live[k, : len(one)] = one, 1
        gold[k, np.arange(len(one)), y] = 1
    return x, live, gold, np.array([w for _, _, w in parts])


def slopes_of(weights: np.ndarray, trans: np.ndarray, x: np.ndarray, live: np.ndarray, gold: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gold less expected counts of features and transitions, by forward and backward passes."""
    n, longest = live.shape
    unary = (x @ weights.T) * live[:, :, None]
    alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    alpha[:, 0] = unary[:, 0]
    for k in range(1, longest):
        came = np.logaddexp(alpha[:, k - 1, :1] + trans[0], alpha[:, k - 1, 1:] + trans[1]) + unary[:, k]
        alpha[:, k] = np.where(live[:, k, None] > 0, came, alpha[:, k - 1])
    for k in range(longest - 2, -1, -1):
        nxt = beta[:, k + 1] + unary[:, k + 1]
        beta[:, k] = np.where(live[:, k + 1, None] > 0, np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:]), 0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
    d_trans = np.einsum("n,nka,nkb->ab", scale, gold[:, :-1], gold[:, 1:])
    for a in (0, 1):
        for b in (0, 1):
            joint = np.exp(alpha[:, :-1, a] + trans[a, b] + unary[:, 1:, b] + beta[:, 1:, b] - z[:, None]) * live[:, 1:]
            d_trans[a, b] -= (scale[:, None] * joint).sum()
    return np.einsum("n,nkl,nkf->lf", scale, gold - p, x), d_trans


def fit_rows(rows: list[tuple[np.ndarray, int | np.ndarray]], steps: int = 150, rate: float = 0.1, penalty: float = 1e-3, chain: bool = True, start: LineCrf | None = None) -> LineCrf:
    """Maximum likelihood of line sequences and their labels (one label for all lines, or one each).

    Forward and backward passes run over sequences of like length at once, line by line.
    Without ``chain`` neighbours do not weigh in: lines are told apart by their features
    alone. ``start``: a model to go on from.
    """
    rows = [(x, np.broadcast_to(y, len(x))) for x, y in rows if len(x)]
    weights, trans = np.zeros((2, N_FEATURES)), np.zeros((2, 2))
    if not rows or len(np.unique(np.concatenate([y for _, y in rows]))) < 2:  # nothing to learn from: symbols, separators and repeats are boilerplate
        weights[1, 0], trans[0, 0], trans[1, 1] = 0.5, 0.5, 0.5
        weights[0, [3, 4, 5, 6, 7, 8]] = 3.0
        return LineCrf(weights, trans)
    parts = [(x[k : k + PIECE], y[k : k + PIECE], 2 / len(rows)) for x, y in rows for k in range(0, len(x), PIECE)]
    if not chain:  # lines count alike, whatever their text's length
        n_lines = sum(len(x) for x, _, _ in parts)
        parts = [(x, y, 2 / n_lines) for x, y, _ in parts]
    groups = [batch_of(own) for low, high in ((0, 6), (6, 15), (15, 30), (30, PIECE)) if (own := [p for p in parts if low < len(p[0]) <= high])]
    if start is not None:
        weights, trans = start.weights.copy(), start.trans.copy()
    first, second = [np.zeros_like(weights), np.zeros_like(trans)], [np.zeros_like(weights), np.zeros_like(trans)]
    for step in range(1, steps + 1):
        d_weights, d_trans = -penalty * weights, -penalty * trans
        for group in groups:
            slopes = slopes_of(weights, trans, *group)
            d_weights += slopes[0]
            d_trans += slopes[1] if chain else 0
        for which, (value, slope) in enumerate(((weights, d_weights), (trans, d_trans))):
            first[which] = 0.9 * first[which] + 0.1 * slope
            second[which] = 0.99 * second[which] + 0.01 * slope**2
            value += rate * (first[which] / (1 - 0.9**step)) / (np.sqrt(second[which] / (1 - 0.99**step)) + 1e-8)
    return LineCrf(weights, trans)


def line_labels(model: LineCrf, rows: np.ndarray, counts: np.ndarray, quality: int, least_share: float = 0.5) -> np.ndarray:
    """The model's labels of a text's lines, changed as little as its document label asks for.

    A good text has content lines with ``least_share`` of its words at least, a bad one
    with less: the lines whose odds are least against it change.
    """
    out = model.viterbi(rows)
    odds = rows @ (model.weights[1] - model.weights[0])
    total = counts.sum()
    for k in np.argsort(-odds if quality else odds, kind="stable"):
        held = counts[out == 1].sum()
        if (held >= least_share * total) == bool(quality):
            break
        out[k] = quality
    return out


def fit_lines(texts: list[tuple[np.ndarray, np.ndarray, int]], turns: int = 2) -> LineCrf:
    """Fit on (line features, words per line, document label): labels of lines come from the data.

    A model without transitions is fitted first, with each line labelled as its text:
    it tells which lines look like those of good texts wherever they stand. Then, for
    ``turns`` times, every text's lines are labelled by the model under the constraint of
    the document label, and the chain is fitted on them.
    """
    texts = [t for t in texts if len(t[0])]
    model = fit_rows([(x, y) for x, _, y in texts], steps=100, chain=False)
    for _ in range(turns if len({y for _, _, y in texts}) == 2 else 0):
        model = fit_rows([(x, line_labels(model, x, counts, y)) for x, counts, y in texts], steps=100, start=model)
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_bad: int = 500, max_good: int = 1500, max_chars: int = 50_000_000) -> LineCrf:
    """Fit on at most ``max_bad`` and ``max_good`` labelled documents, with all their lines (see :func:`labelled_texts`)."""
    found = labelled_texts(docs, labels, "quality", {0: max_bad, 1: max_good}, usable, max_chars)
    return fit_lines([(*describe(text)[1:], y) for _, text, y in found])


def verdict(text: str | None, model: LineCrf, least_share: float = 0.5) -> tuple[int, int, int, int, int, bool, int, int, int, bool]:
    """The counts of :func:`describe`, base_failed, content_words, n_lines, n_content_lines, kept."""
    base, lines, counts = describe(text)
    content = model.viterbi(lines) == 1
    failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
    held = int(counts[content].sum()) if len(counts) else 0
    return (*base, failed, held, len(counts), int(content.sum()), not failed and held >= least_share * base[0])


def judge(docs: DataFrame, model: LineCrf, least_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts and the verdict.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    content_words, n_lines, n_content_lines, kept. Null and empty texts have no
    words and fail. Rows that repeat an id are judged each.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_words", "n_lines", "n_content_lines", "kept"]
    kinds = [pa.int64()] * 6 + [pa.bool_()] + [pa.int64()] * 3 + [pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows.append((doc, *verdict(text.as_py(), model, least_share)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    rows = need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} {'boolean' if k == pa.bool_() else 'long'}" for n, k in zip(names, kinds)))


def judge_documents(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> DataFrame:
    """Fit on the labels, then judge every document (see :func:`judge`)."""
    return judge(docs, fit(docs, labels, usable))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Each row is judged by its own text: null and repeated ids do no harm, rows without ten
    words go. An empty table gives an empty one; without labels of both classes symbols,
    separators and repeats are boilerplate.
    """
    model = fit(docs, labels)
    return with_verdict(docs, lambda texts: [verdict(t.as_py(), model)[-1] for t in texts])
