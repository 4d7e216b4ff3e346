"""How far the vocabularies of a language's sources diverge, by row-by-row products over a term-major index.

Terms are counted per (lang, source). The audit needs, for every ordered pair of sources,
a sum over all kept terms of a function that is not zero where a term is absent. That sum is
a sparse product: each source's row scatters its terms through the term-major index into
one dense accumulator over its peers, so no pairs of postings leave the task. What a term
adds where either side lacks it depends on the other side's count alone: it comes from
histograms of the probabilities, and the scatter adds the difference.

All arithmetic is on integers. Sums stay below 2^63: the probabilities of a source add up to
about 10^9, and no term's value exceeds the square of its probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decilog.llm.common import Scratch, if_small, need

#: Fixed values of the contract: the scale of probabilities, and the documents that a kept term is in.
ONE, LEAST_DOCS = 1_000_000_000, 3
#: Terms are runs of these bytes of UTF-8, in lower case; every other byte parts them.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Counts that a worker holds before it hands them on, and rows of the index in one block.
HELD, BLOCK_ROWS = 400_000, 300_000
#: Postings that one scatter gathers at a time.
GATHER = 1 << 21
#: Sources up to which their table is broadcast.
SMALL = 100_000


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with it), counted ahead in the workers: keys repeat.

    A group's rows have the term '' with n = 0, so that groups without terms are there. Null columns are ''.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in n.items():
                held, terms = docs[lang, source], list(counts)
                for k in range(0, len(terms), 50_000):
                    part = terms[k : k + 50_000]
                    made = [pa.array(part, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in part], pa.int64()), pa.array([held[t] for t in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), *made], ["lang", "source", "term", "n", "docs"])
            n.clear()
            docs.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                words = (text.as_py() or b"").translate(TERM_BYTES).split()
                key = (lang or "", source or "")
                if key not in n:
                    n[key], docs[key] = Counter(), Counter()
                n[key].update(words)
                n[key][b""] = 0
                docs[key].update({b"", *words})
            if sum(map(len, n.values())) > HELD:
                yield from out()
        yield from out()

    rows = need(docs, lang_col, source_col, text_col).toDF("lang", "source", "text").select(*[F.col(c).cast("string") for c in ("lang", "source", "text")])
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def probability(n: str, total: str) -> Column:
    """1 + floor(10^9 (n + 1) / total), exact at any count."""
    return F.expr(f"1 + (cast(({n}) + 1 as decimal(20, 0)) * cast({ONE} as decimal(10, 0))) div cast(greatest({total}, 1) as decimal(20, 0))")


def gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / q) of two columns."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def scatter(table: pa.Table) -> pa.Table:
    """One block of a language's index: for each source and peer that share terms, what these terms change.

    Row by row: a source's terms are looked up in the term-major index, and the peers found
    there are added to one dense accumulator.
    """
    source = table["source"].combine_chunks().dictionary_encode()
    names, src = source.dictionary, source.indices.to_numpy()
    term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((src, term))  # term-major
    src, term, p, p0_row = src[order], term[order], table["p"].to_numpy()[order], table["p0"].to_numpy()[order]
    first = np.concatenate([np.searchsorted(term, np.arange(term.max() + 1)), [len(term)]])
    p0 = np.zeros(len(names), np.int64)
    p0[src] = p0_row
    of = lambda a, b: (a - b) * (a - b) // b
    by_source = np.argsort(src, kind="stable")
    ends = np.searchsorted(src[by_source], np.arange(len(names) + 1))
    made: list[tuple[int, np.ndarray, np.ndarray]] = []
    for g in range(len(names)):
        own = by_source[ends[g] : ends[g + 1]]
        sums, met = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        size = first[term[own] + 1] - first[term[own]]
        for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(size) // GATHER)) + 1):
            row, count = own[part], size[part]
            at = np.repeat(first[term[row]] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            peer, theirs, mine = src[at], p[at], np.repeat(p[row], count)
            base = p0[peer]
            np.add.at(sums, peer, of(mine, theirs) - of(mine, base) - of(p0[g], theirs) + of(p0[g], base))
            met[peer] = True
        met[g] = False
        peers = np.flatnonzero(met)
        made.append((g, peers, sums[peers]))
    left = np.concatenate([np.full(len(peers), g) for g, peers, _ in made])
    right, value = np.concatenate([x for _, x, _ in made]), np.concatenate([x for _, _, x in made])
    lang = pa.array([table["lang"][0].as_py()] * len(left), pa.string())
    return pa.table({"lang": lang, "source": names.take(pa.array(left, pa.int64())), "item": names.take(pa.array(right, pa.int64())), "value": pa.array(value, pa.int64())})


def ranked(df: DataFrame, part: str, most: int | None = None) -> DataFrame:
    """``df`` with its part's name and each row's rank in its group: larger values first, then items in order of their bytes."""
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    df = df.withColumn("rank", rank)
    return (df.where(F.col("rank") <= most) if most else df).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, top_terms: int = 200, least_docs: int = LEAST_DOCS, left: Scratch | None = None, **columns: str) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from its peers, and by which terms from its language.

    ``pair``: every other source of the language, with the sum over all kept terms of
    floor((p - q)^2 / q). ``term``: the source's terms that are more probable than in the
    whole language, the first ``top_terms`` by the same value. A term is kept if
    ``least_docs`` rows of its language have it. Every row counts, repeated ids too (ids
    are not read); null text, lang and source are ''; a source without terms has its pairs,
    a language with one source has none; an empty table gives no rows.
    """
    left = left or Scratch()
    one_shuffle = term_counts(docs, **columns).repartition("lang", "term")
    counts = one_shuffle.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"in_docs": F.sum("docs").over(of_term), "total": F.sum("n").over(of_term), "first": F.min("source").over(of_term) == F.col("source")})
    index = left.stage(counts.where((F.col("in_docs") >= least_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "total", "first"), "audit-index")

    is_term = F.col("term") != ""
    groups = index.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count_if(is_term).alias("terms"), F.count_if(is_term & F.col("first")).alias("new"))
    of_lang = groups.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.sum("new").alias("v"))
    groups = left.stage(groups.join(of_lang, "lang"), "audit-groups")
    groups = groups.withColumn("p0", probability("0", "size + v"))
    terms = index.where(is_term).join(if_small(groups, SMALL), ["lang", "source"])
    terms = terms.withColumns({"p": probability("n", "size + v"), "q": probability("total", "lang_size + v")})

    blocks = max(1, index.count() // BLOCK_ROWS)
    placed = terms.select("lang", "source", "term", "p", "p0", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))
    shared = placed.groupBy("lang", "block").applyInArrow(scatter, "lang string, source string, item string, value long")

    x, y = groups.select("lang", "source", "terms", "v", "p0"), groups.select("lang", F.col("source").alias("item"), F.col("terms").alias("y_terms"), F.col("p0").alias("y0"))
    neither = x.join(if_small(y, SMALL), "lang").where("source <> item").select("lang", "source", "item", (F.expr("v - terms - y_terms") * gap("p0", "y0")).alias("value"))
    hist = terms.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n")).join(if_small(y, SMALL), "lang").where("source <> item")
    sides = F.array(F.struct("source", "item", (F.col("n") * gap("p", "y0")).alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("n") * gap("y0", "p")).alias("value")))
    alone = hist.select("lang", F.explode(sides).alias("s")).select("lang", "s.*").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = shared.unionByName(alone).unionByName(neither).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    marks = terms.where("p > q").select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value"))
    return ranked(pairs, "pair").unionByName(ranked(marks, "term", top_terms))
