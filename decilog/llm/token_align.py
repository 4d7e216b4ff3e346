"""Alignment of two tokenizers over a corpus, counted externally.

Both tokenizers cut the same bytes, so the cuts of both are the segments in which one token
of either side overlaps one of the other: a link. For a document, each linked id pair is one
record. Records are radix-partitioned by the first tokenizer's id and written as sorted runs,
compressed by zstandard; a k-way heap merge of the runs counts the documents of each pair.
The merged table is in order of the first side, so a pass over it yields each id's highest
count. The runs are then read once more beside their radix's counts, and what each record
contributes is streamed back to its document.

Runs are rows of a table in the shared folder: Spark deals them to tasks, and a lost task is
run again from there. A pair that every document has is one entry of every run's head, and its
records are as spread as the documents are.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decilog.llm.common import Scratch, need
from decilog.llm.packing import byte_names

#: A plain space between two characters that are not white space. Neither tokenizer joins
#: across it, so what lies between two of them is encoded by itself (with the space before it).
BORDER = re.compile(r"(?<=\S) (?=\S)")
#: Encoded stretches that a worker remembers before it starts afresh (about 110 MB).
CACHE = 300_000
#: Links, and documents, after which a run is written.
RUN_LINKS, RUN_DOCS = 2_000_000, 1 << 16
#: Runs that one merge reads, and runs that are answered beside one copy of their radix's counts.
FAN_IN, SHARED = 64, 32
#: Bits of the radix: 2^4 slices of the first vocabulary.
RADIX_BITS = 4
PLACE_BITS = 20
#: The place of a stretch whose bytes either side changes.
BAD = -1


class Sides:
    """Both vocabularies: bytes of every token, and how an id pair reads as one number in radix-major order."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(a_path).model
        self.names = byte_names()
        vocabulary = Tokenizer.from_file(a_path).get_vocab(with_added_tokens=True)
        byte_of = {chr(c): b for b, c in self.names.items()}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, token in vocabulary.items():
            self.a_bytes[token] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(self.pieces.id_to_piece, range(self.pieces.get_piece_size()))]
        self.apart = not any(re.search(r"[^▁]▁", p) for p in map(self.pieces.id_to_piece, range(self.pieces.get_piece_size())))
        self.b_bits = (len(self.b_bytes) - 1).bit_length()
        self.width = -(-len(self.a_bytes) >> RADIX_BITS) + 1
        self.a_sizes, self.b_sizes = np.fromiter(map(len, self.a_bytes), np.int64), np.fromiter(map(len, self.b_bytes), np.int64)
        #: Each id as text: inside and at the end of a group's tokens of a, and of b.
        self.marked = [np.array([f"{k}{mark}" for k in range(len(side)) for mark in marks], object) for side, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))]
        self.forget()

    def radix_bound(self) -> np.ndarray:
        """The first pair number of every radix, and one past the last."""
        return np.arange((1 << RADIX_BITS) + 1, dtype=np.int64) * self.width << self.b_bits

    def ids_of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both sides of pair numbers."""
        spot = pairs >> self.b_bits
        return (spot % self.width << RADIX_BITS) + spot // self.width, pairs & (1 << self.b_bits) - 1

    def a_ids(self, stretch: str) -> list[int]:
        return [t.id for piece in self.split(" " + stretch) for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.names))]

    def learn(self, stretches: list[str]) -> None:
        """Encode and align ``stretches``, each after a space, and remember them; ``bad`` if the bytes differ."""
        good: tuple[list, list, list] = ([], [], [])
        for stretch, a, b in zip(stretches, map(self.a_ids, stretches), self.pieces.encode(stretches, num_threads=1)):
            if b"".join(map(self.a_bytes.__getitem__, a)) == b" " + stretch.encode() == b"".join(map(self.b_bytes.__getitem__, b)):
                for side, value in zip(good, (stretch, a, b)):
                    side.append(value)
            else:
                self.known[stretch] = BAD
        if good[0]:
            self.known.update(zip(good[0], range(len(self.texts), len(self.texts) + len(good[0]))))
            self.remember(*self.aligned(*good[1:]))

    def remember(self, counts: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, texts: list[str]) -> None:
        self.counts = np.concatenate([self.counts, counts])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.texts += texts

    def forget(self, after: int = 0, names: Iterable[str] | None = None) -> None:
        """Drop what was remembered after the first ``after`` stretches, under ``names`` (all)."""
        if names is None:
            self.known: dict[str, int] = {}
        for name in names or ():
            del self.known[name]
        self.texts: list[str] = self.texts[:after] if after else []
        self.counts = self.counts[:after] if after else np.zeros((0, 3), np.int64)
        self.first = self.first[: after + 1] if after else np.zeros(1, np.int64)
        self.pairs = self.pairs[: self.first[-1]] if after else np.zeros(0, np.int64)

    def aligned(self, a_lists: Sequence[list[int]], b_lists: Sequence[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of stretches laid end to end, where every stretch's end is a cut of both sides: counts (tokens of a, of b, groups), links of each, pair numbers, groups' texts.

        The segments between neighbouring cuts of either side are the links; the ends that
        both sides cut close the groups.
        """
        n_a, n_b = np.fromiter(map(len, a_lists), np.int64), np.fromiter(map(len, b_lists), np.int64)
        a, b = np.fromiter(chain.from_iterable(a_lists), np.int64), np.fromiter(chain.from_iterable(b_lists), np.int64)
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.union1d(a_end, b_end)
        on_a, on_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        own = a[on_a]
        pairs = ((own & (1 << RADIX_BITS) - 1) * self.width + (own >> RADIX_BITS) << self.b_bits) + b[on_b]
        both = (a_end[on_a] == ends) & (b_end[on_b] == ends)
        # in the text a group's tokens of a stand before those of b: a token comes after all of the groups before
        upto_a, upto_b = on_a[both] + 1, on_b[both] + 1
        a_group, b_group = np.searchsorted(ends[both], a_end), np.searchsorted(ends[both], b_end)
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + np.concatenate([[0], upto_b])[a_group]] = self.marked[0][a * 2 + (np.arange(1, len(a) + 1) == upto_a[a_group])]
        text[np.arange(len(b)) + upto_a[b_group]] = self.marked[1][b * 2 + (np.arange(1, len(b) + 1) == upto_b[b_group])]
        text = text.tolist()
        tokens = [0, *np.cumsum(n_a + n_b).tolist()]
        cut = np.searchsorted(ends, a_end[np.cumsum(n_a) - 1], "right")
        groups = np.diff(np.cumsum(both)[cut - 1], prepend=0)
        texts = ["".join(text[i:j])[:-1] for i, j in zip(tokens, tokens[1:])]
        return np.stack([n_a, n_b, groups], 1), np.diff(cut, prepend=0), pairs, texts


HELD: dict[tuple[str, str, str], Sides] = {}


def sides(a_path: str, b_path: str, pattern: str) -> Sides:
    """This worker's vocabularies with what they have encoded so far."""
    from decilog.llm.byte_bpe import Splitter

    key = (a_path, b_path, pattern)
    if key not in HELD:
        HELD[key] = Sides(a_path, b_path)
        HELD[key].split = Splitter(pattern)
    return HELD[key]


def align_batch(both: Sides, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray]]:
    """Tokens of either side, groups, groups' text and pair numbers of each text; zeros and empty where it has no tokens."""
    cut = [(BORDER.split(t) if both.apart else [t]) if t else [] for t in texts]
    if len(both.known) > CACHE:
        both.forget()
    new = set().union(*cut) - both.known.keys()
    both.learn([s for s in new if len(s) <= 64])
    held, long = len(both.texts), [s for s in new if len(s) > 64]  # long stretches do not come again
    both.learn(long)
    found = []
    for own in cut:
        at = list(map(both.known.__getitem__, own))
        if not at or BAD in at:
            found.append((0, 0, 0, "", both.pairs[:0]))
            continue
        place = np.array(at)
        start = both.first[place]
        sizes = both.first[place + 1] - start
        upto = np.cumsum(sizes)
        pairs = both.pairs[np.arange(upto[-1]) + np.repeat(start - upto + sizes, sizes)]
        found.append((*both.counts[place].sum(0).tolist(), ";".join(map(both.texts.__getitem__, at)), pairs))
    if long:
        both.forget(held, long)
    return found


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one zstandard frame; the first is stored by its steps."""
    first = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    return zstandard.compress(b"".join([first.tobytes(), *[x.tobytes() for x in arrays[1:]]]), 1)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    n, at, out = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


#: What a run holds: pair numbers with their documents (head); for each record the document's place and its links (body).
HEAD, BODY = ("i8", "i8"), ("i4", "i4")
RUNS = "chunk long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, head binary, body binary"


def write_runs(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str, text_col: str, left: Scratch) -> DataFrame:
    """A row for each document (radix null), and for each chunk of documents a row for each radix with its sorted run."""
    names = [x.split()[0] for x in RUNS.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int32(), pa.binary(), pa.binary()]

    def batch_of(**columns: list) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), k) for c, k in zip(names, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, task, chunks = sides(a_path, b_path, pattern), TaskContext.get(), 0
        bounds = both.radix_bound()
        rows: list[tuple] = []
        links: list[np.ndarray] = []
        n_links = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal chunks, n_links
            chunk, chunks = task.partitionId() << 24 | chunks, chunks + 1
            doc, a, b, groups, n, sha = zip(*rows)
            yield batch_of(chunk=[chunk] * len(rows), place=range(len(rows)), doc_id=doc, n_a=a, n_b=b, n_groups=groups, n_links=n, groups_sha256=sha)
            records = np.sort(np.concatenate(links))
            first = np.flatnonzero(np.diff(records, prepend=-1))
            times, records = np.diff(first, append=len(records)), records[first]
            pairs, place = records >> PLACE_BITS, records & (1 << PLACE_BITS) - 1
            start = np.flatnonzero(np.diff(pairs, prepend=-1))
            heads, docs_of = pairs[start], np.diff(start, append=len(pairs))
            cut, cut_records = np.searchsorted(heads, bounds), np.searchsorted(pairs, bounds)
            radix = [r for r in range(len(bounds) - 1) if cut[r] < cut[r + 1]]
            head = [pack(heads[cut[r] : cut[r + 1]], docs_of[cut[r] : cut[r + 1]]) for r in radix]
            body = [pack(place[cut_records[r] : cut_records[r + 1]].astype(BODY[0]), times[cut_records[r] : cut_records[r + 1]].astype(BODY[1])) for r in radix]
            if radix:
                yield batch_of(chunk=[chunk] * len(radix), place=[len(rows)] * len(radix), radix=radix, head=head, body=body)
            rows.clear()
            links.clear()
            n_links = 0

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for doc, (a, b, groups, text, pairs) in zip(part.column(0).to_pylist(), align_batch(both, part.column(1).to_pylist())):
                    links.append(pairs << PLACE_BITS | len(rows))
                    rows.append((doc, a, b, groups, len(pairs), hashlib.sha256(text.encode()).hexdigest() if a else ""))
                    n_links += len(pairs)
                    if n_links >= RUN_LINKS or len(rows) >= RUN_DOCS:
                        yield from out()
        if rows:
            yield from out()

    rows = need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return left.stage(rows.mapInArrow(run, RUNS), "align-runs")


def merge_heads(table: pa.Table) -> pa.Table:
    """K-way heap merge of the heads of one radix: the documents of each pair over all of them, in order of the pairs."""

    def stream(blob: bytes) -> Iterator[tuple[int, int]]:
        pairs, n = unpack(blob, *HEAD)
        return zip(pairs.tolist(), n.tolist())

    merged = heapq.merge(*[stream(x.as_py()) for x in table["head"]])
    counted = [(pair, sum(n for _, n in same)) for pair, same in groupby(merged, itemgetter(0))]
    pairs, n = np.array(counted, np.int64).T
    return pa.table({"radix": table["radix"].slice(0, 1), "part": table["to"].slice(0, 1), "head": [pack(pairs, n)]})


def count_pairs(runs: DataFrame) -> DataFrame:
    """One row for each radix: radix, head with the corpus's counts. Rounds of merges, each of about ``FAN_IN`` runs."""
    parts = max(1, -(-(runs.where("radix IS NOT NULL").agg(F.count_distinct("chunk")).first()[0]) // FAN_IN))
    heads = runs.where("radix IS NOT NULL").select("radix", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("long").alias("to"), "head")
    while True:
        heads = heads.groupBy("radix", "to").applyInArrow(merge_heads, "radix int, part long, head binary")
        if parts == 1:
            return heads.drop("part")
        parts = -(-parts // FAN_IN)
        heads = heads.select("radix", F.floor(F.col("part") / FAN_IN).cast("long").alias("to"), "head")


def with_maxima(blob: bytes, b_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, counts, and whether the count is its first id's highest: one pass in the order of that side."""
    pairs, n = unpack(blob, *HEAD)
    first = np.flatnonzero(np.diff(pairs >> b_bits, prepend=-1))
    return pairs, n, n == np.repeat(np.maximum.reduceat(n, first), np.diff(first, append=len(pairs)))


def contributions(b_bits: int):
    """For a radix's counts and some of its runs: what each run adds to the documents of its chunk."""

    def answer(counts: pa.Table, runs: pa.Table) -> pa.Table:
        chunk, made = [], []
        if len(runs):
            pairs, n, best = with_maxima(counts["head"][0].as_py(), b_bits)
            for c, docs, head, body in zip(runs["chunk"].to_pylist(), runs["place"].to_pylist(), runs["head"], runs["body"]):
                own, docs_of = unpack(head.as_py(), *HEAD)
                place, times = unpack(body.as_py(), *BODY)
                at = np.repeat(np.searchsorted(pairs, own), docs_of)
                sums = np.zeros((2, docs), np.int64)
                np.add.at(sums[0], place, np.where(best[at], times, 0))
                np.add.at(sums[1], place, times * n[at])
                chunk.append(c)
                made.append(zstandard.compress(sums.tobytes(), 1))
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "sums": pa.array(made, pa.binary())})

    return answer


def gather(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """A chunk's documents with the sums of what all radixes contribute."""
    total = np.zeros((2, len(docs)), np.int64)
    for x in sums["sums"]:
        total += np.frombuffer(zstandard.decompress(x.as_py()), np.int64).reshape(2, -1)
    place = docs["place"].to_numpy()
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", pa.array(total[0][place])).append_column("count_sum", pa.array(total[1][place])).append_column("groups_sha256", docs["groups_sha256"])


def align_documents(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", left: Scratch | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    ``a_path``: a byte-level vocabulary of the ``tokenizers`` library, whose pre-tokens
    ``pattern`` cuts, for the text after a space; ``b_path``: a SentencePiece model, which adds
    that space itself. Strings of special tokens are ordinary text. A link's count is the
    number of rows that have its pair; n_best are the links whose count is the highest of
    their first id (ties too), count_sum adds the counts of all links. A row whose text is
    null or empty, or whose bytes either side changes, has zeros and ''. Null and repeated ids
    keep their rows, each counted as a document; an empty table gives no rows; other columns
    are not read.
    """
    left = left or Scratch()
    runs = write_runs(docs, a_path, b_path, pattern, id_col, text_col, left)
    bits = sides(a_path, b_path, pattern).b_bits
    counts = left.stage(count_pairs(runs), "align-counts")
    held = runs.where("radix IS NOT NULL").select("radix", "chunk", "place", "head", "body")
    salts = max(1, -(-held.agg(F.count_distinct("chunk")).first()[0] // SHARED))
    held = held.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("long"))
    copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    keys = ["radix", "salt"]
    sums = copies.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(contributions(bits), "chunk long, sums binary")
    rows = runs.where("radix IS NULL").select("chunk", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(gather, schema)


def vocabulary_map(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", left: Scratch | None = None) -> DataFrame:
    """a, b, docs, best: every id pair that some text links, the rows that link it, and whether no other b has more for that a."""
    counts = count_pairs(write_runs(docs, a_path, b_path, pattern, id_col, text_col, left or Scratch()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(a_path, b_path, pattern)
        for batch in batches:
            for blob in batch.column(batch.schema.get_field_index("head")):
                pairs, n, best = with_maxima(blob.as_py(), both.b_bits)
                a, b = both.ids_of(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a.astype("i4")), pa.array(b.astype("i4")), pa.array(n), pa.array(best)], ["a", "b", "docs", "best"])

    return counts.mapInArrow(run, "a int, b int, docs long, best boolean")


def group_lists(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and groups: the ids of both sides between neighbouring common cuts, as structs (a, b) of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, kind = sides(a_path, b_path, pattern), pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        numbers = lambda side: [int(x) for x in side.split(",")]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = align_batch(both, part.column(1).to_pylist())
                lists = [[dict(zip("ab", map(numbers, g.split("|")))) for g in x[3].split(";")] if x[3] else [] for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, kind)], ["doc_id", "groups"])

    rows = need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")
