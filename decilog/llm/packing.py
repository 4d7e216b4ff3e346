"""Packing of tokenised documents into sequences by best-two-fit.

A sequence is filled greedily with the longest unpacked piece that fits. When
nothing more fits, its smallest piece gives way to the two unpacked pieces that fill
the expanded gap most tightly. Only lengths matter to that, so the plan is made over
the histogram of lengths (as many entries as a sequence has tokens, however many
documents there are): a pattern of lengths is used as often as the histogram allows.
Pieces then take their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from decilog.llm.byte_bpe import Splitter
from decilog.llm.common import Scratch, need

#: The id that ends every document.
END_ID = 2
#: Pieces that a worker remembers the ids of before it starts afresh (about 250 MB).
CACHE = 1_200_000


def byte_names() -> dict[int, int]:
    """Byte -> the character that stands for it in a byte-level vocabulary.

    Printable characters of Latin-1 stand for themselves, the other bytes take the
    characters from 256 on, in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in own)
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(other)}


class IdBytes(dict):
    """piece -> its ids as little-endian unsigned 32-bit bytes, by the ``tokenizers`` library's model.

    (``array("I")`` has that layout on the little-endian machines that Spark runs on.)
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.names = byte_names()

    def of_text(self, text: str, split: Splitter) -> bytes:
        """The ids of a whole text. Added tokens are no pre-tokens: a text with one goes to the tokenizer whole."""
        if any(t in text for t in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, split(text)))

    def __missing__(self, piece: str) -> bytes:
        named = piece.encode().decode("latin-1").translate(self.names)
        ids = array("I", [t.id for t in self.model.tokenize(named)]).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def tokenise(docs: DataFrame, path: str, pattern: str, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and part (the task's number) of every piece.

    A document is its ids and END_ID (null text: END_ID alone). A longer one than
    ``size`` is cut from its end into pieces of ``size``, so the first may be
    shorter. The vocabulary file's model encodes every distinct pre-token of
    ``pattern``, which is where its tokenizer cuts a text itself; texts that hold one of
    the file's added tokens are encoded by the tokenizer. Null and repeated ids are kept,
    pieces for each row; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, table, end = Splitter(pattern), IdBytes(path), END_ID.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple[int | None, int, int, int, int]] = []
            if len(table) > CACHE:
                table.clear()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = table.of_text(text.as_py() or "", split) + end
                total = len(ids) // 4
                start, until, piece = 0, (total - 1) % size + 1, 0
                while start < total:
                    rows.append((doc, piece, start, until - start, zlib.crc32(ids[4 * start : 4 * until])))
                    start, until, piece = until, until + size, piece + 1
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 5, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long").withColumn("part", F.spark_partition_id())


def highest(mask: int, most: int) -> int:
    """The largest length of ``mask`` (bit l: length l is unpacked) that is at most ``most``; 0 if none."""
    return (mask & ((2 << most) - 1)).bit_length() - 1 if most > 0 and mask & ((2 << most) - 1) else 0


def best_pair(counts: list[int], mask: int, gap: int, over: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in (over, gap]; the most uneven on ties."""
    best, found = over, None
    long = highest(mask, gap - 1)
    while long and 2 * long > best:
        short = highest(mask, min(gap - long, long))
        if short == long and counts[long] < 2:
            short = highest(mask, long - 1)
        if short and long + short > best:
            best, found = long + short, (long, short)
            if best == gap:
                break
        long = highest(mask, long - 1)
    return found


def plan_patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-two-fit over a histogram of lengths: (lengths of a sequence, how many such sequences)."""
    counts = [0] * (size + 1)
    for length, n in histogram.items():
        counts[length] = n
    mask = sum(1 << length for length, n in enumerate(counts) if n and length)
    plan = []
    while mask:
        held, left, gap = [], mask, size

        def take(length: int) -> None:
            nonlocal left, gap
            held.append(length)
            counts[length] -= 1
            gap -= length
            if not counts[length]:
                left &= ~(1 << length)

        while length := highest(left, gap):
            take(length)
        if gap and len(held) > 1:
            small = held[-1]  # the greedy order ends with the smallest
            if pair := best_pair(counts, left, gap + small, small):
                held.pop()
                counts[small] += 1
                left |= 1 << small
                gap += small
                for length in pair:
                    take(length)
        need_of = {length: held.count(length) for length in held}
        more = min(counts[length] // n for length, n in need_of.items())
        for length, n in need_of.items():
            counts[length] -= n * more
            if not counts[length]:
                left &= ~(1 << length)
        plan.append((tuple(held), more + 1))
        mask = left
    return plan


def places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, one past the last, first sequence, offset) of every slot of the plan."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            at = rank.get(length, 0)
            rows.append((length, at, at + times, sequence, offset))
            rank[length] = at + times
            offset += length
        sequence += times
    return rows


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """``pieces`` (doc_id, piece, length, part, ...) with sequence_id and offset.

    Ranks are counted within (part, length) and lifted by the counts of the parts
    before, so no length, however common, goes through one task.
    """
    spark = pieces.sparkSession
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    slots = spark.createDataFrame(
        places(plan_patterns(histogram, size)), "length long, first_rank long, end_rank long, first_sequence long, offset long"
    )
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    lifted = by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("local", local).join(lifted, ["part", "length"]).withColumn("rank", F.col("local") + F.col("before"))
    # The plan has at most a few patterns for each length: its size is bounded by ``size``, not by the data.
    hit = (ranked["length"] == slots["length"]) & (ranked["rank"] >= slots["first_rank"]) & (ranked["rank"] < slots["end_rank"])
    return ranked.join(F.broadcast(slots), hit).select(
        *[ranked[c] for c in pieces.columns if c != "part"],
        (F.col("first_sequence") + ranked["rank"] - F.col("first_rank")).alias("sequence_id"),
        F.col("offset"),
    )


def pack_documents(docs: DataFrame, path: str, pattern: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", left: Scratch | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are documents of one id. Rows that repeat an id are
    documents of their own. An empty table gives no rows.
    """
    pieces = (left or Scratch()).stage(tokenise(docs, path, pattern, size, id_col, text_col), "pack-pieces")
    return pack(pieces, size)
