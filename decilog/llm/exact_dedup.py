"""Exact duplicates by an extendible-hash index kept on shared files.

The directory maps the leading bits of a key's 64-bit hash to buckets. It starts
with one bucket and doubles whenever a bucket that must be split already uses all
of its bits; a bucket that holds more distinct keys than ``capacity`` is split by
one more bit. The index is a table in the shared folder with one entry for each hash,
in order of buckets; an owner task writes a range of them. A row goes through the
directory to its bucket and looks its hash up there. Texts with the same hash form a
chain: bytes are compared with the entry's, and those that differ become entries of
their own. The hash alone never decides that texts are equal.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decilog.llm.common import ROW, Scratch, if_small, keyed_rows, need

#: Leading bits over which keys are counted first, by how many more until no prefix overflows, and at most.
FIRST_BITS, MORE_BITS, MOST_BITS = 10, 4, 62

#: Entries with several rows (of some 60 bytes) up to which they are broadcast.
SMALL = 200_000


def normalise(text: Column) -> Column:
    """The text without white space of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def prefix_of(key: Column, bits: int) -> Column:
    """The leading ``bits`` bits of a signed 64-bit hash, as a number from 0."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


@dataclass(frozen=True)
class Directory:
    """A grown directory: ``depth`` bits, and for each slot its bucket's first slot and local depth."""

    depth: int
    slots: tuple[tuple[int, int], ...]


def grow_directory(counts: dict[int, int], capacity: int, count_bits: int) -> Directory:
    """Directory doubling over key counts by hash prefix of ``count_bits`` bits."""
    prefixes = sorted(counts)
    before = [0, *accumulate(counts[p] for p in prefixes)]

    def held(prefix: int, local: int) -> int:
        span = count_bits - local
        return before[bisect_left(prefixes, (prefix + 1) << span)] - before[bisect_left(prefixes, prefix << span)]

    buckets, depth = {(0, 0)}, 0  # (prefix, local depth)
    full = [b for b in buckets if held(*b) > capacity]
    while full:
        prefix, local = full.pop()
        if local == count_bits:  # keys of one whole prefix: they are a chain of one bucket
            continue
        depth = max(depth, local + 1)
        buckets.remove((prefix, local))
        for child in ((2 * prefix, local + 1), (2 * prefix + 1, local + 1)):
            buckets.add(child)
            if held(*child) > capacity:
                full.append(child)
    slots: list[tuple[int, int]] = [(0, 0)] * (1 << depth)
    for prefix, local in buckets:
        first = prefix << (depth - local)
        for slot in range(first, first + (1 << (depth - local))):
            slots[slot] = (first, local)
    return Directory(depth, tuple(slots))


def keyed(docs: DataFrame, id_col: str, text_col: str, digest_bits: int = 256, row_col: str | None = None) -> DataFrame:
    """doc_id, row, n_chars, norm and its 64-bit hash h64.

    ``digest_bits`` under 256 leaves so many bits of the hash; tests use it to force collisions.
    """
    norm = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(row_col).alias("row") if row_col else F.lit(None).cast("long").alias("row"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
        normalise(F.col(text_col)).alias("norm"),
    )
    h64 = F.xxhash64("norm") if digest_bits == 256 else F.shiftleft(F.pmod(F.xxhash64("norm"), F.lit(1 << digest_bits)), 60)
    return norm.withColumn("h64", h64)


#: Where a row's entry lies: its bucket, and its hash in it.
KEY = ["bucket", "h64"]


def best_row() -> Column:
    """With an id before without; then most code points, then smallest id, then smallest row key."""
    return F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "n_chars", (-F.col("doc_id")).alias("neg_id"), (-F.col("row")).alias("neg_row")))


def is_row(best: Column) -> Column:
    """Whether a row is ``best``; rows without id and row key are told apart by their length alone."""
    same = F.col("doc_id").eqNullSafe(-best["neg_id"]) & F.col("row").eqNullSafe(-best["neg_row"])
    return same & (F.col("doc_id").isNotNull() | (F.col("n_chars") == best["n_chars"]))


def build_index(rows: DataFrame, capacity: int, scratch: Scratch) -> tuple[DataFrame, Directory]:
    """The index entries, one per hash, as bucket-ordered shared files, with the directory.

    Copies are folded before the shuffle, so a group with a third of all rows is
    one entry from each task. Entry: bucket, local_depth, h64, best, copies.
    """
    entries = scratch.stage(rows.groupBy("h64").agg(best_row().alias("best"), F.count(F.lit(1)).alias("copies")), "dedup-entries")
    bits, counts = FIRST_BITS, {}
    while True:  # about capacity / 2**MORE_BITS keys a prefix at least, so the counts grow with the buckets, not with the keys
        counted = entries.groupBy(F.shiftrightunsigned("h64", 64 - bits).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        over = counted.where(F.col("n") > capacity)
        if bits >= MOST_BITS or not over.take(1):
            counts = {r["p"]: r["n"] for r in counted.collect()}
            break
        bits = min(bits + MORE_BITS, MOST_BITS)
    directory = grow_directory(counts, capacity, bits)
    owned = with_bucket(entries, directory).repartitionByRange("bucket", "h64").sortWithinPartitions(*KEY)
    return scratch.stage(owned, "dedup-index"), directory


def with_bucket(entries: DataFrame, directory: Directory) -> DataFrame:
    """Look the bucket of ``h64`` up in the directory, whose slots are about as many as there are buckets."""
    rows = [(slot, first, local) for slot, (first, local) in enumerate(directory.slots)]
    table = entries.sparkSession.createDataFrame(rows, "slot int, bucket int, local_depth int")
    return entries.withColumn("slot", prefix_of(F.col("h64"), directory.depth)).join(F.broadcast(table), "slot").drop("slot")


def chained(texts: DataFrame, index: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows whose bytes differ from those that their entry keeps, regrouped by bytes.

    Only the texts of entries with several rows are compared; where there are at most
    SMALL such entries they go to the texts, and no others move. The kept text meets its
    chain in an inner join whose large partitions Spark can split.
    """
    shared = scratch.stage(index.where("copies > 1").select(*KEY, "best"), "dedup-shared")
    chain = scratch.stage(texts.join(if_small(shared, SMALL), KEY), "dedup-chains")
    kept = chain.where(is_row(F.col("best"))).groupBy(*KEY).agg(F.max("norm").alias("kept_norm"))
    strays = scratch.stage(chain.join(kept, KEY).where("norm <> kept_norm").select("doc_id", "row", "n_chars", "norm", *KEY), "dedup-strays")
    groups = strays.groupBy(*KEY, "norm").agg(best_row().alias("best"), F.count(F.lit(1)).alias("copies"))
    found = strays.join(groups, [*KEY, "norm"]).select("doc_id", "row", "n_chars", F.sha2("norm", 256).alias("text_sha256"), *KEY, F.col("best").alias("stray"), F.col("copies").alias("stray_copies"))
    return scratch.stage(found, "dedup-chained")


def dedup_groups(docs: DataFrame, capacity: int = 200_000, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, row_col: str | None = None, left: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Of the documents with equal bytes after deleting white space, the one with the
    most code points, then the smallest id, stays; a row without an id stays only if no
    copy has one. Null text counts as empty; empty texts are one group. Without
    ``row_col`` (a column, also returned as ``row``, that names each row) a row that
    repeats an id is a row of its own in the counts and kept with it, and so are the
    longest of copies of which none has an id. An empty table gives no rows. Other
    columns are not read. ``left`` gets the tables that the result is read from, to delete
    when it is written.
    """
    scratch, left = Scratch(), left or Scratch()
    texts = keyed(need(docs, id_col, text_col, *[row_col] if row_col else []), id_col, text_col, digest_bits, row_col)
    rows = left.stage(texts.select("doc_id", "row", "n_chars", "h64", F.sha2("norm", 256).alias("text_sha256")), "dedup-rows")
    index, directory = build_index(rows, capacity, scratch)
    strays = chained(with_bucket(texts, directory), index, scratch)
    gone = strays.groupBy(*KEY).agg(F.count(F.lit(1)).alias("gone"))
    entries = left.stage(index.join(gone, KEY, "left").select(*KEY, "best", (F.col("copies") - F.coalesce("gone", F.lit(0))).alias("copies")), "dedup-chained")
    own = ["doc_id", "row", "n_chars", "text_sha256", *KEY]
    one = left.stage(strays.dropDuplicates(own).select(*[F.col(c).alias(f"s_{c}") for c in own], "stray", "stray_copies"), "dedup-one")
    scratch.clear()
    found = with_bucket(rows, directory).drop("local_depth").join(entries, KEY)
    same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in own]
    keep = F.coalesce("stray", "best")
    return found.join(one, same, "left").select(
        "doc_id", (-keep["neg_id"]).alias("keep_id"), F.coalesce("stray_copies", "copies").alias("group_size"),
        is_row(keep).alias("kept"), "text_sha256", "bucket", *["row"] if row_col else [],
    )


def keep_unique(docs: DataFrame, capacity: int = 200_000, left: Scratch | None = None) -> DataFrame:
    """One row of each group of copies, with all its columns.

    Rows are judged by keys of their own, so null and repeated ids do no harm; of rows
    without text one stays. An empty table gives an empty one. ``left`` as in
    :func:`dedup_groups`.
    """
    left = left or Scratch()
    rows = keyed_rows(docs, "dedup-docs", left)
    kept = dedup_groups(rows, capacity, row_col=ROW, left=left).where("kept").select(F.col("row").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
