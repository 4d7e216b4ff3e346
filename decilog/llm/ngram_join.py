"""Near duplicates by Jaccard similarity of word shingles, with several token orders.

Prefix filtering: under any total order of shingles, two sets of sizes n and m that link
have ``least = ceil(t (n + m) / (100 + t))`` shingles in common, so of the first p of a
set at most ``n - least`` are not shared. Two orders are used that have no key in common:
rare shingles first (by a table of counts of fixed size; that only decides how selective
the prefixes are, never what is found), and a hash. A candidate must share as many prefix
shingles under the first order as its two sizes ask for, then under the second, before
its whole sets are compared.

Pairs are counted over the shingles that few sets have (at most HOT, so the pairs are
linear in the rows). A shingle that more sets have is not paired out: in each round all
its sets meet a few hubs, links join components, and only shingles whose sets are in
several components go on. The first hub is the set with the fewest rarer shingles, which
in a family of near copies is its centre. Later hubs come from outside the largest
component, twice as many in each round; a set that has been a hub is done. SHARED common
shingles stand among the first ``n - least + SHARED`` of each set; counted for each band of
partner sizes, that leaves out most sets that are not near any other. Equal sets are one set.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decilog.llm.common import ROW, Scratch, delete_shared, keyed_rows, need, shared_dir
from decilog.llm.components import components
from decilog.llm.shingles import distinct, mix, rounds

#: Sets with a prefix shingle up to which its pairs are counted; beyond, they meet hubs.
HOT = 32
#: Sets left with a shingle up to which all of them become hubs at once.
PAIRED = 32
#: Shingles by which prefixes are longer than one shared shingle asks for, and one.
SHARED = 3
#: Bands of sizes within the factor by which sizes of linking sets differ at most.
BANDS = 16
#: Bits of the map of wanted ids: eight for each, between these ends (16 MB at most). Beyond, ids are joined first.
MAP_BITS = (20, 27)
#: Bits of the table of hashed counts. Each task gives up to 2**bits of them, so the table must not grow with the tasks.
COUNT_BITS = 20
#: A shingle's key: its count's level in the top bits, then its hash.
LEVEL_BITS = np.uint64(8)


def prefix_size(n: int, threshold: int, shared: int = 1) -> int:
    """n - ceil(threshold n / 100) + shared: sets that link share that many of their first shingles."""
    return n + (-threshold * n // 100) + shared


def least_common(n: Column, m: Column, threshold: int) -> Column:
    """ceil(threshold (n + m) / (100 + threshold)): what linking sets of these sizes have in common."""
    return F.ceil(threshold * (n + m) / F.lit(100 + threshold))


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes >> np.uint64(8)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def keys_of(hashes: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """Keys whose order is rare before frequent, then by hash."""
    return (levels[bucket_of(hashes, bits)].astype(np.uint64) << (np.uint64(64) - LEVEL_BITS)) | (hashes >> LEVEL_BITS)


def count_levels(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """How frequent shingles are by ``2**bits`` hashed counts: eight levels for each doubling over the mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, hashes, _ in rounds(batch.column(0), width):
                np.add.at(total, bucket_of(hashes, bits), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    got = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2**bits rows
    counts = np.zeros(1 << bits)
    counts[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return np.clip(8 * np.log2(np.maximum(counts / max(1.0, counts.mean()), 1)), 0, 255).astype(np.uint8)


def lists(arrays: list[np.ndarray | None]) -> pa.Array:
    """A list column of unsigned keys, as signed numbers of the same bits."""
    sizes = np.array([0 if a is None else len(a) for a in arrays])
    values = np.concatenate([a for a in arrays if a is not None] or [np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values), mask=pa.array([a is None for a in arrays], pa.bool_()))


def signatures(docs: DataFrame, width: int, threshold: int, levels: np.ndarray, bits: int) -> DataFrame:
    """doc_id, n, digest of the set (null if empty) and its prefix under the first order.

    Of equal sets in one task only the first has a prefix, so a group of copies
    leaves at most one row for each task in the index.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # 2**bits bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()  # of this batch
            for first, rows, hashes, places in rounds(batch.column(1), width):
                found = distinct(keys_of(hashes, shared.value, bits), places)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found]
                firsts: list[np.ndarray | None] = []
                for s, digest in zip(found, digests):
                    new = digest is not None and digest not in seen
                    firsts.append(s[: prefix_size(len(s), threshold, SHARED)] if new else None)
                    if new:
                        seen.add(digest)
                sizes = pa.array(np.fromiter(map(len, found), np.int64, rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), sizes, pa.array(digests, pa.binary()), lists(firsts)], ["doc_id", "n", "digest", "prefix"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, prefix array<long>")


def bits_for(n: int, ends: tuple[int, int]) -> int:
    """The bits of a table of at least ``n`` entries, between two ends."""
    return min(max(math.ceil(math.log2(max(n, 1))), ends[0]), ends[1])


def id_map(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit map of the hashes of ``id``: a full map lets all documents pass, never too few."""
    at = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    words = ids.select(F.floor(at / 32).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int")).alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # at most 2**bits / 32 rows
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[got["word"].to_numpy()] = got["bit"].to_numpy().astype(np.uint32)
    return out


def sets(docs: DataFrame, ids: np.ndarray, width: int, threshold: int, levels: np.ndarray, bits: int) -> DataFrame:
    """id, n, the whole set and its prefix under the second order, of the documents in the map (and a few more)."""
    shared = docs.sparkSession.sparkContext.broadcast((levels, ids))  # fixed size
    size = len(ids) * 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, ids = shared.value
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((ids[at // 32] >> (at % 32).astype(np.uint32)) & 1 == 1))
            for first, rows, hashes, places in rounds(batch.column(1), width):
                found = distinct(keys_of(hashes, levels, bits), places)
                second = [np.sort(mix(s << LEVEL_BITS, 77))[: prefix_size(len(s), threshold, SHARED)] for s in found]
                sizes = pa.array(np.fromiter(map(len, found), np.int64, rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), sizes, lists(found), lists(second)], ["id", "n", "s", "p2"])

    hashed = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(size)).alias("at"))
    return hashed.mapInArrow(run, "id long, n long, s array<long>, p2 array<long>")


class SetTable:
    """Sets and second prefixes, bucketed by id in the shared folder: pairs come to the sets, not the sets to the pairs."""

    def __init__(self, texts: DataFrame) -> None:
        self.spark = texts.sparkSession
        self.name = f"join_sets_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = texts.repartition(buckets, "id").write.bucketBy(buckets, "id").format("parquet")
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        writer.option("path", self.path).saveAsTable(self.name)

    def only(self, ids: DataFrame) -> SetTable:
        return SetTable(self.spark.table(self.name).join(ids, "id", "left_semi"))

    def side(self, end: str, column: str, name: str) -> DataFrame:
        return self.spark.table(self.name).select(F.col("id").alias(end), F.col("n").alias(f"n{end}"), F.col(column).alias(name))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_shared(self.spark, self.path)


def verify(pairs: DataFrame, texts: SetTable, threshold: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that pass the second filter and reach the threshold.

    The prefixes of the second order, a sixth of the sets, are met first; only pairs
    that share enough of them see the sets.
    """
    near = pairs.join(texts.side("a", "p2", "pa"), "a").join(texts.side("b", "p2", "pb"), "b")
    spare = least_common(F.col("na"), F.col("nb"), threshold)
    least = F.least(F.size("pa") + spare - F.col("na"), F.size("pb") + spare - F.col("nb"))
    near = scratch.stage(near.where(F.size(F.array_intersect("pa", "pb")) >= least).select("a", "b"), "join-near")
    both = near.join(texts.side("a", "s", "sa"), "a").join(texts.side("b", "s", "sb").drop("nb"), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * inter >= threshold * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


def place_fits(threshold: int) -> Column:
    """Whether a shared shingle at ``place`` of n and ``hub_place`` of hub_n can be one of the first SHARED of a linking pair."""
    least = least_common(F.col("n"), F.col("hub_n"), threshold)
    sizes = 100 * F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n")
    return sizes & (F.col("place") <= F.col("n") - least + SHARED - 1) & (F.col("hub_place") <= F.col("hub_n") - least + SHARED - 1)


def dense_rows(rows: DataFrame, threshold: int, apart: str, scratch: Scratch, turns: int = 2) -> DataFrame:
    """Rows that can still link: of ids with SHARED rows at least, over shingles whose rows differ in ``apart``.

    Pairs that share fewer of the shingles with many rows are among the counted
    pairs, so whoever has fewer has no partner left. A row whose place is too late even
    for the shingle's smallest set that fits in size is left out. Dropping rows thins
    out other shingles; two turns take most of it.
    """
    for _ in range(turns):
        mixed = rows.groupBy("token").agg(F.min(apart).alias("low"), F.max(apart).alias("high"), F.min("n").alias("small"))
        live = scratch.stage(rows.join(mixed.where("low <> high").drop("low", "high"), "token").where(in_place(threshold)).drop("small"), "join-dense")
        full = live.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("_n")).where(F.col("k") >= few(threshold)).select("id")
        rows = scratch.stage(live.join(full, "id", "left_semi"), "join-dense")
    return rows


def few(threshold: int) -> Column:
    """SHARED, or all of a linking set's shingles that the smallest set in reach can have."""
    return F.least(F.lit(SHARED), F.ceil(threshold * F.col("_n") / F.lit(100)))


def in_place(threshold: int) -> Column:
    """Whether ``place`` can be one of the first SHARED common ones with a set of ``small`` shingles or more."""
    partner = F.greatest(F.col("small"), F.ceil(threshold * F.col("n") / F.lit(100)))
    return F.col("place") <= F.col("n") - least_common(F.col("n"), partner, threshold) + SHARED - 1


def banded(rows: DataFrame, threshold: int) -> DataFrame:
    """Rows by shingle and band of sizes: token, band, id, n, place, home.

    A row is at home in the band of its own size and visits the bands below it, down
    to where sizes no longer fit, that its shingle has and where its place is early enough.
    Sets that link meet in the band of the smaller one, one of them at home. Bands are about
    one hundredth wide, so a row visits BANDS of them at most.
    """
    band = F.floor(F.log("n") / math.log(100 / threshold) * BANDS + 1e-9)
    own = rows.withColumn("own", band)
    spans = own.groupBy("token", F.col("own").alias("band")).agg(F.min("n").alias("small"))
    met = own.join(spans, "token").where(F.col("band").between(F.col("own") - BANDS - 1, F.col("own"))).where(in_place(threshold))
    return met.select("token", "band", "id", "n", "place", (F.col("band") == F.col("own")).alias("home"))


def live_groups(rows: DataFrame, threshold: int, scratch: Scratch, turns: int = 2) -> DataFrame:
    """Rows of (shingle, band) groups that lie in several components, of ids with enough of them in the band."""
    for _ in range(turns):
        mixed = rows.groupBy("token", "band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("home").alias("some"))
        live = scratch.stage(rows.join(mixed.where("low <> high AND some").select("token", "band"), ["token", "band"], "left_semi"), "join-live")
        full = live.groupBy("band", "id").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("_n")).where(F.col("k") >= few(threshold)).select("band", "id")
        rows = scratch.stage(live.join(full, ["band", "id"], "left_semi"), "join-live")
    return rows


def hub_pairs(rows: DataFrame, turn: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) of each row with its group's hubs across components, and the (token, band, id) rows that are done with.

    Turn 0 has one hub a group. After it all rows at home are hubs if they are few,
    else 2^turn of the rows outside the component that has most of the group's rows
    (all of those if the group has few rows), so that whoever stays is in that one.
    """
    group = ["token", "band"]
    rank = F.struct("place", F.xxhash64("id").alias("h"), "id", "n", "comp", "home")
    if turn == 0:
        hubs = rows.groupBy(*group).agg(F.min(rank).alias("hub"))
    else:
        sizes = rows.groupBy(*group, "comp").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("home").cast("int")).alias("homes"))
        main = sizes.groupBy(*group).agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), F.sum("k").alias("rows"), F.sum("homes").alias("homes"))
        own = rows.join(main, group).where(F.when(F.col("homes") <= PAIRED, F.col("home")).otherwise(F.col("comp") != F.col("main")))
        slot = F.when(F.least("homes", "rows") <= PAIRED, F.col("id")).otherwise(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << min(turn, 40))))
        hubs = own.groupBy(*group, slot.alias("slot")).agg(F.min(rank).alias("hub"))
    hubs = hubs.select(*group, *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("place", "id", "n", "comp", "home")])
    met = rows.join(hubs, group).where(F.col("comp") != F.col("hub_comp")).where((F.col("home") | F.col("hub_home")) & place_fits(threshold))
    return met.select(F.least("id", "hub_id").alias("a"), F.greatest("id", "hub_id").alias("b")).distinct(), hubs.select(*group, F.col("hub_id").alias("id"))


def counted_pairs(index: DataFrame, hot_ids: DataFrame, threshold: int) -> DataFrame:
    """Pairs that share enough prefix shingles: a, b.

    Counted over the shingles with few rows. Where both sets also have shingles with
    many rows, as many of the shared ones as the smaller number may be among those.
    """
    cold = index.where(F.col("rows") <= HOT).select("token", "id", "n")
    other = cold.select("token", F.col("id").alias("id2"), F.col("n").alias("n2"))
    met = cold.join(other, "token").where("id < id2").where(100 * F.least("n", "n2") >= threshold * F.greatest("n", "n2"))
    counted = met.groupBy(F.col("id").alias("a"), F.col("id2").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("na"), F.min("n2").alias("nb"))
    spare = least_common(F.col("na"), F.col("nb"), threshold)
    own = lambda n: F.least(n, n - F.ceil(threshold * n / F.lit(100)) + SHARED) + spare - n  # noqa: E731  prefix_size
    flag = lambda end: hot_ids.select(F.col("id").alias(end), F.col("k").alias(f"h{end}"))
    both = counted.join(flag("a"), "a", "left").join(flag("b"), "b", "left")
    hot = F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    return both.where(F.col("k") + hot >= F.least(own(F.col("na")), own(F.col("nb")))).select("a", "b")


def link_components(hot: DataFrame, links: DataFrame, texts: SetTable, threshold: int, scratch: Scratch, left: Scratch) -> DataFrame:
    """(id, comp) of every id with a link; a table of ``left``.

    hot: token, id, n, place of the shingles with many rows; links: (a, b) found
    before. Rounds of hubs go on until the rows of each shingle and band are in one
    component or done.
    """
    comp = components(links, left)

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    rows = dense_rows(placed(dense_rows(hot, threshold, "id", scratch, 1)), threshold, "comp", scratch).drop("comp")
    if not rows.take(1):
        return comp
    sides = texts.only(rows.select("id").distinct())
    rows = scratch.stage(banded(rows, threshold), "join-banded")
    turn, tested = 0, None
    while True:
        own = live_groups(placed(rows), threshold, scratch, 2 if turn < 2 else 1)
        if not own.take(1):
            break
        made, done = hub_pairs(own, turn, threshold)
        done = scratch.stage(done, "join-done")
        made = scratch.stage(made if tested is None else made.join(tested, ["a", "b"], "left_anti"), "join-pairs")
        new = scratch.stage(verify(made, sides, threshold, scratch), "join-links")
        tested = made if tested is None else tested.unionByName(made)
        rows = own.drop("comp").join(done, ["token", "band", "id"], "left_anti")
        if new.take(1):
            links = links.unionByName(new)
            left.drop(comp)
            comp = components(links, left)
        turn += 1
    sides.drop()
    return comp


def jaccard_components(docs: DataFrame, width: int = 5, threshold: int = 80, bits: int = COUNT_BITS, id_col: str = "doc_id", text_col: str = "text", left: Scratch | None = None, unique: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, set_id, component_id.

    Two documents link when ``100 * intersection >= threshold * union`` of their
    shingle sets. ``set_id`` is the smallest doc_id with an equal set, and
    ``component_id`` the smallest one reachable by links. Null and empty texts have
    an empty set and link with nothing. Every row is compared by its own text: where ids
    are missing or repeat, rows get keys of their own first (``unique`` says that this need not
    be looked for). Then both ids are the smallest of the rows with an equal set, and of
    those reachable by links; null if none of these has an id. Rows of one id are not linked
    by it. An empty table gives no rows. ``left`` gets the tables that the result is read
    from, to delete when it is written.
    """
    docs = need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    left = left or Scratch()
    if not unique and docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").take(1):
        rows = keyed_rows(docs, "join-keyed", left)
        found = jaccard_components(rows, width, threshold, bits, ROW, "text", left, unique=True).withColumnRenamed("doc_id", ROW).join(rows.select("doc_id", ROW), ROW)
        for c in ("set_id", "component_id"):
            found = found.join(found.groupBy(c).agg(F.min("doc_id").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
        return found.select("doc_id", "n_shingles", "set_id", "component_id")
    scratch = Scratch()
    levels = count_levels(docs, width, bits)
    whole = scratch.stage(signatures(docs, width, threshold, levels, bits), "join-whole")
    signed = left.stage(whole.select("doc_id", "n", "digest", F.col("prefix").isNotNull().alias("listed")), "join-signed")
    least = F.min(F.when(F.col("listed"), F.col("doc_id")))
    nodes = left.stage(signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"), least.alias("rep")), "join-nodes")
    copies = signed.where("listed").join(nodes, "digest").where("doc_id <> rep").select("doc_id")
    equal = nodes.where("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    listed = whole.where("prefix IS NOT NULL").join(copies, "doc_id", "left_anti")
    entries = listed.select(F.posexplode("prefix").alias("place", "token"), F.col("doc_id").alias("id"), "n")
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    index = scratch.stage(entries.join(shared, "token").select("token", "id", F.col("n").cast("int").alias("n"), F.col("place").cast("int").alias("place"), "rows"), "join-index")
    scratch.drop(whole)
    hot = index.where(F.col("rows") > HOT).select("token", "id", "n", "place")
    hot_ids = scratch.stage(hot.groupBy("id").agg(F.count(F.lit(1)).alias("k")), "join-hot")
    pairs = scratch.stage(counted_pairs(index, hot_ids, threshold), "join-pairs")
    wanted = scratch.stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(hot_ids.where(F.col("k") >= 1).select("id")).distinct(), "join-wanted")
    many = 8 * wanted.count()
    asked = docs if many <= 1 << MAP_BITS[1] else docs.join(wanted, docs["doc_id"] == wanted["id"], "left_semi")
    texts = SetTable(sets(asked, id_map(wanted, bits_for(many, MAP_BITS)), width, threshold, levels, bits))
    links = scratch.stage(verify(pairs, texts, threshold, scratch).unionByName(equal), "join-links")
    comp = link_components(hot, links, texts, threshold, scratch, left)
    texts.drop()
    scratch.clear()
    return (
        signed.select("doc_id", "n", "digest")
        .join(nodes, "digest", "left")
        .join(comp, "id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("id", "doc_id").alias("set_id"), F.coalesce("comp", "id", "doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, width: int = 5, threshold: int = 80, left: Scratch | None = None) -> DataFrame:
    """One row of each component, with all its columns: that with the smallest id, null ids last.

    Rows are judged by keys of their own, so null and repeated ids do no harm; rows
    without text all stay. An empty table gives an empty one. ``left`` as in
    :func:`jaccard_components`.
    """
    left = left or Scratch()
    rows = keyed_rows(docs, "join-docs", left)
    found = jaccard_components(rows, width, threshold, id_col=ROW, left=left, unique=True).select(F.col("doc_id").alias(ROW), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first")
    kept = found.join(rows.select("doc_id", ROW), ROW).groupBy("component_id").agg(first).select(F.col(f"first.{ROW}").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
