"""Chat logs: collapse cumulative snapshots, then render the conversations that stay.

A chat client that logs the whole conversation after every exchange leaves prefixes
of the final one behind. A rolling hash runs over each conversation's turns, so that
the hash after turn k names the first k turns: the exclusive or of two 64-bit hashes of
each turn and its place, which a window keeps up in one pass whatever the length. A
conversation whose own hash is a prefix hash of a longer one is a snapshot of it and goes
by an anti-join. Texts are left out until the conversations that stay are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decilog.llm.common import need

#: Chat markup written around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The two hashes and the turns that they cover name a prefix.
PREFIX = ["h1", "h2", "k"]


def turn_mark(role: Column, text: Column) -> Column:
    """A turn as a string that no other (role, text) gives; null differs from empty."""
    side = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(side(role), F.lit("|"), side(text))


def turn_hash(seed: int, place: Column) -> Column:
    return F.xxhash64(F.lit(seed), place, turn_mark(F.col("role"), F.col("text")))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, k, n_turns, h1, h2 of the first k turns of every conversation, k = 1..n_turns.

    Turns are ordered by turn number, then role and text, so repeated numbers have one
    order. A row without conv_id is a conversation of its own.
    """
    rows = need(conversations, "conv_id", "turn", "role", "text")
    own = Window.partitionBy("conv_id")
    order = own.orderBy("turn", "role", "text")
    placed = rows.where("conv_id IS NOT NULL").withColumns({"k": F.row_number().over(order), "n_turns": F.count(F.lit(1)).over(own)})
    marked = placed.select("conv_id", "k", "n_turns", *[turn_hash(s, F.col("k")).alias(f"m{s}") for s in (1, 2)])
    so_far = own.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = marked.select("conv_id", "k", "n_turns", *[F.bit_xor(f"m{s}").over(so_far).alias(f"h{s}") for s in (1, 2)])
    single = rows.where("conv_id IS NULL").select("conv_id", F.lit(1).alias("k"), F.lit(1).cast("long").alias("n_turns"), *[turn_hash(s, F.lit(1)).alias(f"h{s}") for s in (1, 2)])
    return rolled.unionByName(single)


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, h1, h2 of the maximal conversations.

    Of conversations with equal turns the smallest conv_id stays, and null only if none
    has an id. Null roles and texts are values of their own. An empty table gives no rows.
    """
    hashed = prefix_hashes(conversations)
    longer = hashed.where("k < n_turns").select(*PREFIX).distinct()
    whole = hashed.where("k = n_turns").join(longer, PREFIX, "left_anti")
    return whole.groupBy(*PREFIX).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"), F.first("n_turns").alias("n_turns")).drop("k")


def line(role: Column, text: Column) -> Column:
    """Chat markup of a turn; a null role reads ``user``, a null text is empty."""
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE), F.lit("\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, copies, chat.

    A rendered conversation is one row by its nature; only those that stay are gathered.
    Extra columns are not read.
    """
    kept = collapse_snapshots(conversations)
    rows = need(conversations, "conv_id", "turn", "role", "text")
    turns = rows.join(kept.where("conv_id IS NOT NULL").select("conv_id"), "conv_id", "left_semi")
    said = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    chats = said.select("conv_id", F.array_join(F.transform("turns", lambda t: line(t["role"], t["text"])), "").alias("chat"))
    named = kept.where("conv_id IS NOT NULL").join(chats, "conv_id").select("conv_id", "n_turns", "copies", "chat")
    single = rows.where("conv_id IS NULL").select(*[turn_hash(s, F.lit(1)).alias(f"h{s}") for s in (1, 2)], line(F.col("role"), F.col("text")).alias("chat"))
    alone = kept.where("conv_id IS NULL").join(single.groupBy("h1", "h2").agg(F.first("chat").alias("chat")), ["h1", "h2"])
    return named.unionByName(alone.select("conv_id", "n_turns", "copies", "chat"))
