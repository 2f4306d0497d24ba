"""Chat formatting with cumulative snapshots collapsed, with DataFrame functions only.

Logs often hold a conversation again and again as it grows. A rolling hash over a
conversation's turns names each of its prefixes: a turn is hashed with its place, and a prefix is told by its
length and the running exclusive or of its turns' hashes (120 bits). A conversation whose whole hash is a proper
prefix of another's is a snapshot and goes by an anti-join, and of equal conversations the
smallest id stays. The maximal conversations are then rendered.

Prefixes are rows of one window over the turns, so a very long conversation costs no more than its turns;
only those that stay are gathered, each into its row.

Defined cases: turns go by number (nulls first), then role and text; equal rows of a
conversation count once; a null role reads "unknown", a null text is empty; a row without conversation id
is a conversation by itself, as nothing says that two such rows belong together; texts of any length are hashed and
rendered whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What tells conversations apart: rows without id by their own content.
KEY = ["none", "key", "own"]
#: What tells prefixes apart: length and hash.
PREFIX = ["place", "x", "y"]


def prefixes(turns: DataFrame) -> DataFrame:
    """One row a turn: its conversation, its place from 1, the hash of the prefix that it ends, is it the last?"""
    row = turns.select(F.col("conv_id").cast("long").alias("id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The role's length keeps (role, text) pairs apart whatever they hold.
    said = (F.length("role").cast("string"), F.col("role"), F.col("text"))
    own = F.when(F.col("id").isNull(), F.sha2(F.concat_ws("\x01", F.coalesce(F.col("turn").cast("string"), F.lit("")), *said), 256)).otherwise("")
    keyed = row.select(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("key"), own.alias("own"), "turn", "role", "text")
    order = Window.partitionBy(*KEY).orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = F.lag(F.struct("turn", "role", "text")).over(order)
    once = keyed.withColumn("same", before.eqNullSafe(F.struct("turn", "role", "text"))).where("not same").drop("same")
    placed = once.withColumn("place", F.row_number().over(order))
    digest = placed.withColumn("digest", F.sha2(F.concat_ws("\x01", F.col("place").cast("string"), *said), 256))
    halves = [F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("long") for i in (0, 1)]
    rolled = [F.bit_xor(h).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(n) for h, n in zip(halves, "xy")]
    return digest.select(*KEY, "turn", "role", "text", "place", *rolled, F.lead("place").over(order).isNull().alias("last"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns of the conversations that prefix no other."""
    told = prefixes(turns)
    short = told.where("not last").select(*PREFIX).distinct()
    first = told.where("last").groupBy(*PREFIX).agg(F.min(F.struct(*KEY)).alias("k"))
    kept = first.join(short, PREFIX, "left_anti").select("k.*")
    talks = told.join(kept, KEY, "left_semi").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("place", "turn", "role", "text"))).alias("t"))
    own = F.when(~F.col("none"), F.col("key"))
    return talks.select(own.alias("conv_id"), F.size("t").alias("n_turns"), F.transform("t", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(talks: DataFrame) -> DataFrame:
    """conv_id, n_turns, text: each turn under its role's mark."""
    line = F.transform("turns", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n")))
    return talks.select("conv_id", "n_turns", F.array_join(line, "").alias("text"))


def collapse(turns: DataFrame) -> DataFrame:
    """The maximal conversations, rendered."""
    return render(maximal(turns))
