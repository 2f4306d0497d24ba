"""Sharding by balanced label propagation, at most one row apart (law: rows).

Documents with equal texts are linked, and so are those that a caller's link table names. A document begins
in the shard of its id's hash. In each round the link table is joined to its neighbours' shards: a node's
documents want the shards with most of their neighbours among those with room (one, or as many as the
node fills), and the moves into a shard are scaled to its quota. At the end documents are joined
with their node's shards, and what is left is evened out exactly: shards over their share
give up unlinked documents first.

The documents of one text have the same neighbours, so they are one node, whose state is one row: its count by
shard (at most as many entries as shards). A text that a third of all rows hold costs no more than
another; it fills one shard after another. Links of a hub meet its state salted.

Defined cases: null text counts as empty (all null and empty texts are one group); repeated rows are
rows; fewer documents than shards leave shards empty; null ids are hashed like any value, and no link names
them; links to unknown ids and to the same text are passed over; a text of any length is one row of its size; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, gapless_rank, utf8_crc32

SHARDS = 40
ROUNDS = 16
SALTS = 512
#: Groups of linked documents that one task of a round works on.
PARTITION_ROWS = 100_000


def _facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        utf8_crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("grp"),
    )


def _tally(entries: DataFrame, shards: int) -> list[int]:
    """Sum of ``n`` by ``shard``: one row of ``shards`` numbers, without a shuffle by key."""
    of = [F.coalesce(F.sum(F.when(F.col("shard") == s, F.col("n"))), F.lit(0)).alias(f"s{s}") for s in range(shards)]
    return list(entries.agg(*of).first())


def _pulls(links: DataFrame, hubs: DataFrame, cells: DataFrame, shards: int) -> DataFrame:
    """(grp, pulls, other): how many of a node's neighbours are in each shard; has it any but itself?

    ``hubs``: the (v, _salt) of the links.
    """
    near = hubs.join(cells.withColumnRenamed("grp", "v"), "v")
    votes = links.join(near, ["v", "_salt"]).select("u", (F.col("u") != F.col("v")).alias("other"), F.inline("shares"))
    counts = [F.coalesce(F.sum(F.when(F.col("shard") == s, F.col("n"))), F.lit(0)) for s in range(shards)]
    return votes.groupBy("u").agg(F.array(*counts).alias("pulls"), F.bool_or("other").alias("other")).withColumnRenamed("u", "grp")


def _wishes(cells: DataFrame, pulls: DataFrame, targets: list[int], load: list[int]) -> DataFrame:
    """``cells`` and which of a node's documents want where: moves (shard, to, n)."""
    open_ = F.array(*[F.lit(x < t) for t, x in zip(targets, load)])
    place = lambda n, s: F.struct(n.alias("pull"), F.xxhash64("grp", s).alias("h"), s.alias("shard"))
    joined = cells.join(pulls, "grp")
    wanted = F.filter(F.transform("pulls", lambda n, s: place(n, s.cast("int"))), lambda r: (r["pull"] > 0) & open_[r["shard"]])
    own = F.aggregate(F.filter("shares", lambda x: open_[x["shard"]]), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    # The neighbours' shards: those with most of them, as many as the node's documents fill.
    most = F.greatest(F.lit(1), F.ceil(F.col("own") / max(targets[-1], 1))).cast("int")
    ranked = joined.select("grp", "shares", "pulls", "other", F.sort_array(wanted, False).alias("order"), own.alias("own")).withColumn("top", F.slice("order", 1, most))
    least = F.get("top", F.size("top") - 1)
    to = lambda r: F.get("top", F.pmod(r["h"], F.greatest(F.size("top"), F.lit(1))).cast("int"))["shard"]
    # Copies settle on one shard by a common order; towards other nodes only more neighbours are a reason to move.
    mine = lambda x: place(F.get("pulls", x["shard"]), x["shard"])
    behind = F.filter("shares", lambda x: F.when(F.col("other"), F.get("pulls", x["shard"]) < least["pull"]).otherwise(mine(x) < least))
    moves = F.transform(behind, lambda x: F.struct(x["shard"].alias("shard"), to(place(x["n"], x["shard"])).alias("to"), x["n"].alias("n")))
    return ranked.select("grp", "shares", "other", moves.alias("moves"))


def _moved(wishes: DataFrame, part: list[float], turn: int) -> DataFrame:
    """The cells after the share ``part[to]`` of every move; fractions are drawn by a hash."""
    share = F.array(*map(F.lit, part))

    def going(m):
        exact = m["n"] * share[m["to"]] * F.when(F.col("other"), 0.5).otherwise(1.0)  # neighbours mustn't swap places for ever
        luck = F.pmod(F.xxhash64("grp", m["shard"], m["to"], F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        return F.least(m["n"], (F.floor(exact) + F.when(luck < exact - F.floor(exact), 1).otherwise(0)).cast("long"))

    def entry(shard, n):
        return F.struct(shard.alias("shard"), n.alias("n"))

    left = F.transform("moves", lambda m: entry(m["shard"], -going(m)))
    came = F.transform("moves", lambda m: entry(m["to"], going(m)))
    summed = wishes.select("grp", "moves", "other", F.concat("shares", left, came).alias("parts"))

    def total(s):
        return entry(s, F.aggregate(F.filter("parts", lambda p: p["shard"] == s), F.lit(0).cast("long"), lambda a, p: a + p["n"]))

    shares = F.filter(F.transform(F.array_distinct(F.transform("parts", lambda p: p["shard"])), total), lambda x: x["n"] > 0)
    return summed.select("grp", shares.alias("shares"))


def propagate(cells: DataFrame, links: DataFrame, targets: list[int], rounds: int = ROUNDS, salts: int = SALTS) -> DataFrame:
    """Move linked documents between shards: (grp, shares array of (shard, n)) in, the same out.

    links: (u, v), in both directions; a node of several documents is linked to itself.
    targets[s]: how many rows shard s may hold in all. Both frames are read in every round:
    hand them in materialised.
    """
    shards = len(targets)
    links = cut(links.withColumn("_salt", F.pmod(F.xxhash64("u"), F.lit(salts)).cast("int")))
    hubs = cut(links.select("v", "_salt").distinct())
    load = _tally(cells.select(F.inline("shares")), shards)
    for turn in range(rounds):
        wishes = cut(_wishes(cells, _pulls(links, hubs, cells, shards), targets, load))
        asked = _tally(wishes.select(F.inline("moves")).select(F.col("to").alias("shard"), "n"), shards)
        room = [max(0, t - x) for t, x in zip(targets, load)]
        # Over quota, most of it is dealt now and the rest in later rounds: chance must not overfill.
        part = [(1.0 if a <= r else 0.8 * r / a) if a else 0.0 for r, a in zip(room, asked)]
        if not any(p > 0 for p in part):
            break  # nobody wants to move, or nobody can
        # Materialised with the wishes; what is moved is arithmetic on a row.
        cells = _moved(wishes, part, turn)
        before, load = load, _tally(cells.select(F.inline("shares")), shards)
        if load == before and not any(0 < p < 1 for p in part) and wishes.where("other").isEmpty():
            break
    return cells


def cut_edges(cells: DataFrame, links: DataFrame) -> tuple[int, int]:
    """Linked pairs of documents in different shards, and all linked pairs."""
    a = links.join(cells.select(F.col("grp").alias("u"), F.col("shares").alias("a")), "u")
    both = a.join(cells.select(F.col("grp").alias("v"), F.col("shares").alias("b")), "v")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, r: x + r["n"])
    at = lambda s: F.aggregate(F.filter("b", lambda r: r["shard"] == s), F.lit(0).cast("long"), lambda x, r: x + r["n"])
    same = F.aggregate("a", F.lit(0).cast("long"), lambda x, r: x + r["n"] * at(r["shard"]))
    pairs = both.select((total("a") * total("b")).alias("all"), same.alias("same"), (F.col("u") == F.col("v")).alias("own"), total("a").alias("n"))
    # Every link stands there twice; of a node with itself each document is no pair.
    found = pairs.agg(F.sum(F.when(F.col("own"), F.col("all") - F.col("n")).otherwise(F.col("all"))).alias("all"), F.sum(F.when(F.col("own"), F.col("all") - F.col("same")).otherwise(F.col("all") - F.col("same"))).alias("cut")).first()
    return (found["cut"] or 0) // 2, (found["all"] or 0) // 2


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, salts: int = SALTS, id_col: str = "doc_id", text_col: str = "text", links: DataFrame | None = None, report: dict | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), linked.

    links: (u, v) of document ids that belong together besides those of equal texts. ``report`` gets the
    linked pairs that are cut before and after the rounds, and all of them.
    """
    facts = cut(_facts(docs, id_col, text_col))
    total = facts.count()
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    start = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    sizes = facts.groupBy("grp", start.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    cells = cut(sizes.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("shares")))
    copies = cells.where((F.size("shares") > 1) | (F.col("shares")[0]["n"] > 1))
    edges = copies.select(F.col("grp").alias("u"), F.col("grp").alias("v"))
    if links is not None:
        # Ids may stand for several texts; a hub's links meet its texts salted.
        texts = cut(facts.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("grp").alias("grps")))
        named = cut(links.select(F.col("u").cast("long").alias("a"), F.col("v").cast("long").alias("b")).where("a <> b").distinct())
        named = attach(named, texts.select(F.col("doc_id").alias("a"), F.col("grps").alias("us")), "a", ["b"])
        named = attach(cut(named), texts.select(F.col("doc_id").alias("b"), F.col("grps").alias("vs")), "b", ["a"])
        pairs = named.select(F.explode("us").alias("u"), "vs").select("u", F.explode("vs").alias("v")).where("u <> v")
        edges = edges.unionByName(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        copies = cells.join(edges.select(F.col("u").alias("grp")).distinct(), "grp", "left_semi")
    # A round is short work on one small row a node: as many partitions as its rows need.
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    copies = cut(copies)
    width = max(parallel, copies.count() // PARTITION_ROWS)
    copies, edges = copies.coalesce(width), cut(edges.coalesce(width))
    linked = propagate(copies, edges, targets, rounds)
    if report is not None:
        (report["cut_before"], report["pairs"]), (report["cut_after"], _) = cut_edges(copies, edges), cut_edges(linked, edges)
    # A group's shares as intervals of its members' ranks.
    shares = linked.select("grp", F.array_sort("shares").alias("shares"))
    ranked = gapless_rank(facts, ["grp"], ["doc_id", "size"], salts, "_member", shares)
    walk = F.aggregate(
        "shares",
        F.struct(F.col("_member").alias("left"), F.lit(-1).alias("shard")),
        lambda a, x: F.struct((a["left"] - x["n"]).alias("left"), F.when((a["left"] >= 0) & (a["left"] < x["n"]), x["shard"]).otherwise(a["shard"]).alias("shard")),
        lambda a: a["shard"],
    )
    placed = ranked.select("doc_id", "size", "text_crc32", F.coalesce(walk, start).alias("shard"), F.col("shares").isNotNull().alias("linked"))
    placed = _even(cut(placed), targets, salts)
    slotted = gapless_rank(cut(placed), ["shard"], ["doc_id", "size", "text_crc32"], salts, "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")


def _even(placed: DataFrame, targets: list[int], salts: int) -> DataFrame:
    """Bring every shard to its target: unlinked rows of full shards move into the gaps."""
    shards = len(targets)
    count = {(r["shard"], r["linked"]): r["n"] for r in placed.groupBy("shard", "linked").agg(F.count(F.lit(1)).alias("n")).collect()}
    over = [max(0, count.get((s, False), 0) + count.get((s, True), 0) - t) for s, t in enumerate(targets)]
    gaps = [max(0, t - count.get((s, False), 0) - count.get((s, True), 0)) for s, t in enumerate(targets)]
    give = {}
    for s, n in enumerate(over):
        give[s, False] = min(n, count.get((s, False), 0))
        give[s, True] = n - give[s, False]
    if not any(over):
        return placed
    first, upto = 0, []
    base = {}
    for key in sorted(give):
        base[key] = first
        first += give[key]
    for s in range(shards):
        upto.append(sum(gaps[: s + 1]))
    at = F.col("shard") * 2 + F.col("linked").cast("int")
    quota = F.array(*[F.lit(give[s, k]) for s in range(shards) for k in (False, True)])[at]
    offset = F.array(*[F.lit(base[s, k]) for s in range(shards) for k in (False, True)])[at]
    ranked = gapless_rank(placed, ["shard", "linked"], ["doc_id", "size", "text_crc32"], salts, "_r")
    turn = offset + F.col("_r")
    target = F.size(F.filter(F.array(*[F.lit(u) for u in upto]), lambda u: u <= turn))
    return ranked.withColumn("shard", F.when(F.col("_r") < quota, target).otherwise(F.col("shard"))).drop("_r")
