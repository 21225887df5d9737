"""Sharding by balanced label propagation; DataFrame functions only.

Documents start in shards of equal counts. In each round every document counts its neighbours by shard and
wishes for the shard that most of them are in. Wishes from a to b are met as far as wishes from b to a, or
documents of b without links, can be swapped against them: counts never change, so the quotas hold in every
round. A document stands for its own shard like one neighbour, so that a pair doesn't change places for ever.
Links come as memberships (document, hub): documents of one hub are linked, which says all pairs of a group
without making them; an edge is a hub of two. All orders go by hashes of ids, texts and hubs, so shards don't
depend on how the table is laid out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_tables, kept_table

#: Cells into which ranks are split, so that no window holds a shard.
CELLS = 1024
#: Cells into which the members of a hub are split, so that no window holds a large hub.
PARTS = 64
#: Rows that one step of unfolding repeated rows makes.
RUN = 4096
#: A hub with more than this share of all memberships is looked up by broadcast; there are fewer than its inverse. This changes no result.
WIDE_HUB = 1 / 1000


def ranked(df: DataFrame, by: list[str], cell: Column, groups: list[Column], order: list[Column], name: str, weight: Column | None = None) -> DataFrame:
    """A gapless rank from 0 within `by`, by cell, then groups, then order; with weight the running sum of it before the row.

    Sums of cells and of groups within cells are added to the place within a group: a window holds the cells of
    `by`, the groups of a cell or the rows of a group.
    """
    keys = [f"_g{k}" for k in range(len(groups))]
    df = df.withColumn("_cell", cell).withColumns(dict(zip(keys, groups, strict=True))).withColumn("_w", F.lit(1).cast("bigint") if weight is None else weight)
    sums = df.groupBy(*by, "_cell", *keys).agg(F.sum("_w").alias("_n"))
    cells = sums.groupBy(*by, "_cell").agg(F.sum("_n").alias("_all"))
    cells = cells.withColumn("_start", F.sum("_all").over(W.partitionBy(*by).orderBy("_cell")) - F.col("_all")).drop("_all")

    def met(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
        right = right.withColumnsRenamed({c: f"_k_{c}" for c in names})
        where = F.lit(True)
        for c in names:
            where &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        return left.join(right, where).drop(*(f"_k_{c}" for c in names))

    if keys:
        inner = W.partitionBy(*by, "_cell").orderBy(*keys)
        sums = met(sums.withColumn("_before", F.sum("_n").over(inner) - F.col("_n")).drop("_n"), cells, [*by, "_cell"])
    else:
        sums = cells.withColumn("_before", F.lit(0).cast("bigint"))
    last = W.partitionBy(*by, "_cell", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = met(df.withColumn("_up", F.sum("_w").over(last) - F.col("_w")), sums, [*by, "_cell", *keys])
    return placed.withColumn(name, (F.col("_start") + F.col("_before") + F.col("_up")).cast("bigint")).drop("_cell", *keys, "_w", "_up", "_start", "_before")


def cell_of(*columns, of: int = CELLS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(of))


def literal_rows(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table as a literal."""
    cells = F.array(*(F.struct(*(F.lit(int(v)).cast("bigint").alias(n) for n, v in zip(names, r, strict=True))) for r in rows))
    return spark.range(1).select(F.inline(cells))


def label_propagation(docs: DataFrame, links: DataFrame, n_shards: int = 8, rounds: int = 6, seed: int = 0) -> DataFrame:
    """(row, shard) from docs (row unique) and links (row, hub).

    Counts of shards differ by one at most, in every round. Null hubs link nothing, memberships of rows that
    docs lacks are ignored. Ties between shards go by a hash of hub and shard, so that members of a hub agree.
    """
    spark = docs.sparkSession
    links = links.filter(F.col("hub").isNotNull()).select("row", "hub").distinct()
    sized = links.groupBy("hub").agg(F.count("*").alias("members")).filter("members > 1")
    sized = kept_table(sized, "hubs")
    many = sized.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    links = kept_table(links.join(sized, "hub").select("row", "hub", (F.col("members") > F.lit(max(2.0, many * WIDE_HUB))).alias("wide")), "links")
    wide = kept_table(sized.filter(F.col("members") > F.lit(max(2.0, many * WIDE_HUB))).select("hub"), "wide-hubs")
    start = ranked(docs.select("row"), [], cell_of("row", F.lit(seed)), [], [F.col("row")], "place")
    state = kept_table(start.select("row", F.pmod("place", F.lit(n_shards)).cast("int").alias("shard")), "shards")
    home = links.groupBy("row").agg(F.min("hub").alias("hub"), F.count("*").alias("hubs"))
    for turn in range(rounds):
        at = links.join(state, "row")
        counts = at.groupBy("hub", "shard").agg(F.count("*").alias("n"))
        shown = counts.groupBy("hub").agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("found"))
        # At most 1 / WIDE_HUB hubs are wide, so their counts are a table of proven size.
        slim = links.filter(~F.col("wide")).select("row", "hub").join(shown, "hub")
        broad = links.filter("wide").select("row", "hub").join(F.broadcast(shown.join(F.broadcast(wide), "hub", "left_semi")), "hub")
        near = slim.unionByName(broad).select("row", F.explode("found").alias("other", "n")).groupBy("row", "other").agg(F.sum("n").alias("n"))
        # A document is in all its own counts; it counts for its shard once.
        lead = home.join(near, "row").join(state, "row").withColumn("tie", F.xxhash64("hub", "other")).withColumn("n", F.col("n") - F.when(F.col("other") == F.col("shard"), F.col("hubs") - 1).otherwise(0))
        best = lead.groupBy("row").agg(F.max(F.struct("n", "tie", "other")).alias("b"), F.first("shard").alias("shard"), F.first("hub").alias("hub"))
        moves = best.filter(F.col("b.other") != F.col("shard")).select("row", "shard", F.col("b.other").alias("to"), "hub")
        moves = kept_table(moves, "moves")
        idle = state.join(links.select("row"), "row", "left_anti")
        # n_shards squared numbers, whatever the input.
        want = {(r["shard"], r["to"]): r["n"] for r in moves.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}
        free = {r["shard"]: r["n"] for r in idle.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        swap, fill = quotas(want, free, n_shards)
        if not any(swap.values()):
            break
        met = literal_rows(spark, [(a, b, k) for (a, b), k in swap.items() if k], ["shard", "to", "quota"])
        going = ranked(moves.join(F.broadcast(met), ["shard", "to"]), ["shard", "to"], cell_of("hub", F.lit(turn)), [F.col("hub"), cell_of("row", of=PARTS)], [F.col("row")], "place").filter("place < quota").select("row", F.col("to").cast("int").alias("new"))
        spans, base = [], {}
        for (a, b), k in fill.items():
            spans.append((a, base.get(a, 0), base.get(a, 0) + k, b))
            base[a] = base.get(a, 0) + k
        filled = None
        if spans:
            table = literal_rows(spark, spans, ["shard", "low", "high", "new"])
            most = literal_rows(spark, list(base.items()), ["shard", "most"])
            waiting = ranked(idle.join(F.broadcast(most), "shard"), ["shard"], cell_of("row", F.lit(turn)), [], [F.col("row")], "place").filter("place < most")
            filled = waiting.join(F.broadcast(table), "shard").filter("place >= low and place < high").select("row", F.col("new").cast("int").alias("new"))
        moved = going if filled is None else going.unionByName(filled)
        old, state = [state, moves], kept_table(state.join(moved, "row", "left").select("row", F.coalesce("new", "shard").alias("shard")), "shards")
        drop_tables(spark, old)
    return state


def quotas(want: dict[tuple[int, int], int], free: dict[int, int], n_shards: int) -> tuple[dict, dict]:
    """How many wishes from a to b are met, and how many documents without links go from b to a for them.

    Wishes are met against wishes the other way first; unlinked documents of b stand in for what is missing,
    shared among the shards that wish for b in proportion to what they lack.
    """
    swap, fill = {}, {}
    for b in range(n_shards):
        lack = {a: max(0, want.get((a, b), 0) - want.get((b, a), 0)) for a in range(n_shards) if a != b}
        whole, have = sum(lack.values()), free.get(b, 0)
        for a, x in lack.items():
            both = min(want.get((a, b), 0), want.get((b, a), 0))
            more = x if whole <= have else x * have // whole
            swap[a, b] = both + more
            if more:
                fill[b, a] = more
    return swap, fill


def shard_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n_shards: int = 8, rounds: int = 6, links: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: id_col, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: counts of shards differ by one at most. size is the text's UTF-8 bytes (null: none)
    plus 1, text_crc32 the unsigned CRC-32 of them (null: of no bytes, 0). slot numbers a shard's rows from 0
    without gaps, in a scattered order. links (id_col, hub) says what belongs together; by default equal
    texts do, null as empty. grown_shard is null, as this law doesn't use it. The result depends on ids and texts
    alone and not on the table's layout; repeated rows are rows of their own, numbered one after another. Empty
    tables give no rows; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    said = docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", (F.octet_length("t") + 1).cast("bigint").alias("size"), F.crc32(F.encode("t", "UTF-8")).alias("crc"), F.unhex(F.sha2("t", 256)).alias("hub"))
    # Rows that repeat id and text are one with a count; each gets as many numbers as it has rows.
    once = kept_table(said.groupBy("id", "hub").agg(F.min("size").alias("size"), F.min("crc").alias("crc"), F.count("*").alias("many")), "shard-texts")
    placed = ranked(once, [], cell_of("id", "hub"), [cell_of("hub", "id", of=PARTS)], [F.col("hub"), F.col("id")], "first", F.col("many"))
    runs = placed.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("many") - 1) / RUN)))).withColumn("_left", F.least(F.lit(RUN), F.col("many") - F.col("_run") * RUN))
    row = F.explode(F.sequence(F.col("first") + F.col("_run") * RUN, F.col("first") + F.col("_run") * RUN + F.col("_left") - 1))
    rows = kept_table(runs.select("id", "size", "crc", "hub", row.alias("row")), "shard-rows")
    member = rows.select("row", "hub") if links is None else rows.select("row", "id").join(links.select(F.col(id_col).alias("id"), "hub"), "id").select("row", "hub")
    placed = rows.join(label_propagation(rows, member, n_shards, rounds), "row")
    done = ranked(placed, ["shard"], cell_of("row", F.lit(1)), [], [F.col("row")], "slot")
    return done.select(F.col("id").alias(id_col), "size", F.col("crc").cast("bigint").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
