"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

A source whose target is f times its size gives floor(f) complete epochs; the rest of its target is a weighted
sample without replacement. Every document draws the exponential key -ln(u) / weight, u from its id and the
seed; documents are taken in the order of their keys until their sizes add up to the rest. The order is never
built over a whole source: the logarithms of keys fall into bins of one width, as fine for small weights as for
large ones, sums of bins find the bin in which the budget ends, finer bins within that one the place, and only
what shares the last bin is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_struct, kept_table

#: Weights dealt to the sources in order, again and again.
CYCLE = (5.0, 2.0, 1.0)
#: Bins for each factor of e between keys, and fine bins in each of these. Powers of two, so that bins follow the order of keys.
COARSE, FINE = 32, 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """0.25 to 1: the share of letters and blanks among the first-hand signs of prose; null and empty texts have 0.25."""
    n = F.char_length(text)
    kept = F.char_length(F.translate(text, "0123456789#$%&*|<>{}[]()!?_=+~^/\\@", ""))
    return F.coalesce(F.lit(0.25) + F.lit(0.75) * kept / F.nullif(n, F.lit(0)), F.lit(0.25))


def uniform(id_col: Column, seed: int) -> Column:
    """In (0, 1), from the id's decimal text and the seed: 52 bits of an MD5 digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """Adds for each of sums what the rows before this one add up to, in an order without ties, and `_all_<sum>`, the whole.

    Rows are dealt to ranges of the order; a window holds one range, and one more the sums of the ranges.
    """
    part = kept_table(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumns({f"_of_{k}": c for k, c in sums.items()}), name)
    parts = part.groupBy("_part").agg(*(F.sum(f"_of_{k}").alias(f"_in_{k}") for k in sums))
    up_to = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("_part").alias("_at"), *(F.coalesce(F.sum(f"_in_{k}").over(up_to), F.lit(0)).alias(f"_to_{k}") for k in sums), *(F.sum(f"_in_{k}").over(W.partitionBy()).alias(f"_all_{k}") for k in sums))
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    met = part.join(parts, F.col("_part") == F.col("_at")).withColumns({k: F.col(f"_to_{k}") + F.coalesce(F.sum(f"_of_{k}").over(within), F.lit(0)) for k in sums})
    return met.select(*df.columns, *sums, *(f"_all_{k}" for k in sums))


def source_targets(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source.

    Sources in code point order, null last, weigh as cycle says and share `share` times all sizes; no target
    is over `most` times its source, and what is over goes to the others by weight until none is above. Such
    sharing ends at one level: target = min(most * size, level * weight). In the order of the levels at which
    sources are full, running sums show the first source that isn't. No window holds all sources.
    """
    weights = F.array(*(F.lit(float(x)) for x in cycle))
    placed = running(sizes.select("source", "source_size"), [F.asc_nulls_last("source")], {"rank": F.lit(1).cast("bigint")}, "sources")
    weighed = placed.select("source", "source_size", F.element_at(weights, (F.col("rank") % len(cycle) + 1).cast("int")).alias("weight"))
    weighed = weighed.withColumn("full_at", F.lit(most) * F.col("source_size") / F.col("weight"))
    sums = {"used": F.lit(most) * F.col("source_size"), "above": F.col("weight"), "whole": F.col("source_size").cast("double")}
    filled = running(weighed, [F.col("full_at").asc(), F.asc_nulls_last("source")], sums, "levels")
    filled = filled.withColumn("level", (F.lit(share) * F.col("_all_whole") - F.col("used")) / (F.col("_all_above") - F.col("above")))
    level = filled.agg(F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level")))).scalar()
    full = F.lit(most) * F.col("source_size")
    return filled.select("source", "source_size", F.least(full, F.coalesce(level * F.col("weight"), full)).cast("double").alias("target"))


def mix_sources(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weight: Column | None = None, seed: int = 7, cycle: tuple[float, ...] = CYCLE, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each row of docs: id_col, size, source, source_size, target, epochs, check (a hash of the text), taken.

    size is the number of words (null text: 0). taken is size times epochs, epochs being the complete epochs
    of the source plus one for sampled documents. The document at which the rest of the target is reached is
    taken if that brings the source nearer to its target. Null source is a source of its own. Documents of
    size 0 are part of each epoch and never sampled past the budget. Repeated ids draw one key, null ids one for
    each text; ties in keys go by id, then by row. weight is a positive column (null, zero and negative: 1e-6),
    quality_weight(text) if None. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    w = weight if weight is not None else quality_weight(F.col(text_col))
    base = kept_table(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("check"), word_count(F.col(text_col)).alias("size"), F.greatest(F.coalesce(w.cast("double"), F.lit(1e-6)), F.lit(1e-6)).alias("w"), uniform(named, seed).alias("u"))
        .select("id", "source", "size", "check", (-F.log("u") / F.col("w")).alias("key"), F.monotonically_increasing_id().alias("row")),
        "mix",
    )
    # Scaling by a power of two and taking off the whole part are exact, so bins never contradict the order of keys.
    place = F.log("key") * COARSE
    base = base.withColumn("bin", F.floor(place).cast("int")).withColumn("fine", F.floor((place - F.floor(place)) * FINE).cast("int"))
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, share, most)
    size = F.nullif(F.col("source_size"), F.lit(0))
    targets = targets.withColumn("complete", F.coalesce(F.floor(F.col("target") / size), F.lit(0)).cast("bigint"))
    targets = kept_table(targets.withColumn("budget", F.col("target") - F.col("complete") * F.col("source_size")), "targets")

    def ends(sums: DataFrame, by: str, goals: DataFrame) -> DataFrame:
        """(_s, edge, before): for each source the first bin at whose end the running sum reaches the budget, and the sum before it.

        sums has a row for each bin that occurs in a source, some 2000 at most; goals has _s, budget and start, the sum before the first bin.
        """
        met = sums.join(goals, F.col("source").eqNullSafe(F.col("_s")))
        met = met.withColumn("upto", F.col("start") + F.sum("s").over(W.partitionBy("source").orderBy(by)))
        over = met.filter(F.col("upto") >= F.col("budget"))
        return over.groupBy("source").agg(F.min_by(F.struct(F.col(by).alias("edge"), (F.col("upto") - F.col("s")).alias("before")), by).alias("x")).select(F.col("source").alias("_s"), "x.*")

    goals = targets.select(F.col("source").alias("_s"), "budget", F.lit(0).cast("bigint").alias("start"))
    first = kept_table(ends(base.groupBy("source", "bin").agg(F.sum("size").alias("s")), "bin", goals).join(targets.select(F.col("source").alias("_t"), "budget"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t"), "first-edges")
    inner = base.join(first.select(F.col("_s").alias("_f"), "edge"), F.col("source").eqNullSafe(F.col("_f")) & (F.col("bin") == F.col("edge")))
    second = ends(inner.groupBy("source", "fine").agg(F.sum("size").alias("s")), "fine", first.select("_s", "budget", F.col("before").alias("start")))
    edge = kept_table(first.select("_s", F.col("edge").alias("edge_bin")).join(second.select(F.col("_s").alias("_f"), F.col("edge").alias("edge_fine"), "before"), F.col("_s").eqNullSafe(F.col("_f"))).drop("_f"), "edges")
    marked = base.join(targets.withColumnRenamed("source", "_t"), F.col("source").eqNullSafe(F.col("_t"))).drop("_t").join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    here = (F.col("bin") == F.col("edge_bin")) & (F.col("fine") == F.col("edge_fine"))
    at_edge = marked.filter(here)
    order = W.partitionBy("source").orderBy("key", "id", "row")
    picked = (
        at_edge.withColumn("upto", F.col("before") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("sampled", (F.col("upto") <= F.col("budget")) | (F.lit(2) * F.col("budget") > F.lit(2) * F.col("upto") - F.col("size")))
        .drop("upto")
    )
    below = (F.col("bin") < F.col("edge_bin")) | ((F.col("bin") == F.col("edge_bin")) & (F.col("fine") < F.col("edge_fine")))
    clear = marked.filter(~F.coalesce(here, F.lit(False))).withColumn("sampled", F.coalesce(below, F.col("budget") > 0))
    done = clear.unionByName(picked).withColumn("epochs", F.col("complete") + F.col("sampled").cast("bigint"))
    return done.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "epochs", "check", (F.col("size") * F.col("epochs")).alias("taken"))


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs as often as mix_sources takes them, with all their columns. Repeated rows of one id and text are taken as often as the one taken most."""
    mixed = mix_sources(docs, text_col, id_col, source_col, **options)
    want = kept_table(mixed.filter("epochs > 0").groupBy(F.col(id_col).alias("__id"), F.col("check").alias("__check")).agg(F.max("epochs").cast("int").alias("__epochs")), "epochs")
    met = F.col("id").eqNullSafe(F.col("__id")) & (F.col("check") == F.col("__check"))
    rows = docs.select(as_struct(docs).alias("whole"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("check"))
    return rows.join(want.hint("merge"), met).select("whole", F.explode(F.sequence(F.lit(1), F.col("__epochs")))).select("whole.*")
