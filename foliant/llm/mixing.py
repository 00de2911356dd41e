"""Mixing sources to target weights by systematic sampling (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.storage import cut, row_key, rows_of

#: Words [^\x20\x09-\x0D]+ of a text.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most so many times its own size.
MOST = 3


def n_words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> source, source_size, target (double).

    Targets share the sum of all sizes by weight. One above most times its
    source's size stops there, and the excess is shared anew by weight among
    the others until none is above. Sources stop in the order of size to
    weight, so one pass over that order finds the level at which the last one
    stops: that of the first source whose stop is not below what those from it
    on would share by weight.
    """
    ranked = cut(_placed(totals, [F.col("source").asc_nulls_last()]), "sources")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = ranked.select("source", "source_size", w.alias("weight"), (F.col("source_size") * most).alias("cap"))
    total, all_weight = (x or 0 for x in table.agg(F.sum("source_size"), F.sum("weight")).first())
    order = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    stops = cut(_placed(table, order, ["cap", "weight"]), "stops")
    share = (F.lit(float(total)) - F.col("cap_before")) / (F.lit(float(all_weight)) - F.col("weight_before"))
    level = stops.where(F.col("cap") >= share * F.col("weight")).agg(F.min_by(share, "place")).first()[0]
    target = F.col("cap").cast("double") if level is None else F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def _placed(rows: DataFrame, order: list[Column], sums: list[str] | None = None) -> DataFrame:
    """rows with place long, theirs in the order, from 0, and <x>_before, the sum of x over the rows before, for each of sums; no task sees all rows."""
    s = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("_at", 33)
    w = Window.orderBy("_part")  # a row for each partition
    parts = s.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), *(F.sum(x).alias(f"_sum_{x}") for x in sums or []))
    parts = parts.select("_part", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), *((F.sum(f"_sum_{x}").over(w) - F.col(f"_sum_{x}")).alias(f"_before_{x}") for x in sums or []))
    out = s.withColumn("_part", part).join(parts, "_part").withColumn("place", F.col("_before") + F.col("_at") - F.shiftleft("_part", 33))
    within = Window.partitionBy("_part").orderBy("_at")  # a partition's rows, as many as the sort gave it
    out = out.withColumns({f"{x}_before": F.col(f"_before_{x}") + F.sum(x).over(within) - F.col(x) for x in sums or []})
    return out.drop("_part", "_at", "_before", *(f"_before_{x}" for x in sums or []))


def mix(
    docs: DataFrame, size: str, doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: str = "0"
) -> DataFrame:
    """Add source_size long, target double and copies long: how often the mix takes each row.

    Expected copies are target / source_size for each row of a source. Rows of
    a source stand in the order of size (longest first, by binary magnitude
    and its next two bits, so that a sample of each length is taken), then of
    the md5 of the id; the running sum of expected copies starts at one random
    offset from the seed and the source, and a row is taken once for each
    integer that the sum crosses. No row is taken more than most times.

    The order is global, by range partitioning on (source, order), so a hot
    source spreads over many tasks; only counts per source and partition are
    summed across them. Equal rows are interchangeable. Null sizes count as 0,
    null ids stand at the end, the null source is one source. Columns of the
    added names are replaced.
    """
    bits = F.bin(F.col("_size"))
    order = [F.col("_src").asc_nulls_last(), F.col("_class").desc(), F.col("_key").asc_nulls_last(), F.col("_id").asc_nulls_last()]
    kept = [x for x in docs.columns if x not in ("source_size", "target", "copies")]
    # as one column, so that no name of docs can clash with those used here
    row = F.struct(*(F.col(f"`{x}`") for x in kept)).alias("row")
    d = docs.select(row, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"), F.col(source).alias("_src"), F.col(doc_id).alias("_id"))
    d = d.withColumns({"_class": F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 3)), "_key": F.md5(F.col("_id").cast("string"))})
    d = cut(d.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    runs = cut(d.groupBy("_src", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"), F.sum("_size").alias("_sum")), "runs")
    before = runs.select("_src", "_part", (F.sum("_n").over(Window.partitionBy("_src").orderBy("_part")) - F.col("_n") - F.col("_from")).alias("_before"))
    sizes = runs.groupBy(F.col("_src").alias("source")).agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(sizes, weights, most).withColumnRenamed("source", "_t")
    before = cut(before.join(targets, F.col("_src").eqNullSafe(F.col("_t"))).select(F.col("_src").alias("_b"), F.col("_part").alias("_p"), "_before", "source_size", "target"), "offsets")
    d = d.join(before, F.col("_src").eqNullSafe(F.col("_b")) & (part == F.col("_p")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("_src"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rank = F.col("_at") + F.col("_before")
    copies = F.floor((rank + 1) * rate + start) - F.floor(rank * rate + start)
    return d.select("row.*", "source_size", "target", copies.cast("long").alias("copies"))


def mixed_rows(docs: DataFrame, size: Column, source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: str = "0") -> DataFrame:
    """The rows of the mix of docs, each as often as it is taken.

    Only keys, sizes and sources are ordered; the texts are read again where
    their keys are known. Rows are told apart by all their values, and ordered
    as mix() does by their keys.
    """
    rows = docs.select(*row_key(docs), size.alias("size"), F.col(source).alias("source"))
    found = mix(rows.withColumn("key", F.concat_ws(":", "_a", "_b")), "size", "key", "source", weights, most, seed)
    wanted = cut(found.groupBy("_a", "_b").agg(F.count("*").alias("rows"), F.sum("copies").alias("copies")), "taken")
    return rows_of(docs, wanted)


def take(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """The rows of the mix: each row as often as copies says, without that column."""
    again = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias("_copy")
    return mixed.where(F.col(copies) > 0).select("*", again).drop("_copy", copies)
