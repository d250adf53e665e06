"""Operator 10: mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words. Sources get weights and share a budget of words; a target never exceeds
``MOST_PASSES`` times its source, and the excess is shared again by weight. Each source's
documents are dealt to shards of about ``SHARD_WORDS`` words by a seeded hash, and each
shard is cut into equal blocks of about ``BLOCK_WORDS`` words. The number of blocks that a
source gets, and then each of its shards, goes by highest quotients (votes / 1, 3, 5, ...),
no shard above MOST_PASSES times its blocks. In a shard the documents stand in a seeded random
order; it is passed through as often as its quota has whole passes, and the remaining
blocks run on from a seeded one. So what is taken of a document is plain arithmetic on its
place, no table of blocks is made, and most documents are taken whole or not at all.

Only DataFrame functions are used. The groups that windows work on are bounded: a shard's
documents, and the rows of one source's shards; source ranks use range partitions.

Defined cases: null texts have size 0 and nothing is taken of them; a null source is a source
of its own, last in order; repeated rows each count and each get a row; null ids are dealt
like any other; with no words at all every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickpath.llm.common import global_rank, keep

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 64
SHARD_WORDS = 4_000_000
SHARD_DOCS = 100_000
SEED = 20


def words_in(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """(source, source_size, docs, target) of a table (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = global_rank(sources, "_rank", F.asc_nulls_last("source"))
    turn = F.pmod(F.col("_rank") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    ranked = keep(ranked.select("source", "source_size", "docs", weight.alias("weight"),
                                (F.lit(float(MOST_PASSES)) * F.col("source_size")).alias("most")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    # words per unit of weight: grows as sources reach their most, until no other one does
    unit = 0.0
    while total:
        full = F.col("weight") * F.lit(unit) >= F.col("most")
        done, left = ranked.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        step = (budget * total - (done or 0.0)) / left if left else unit
        if step <= unit:
            break
        unit = step
    return ranked.select("source", "source_size", "docs",
                         F.least(F.col("most"), F.col("weight") * F.lit(unit)).alias("target"))


def apportion(items: DataFrame, group: list[str], item: str) -> DataFrame:
    """``items`` (with ``ideal`` seats and the ``most`` an item may get) with the integer ``quota`` of each by highest
    quotients within its group; a group's seats are its ideal ones, rounded.

    With n items and H seats, the divisor that fits lies within n / 2H of the one that gives the ideal seats.
    Seats below that range are won and seats above are lost in any case; only those between are ranked.
    """
    whole = Window.partitionBy(*group)
    room = F.count("*").over(whole) / (2 * F.greatest(F.col("_seats"), F.lit(1.0)))
    rows = items.withColumn("_seats", F.round(F.sum("ideal").over(whole))).withColumn("_room", room)
    won = F.floor(F.col("ideal") * F.greatest(F.lit(0.0), 1 - F.col("_room")) + 0.5)
    rows = rows.withColumn("_won", F.least(F.col("most"), won).cast("long"))
    may = F.greatest(F.floor(F.col("ideal") * (1 + F.col("_room")) + 0.5), F.col("_won") + 1)
    rows = rows.withColumn("_may", F.least(F.col("most"), F.when(F.col("ideal") > 0, may).otherwise(0)).cast("long"))
    rows = rows.withColumn("_open", F.col("_seats") - F.sum("_won").over(whole))
    seats = F.when(F.col("_may") > F.col("_won"), F.sequence(F.col("_won") + 1, F.col("_may")))
    ranked = (rows.select(*group, item, "ideal", "_open", F.explode(seats).alias("_seat"))
              .withColumn("_place", F.row_number().over(
                  Window.partitionBy(*group).orderBy(F.desc(F.col("ideal") / (2 * F.col("_seat") - 1)), "_seat", item))))
    extra = (ranked.where(F.col("_place") <= F.col("_open")).groupBy(*group, item).agg(F.count("*").alias("_extra"))
             .select(*(F.col(c).alias(f"_g_{c}") for c in [*group, item]), "_extra"))
    same = F.lit(True)
    for c in [*group, item]:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return (rows.join(extra, same, "left").withColumn("quota", F.col("_won") + F.coalesce("_extra", F.lit(0)))
            .drop("_seats", "_room", "_won", "_may", "_open", "_extra", *(f"_g_{c}" for c in [*group, item])))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        carry: bool = False, seed: int = SEED) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every row, and with ``carry`` the whole input row
    as a struct ``row``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       words_in(F.col(text_col)).alias("size"), *([F.struct(*(F.col(c) for c in docs.columns)).alias("row")] if carry else []))
    thin = keep(rows.select("id", "source", "size"), "sizes")
    rows = rows if carry else thin
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("docs") / SHARD_DOCS)).cast("long")
    sources = keep(targets(thin).withColumn("shards", shards), "targets")
    named = sources.select(F.col("source").alias("_source"), "source_size", "target", "shards")
    known = F.col("source").eqNullSafe(F.col("_source"))
    shard = F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("shards"))

    sized = (thin.join(named, known).groupBy("source", shard.alias("shard"))
             .agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")))
    cut = sized.where(F.col("words") > 0).withColumn("blocks", F.greatest(F.lit(1.0), F.round(F.col("words") / BLOCK_WORDS)).cast("long"))
    # blocks of a source by highest quotients among sources, then of its shards among those
    by_source = cut.groupBy("source").agg(F.sum("blocks").alias("all_blocks"), F.first("source_size").alias("w"), F.first("target").alias("t"))
    by_source = by_source.select("source", F.lit(0).alias("all"), "all_blocks", (F.col("t") * F.col("all_blocks") / F.col("w")).alias("ideal"),
                                 (F.lit(MOST_PASSES) * F.col("all_blocks")).alias("most"))
    won = apportion(by_source, ["all"], "source").select(F.col("source").alias("_source"), "all_blocks", F.col("quota").alias("won"))
    quotas = keep(apportion(
        cut.join(won, known).select("source", "shard", "words", "blocks", (F.col("won") * F.col("blocks") / F.col("all_blocks")).alias("ideal"),
                                    (F.lit(MOST_PASSES) * F.col("blocks")).alias("most")),
        ["source"], "shard").select(F.col("source").alias("_s"), F.col("shard").alias("_shard"), "words", "blocks", "quota"), "quotas")

    at = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id", "size")
    placed = (rows.join(named, known).withColumn("shard", shard)
              .withColumn("end", F.sum("size").over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .withColumn("begin", F.col("end") - F.col("size")))
    placed = placed.join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_shard")), "left")
    passes = F.floor(F.col("quota") / F.col("blocks"))
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("blocks"))
    place = lambda block: F.floor(block * F.col("words") / F.col("blocks"))
    placed = placed.withColumns({"_passes": passes, "_first": first}).withColumn("_last", F.col("_first") + F.pmod("quota", "blocks"))
    # the run of blocks, and what of it lies beyond the shard's end goes on at its beginning
    over = lambda a, b: F.greatest(F.lit(0), F.least("end", b) - F.greatest("begin", a))
    blocks = F.col("blocks")
    taken = (F.col("_passes") * F.col("size") + over(place(F.col("_first")), place(F.least("_last", blocks)))
             + F.when(F.col("_last") > blocks, over(F.lit(0), place(F.col("_last") - blocks))).otherwise(0))
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                         F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), *(["row"] if carry else []))
