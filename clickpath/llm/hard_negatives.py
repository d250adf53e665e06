"""Operator 13: hard negatives of anchors, by slots between the positives' upper limits.

Vectors become integers, floor(SCALE * x); a score is an integer inner product with the anchor. An anchor's positives are
its best rows of the same label. Each positive opens a window of scores for rows of other labels, from LOWER to UPPER hundredths of
its own score. Windows overlap, so they aren't searched one by one: the positives' upper limits, in descending order, cut
the scores into disjoint slots, and one pass over the candidates keeps the best ``k`` of each slot. A window begins at
the top of its slot and runs down through the following ones, so its best k rows are the first k of that suffix of slots, and those
of them that reach its lower limit are its answer.

Anchors and candidates meet in blocks: candidates are dealt to cells and anchors to groups by a hash, and each (cell, group)
pair is one task of bounded size, in which a block of scores is one matrix product and a partition selection keeps each
slot's best. Cells' slots are merged by a per-task top k and a window of bounded groups: at most k rows a cell, however
many rows share a label. Two passes: same labels for the positives, then other labels for the slots.

Defined cases: rows without an id or a label, null vectors and vectors with a null or non-finite component take no part; a row
that repeats an anchor's id is neither its positive nor its negative; repeated rows are one anchor and each a candidate; ties go to
the smaller id; positives with equal scores share a slot, each with its own rows of the result; a positive whose window is empty
(such as one with a score below 0) has no row, nor has an anchor without positives; vectors of other lengths count as
padded with zeros; empty vectors score 0; an empty table gives an empty result; other columns are not read. Ids and labels are integers.
Scores are exact while they stay below 2^63 (products of floats are used below 2^53 only).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clickpath.llm.common import keep

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A window's limits, in hundredths of the positive's score.
LOWER, UPPER = 30, 90
#: Rows a cell and anchors a group, on average, and scores computed at once.
CELL = 4096
GROUP = 16384
BLOCK_SCORES = 1 << 21


def taking_part(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, e: array<long>) of the rows that take part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                    F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("e")))


def hundredths(x: Column) -> Column:
    """floor(x / 100) of an integer."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, shorter ones padded with zeros."""
    lists = lists.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy()
    return out


def longest(lists: pa.ChunkedArray) -> int:
    return int(np.diff(lists.combine_chunks().offsets.to_numpy()).max(initial=0))


def scores_of(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, by float products where none can be rounded."""
    most = np.abs(anchors).max(initial=0).astype(float) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if most < 2 ** 53:
        return (anchors.astype(float) @ rows.T.astype(float)).astype(np.int64)
    return anchors @ rows.T


def first_places(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    some = np.arange(len(scores))
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def meet(rows: DataFrame, anchors: DataFrame, pick, names: list[str]) -> DataFrame:
    """What ``pick(anchors table, e, candidates table, e, scores)`` yields (columns of integers) of each block of anchors and
    candidates; every anchor meets every row once."""
    cells = max(1, -(-rows.count() // CELL))
    groups = max(1, -(-anchors.count() // GROUP))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64(F.lit(1), "id", "e"), F.lit(cells)).cast("int")).withColumn("grp", spread(groups))
    asked = anchors.withColumn("grp", F.pmod(F.xxhash64(F.lit(2), "q"), F.lit(groups)).cast("int")).withColumn("cell", spread(cells))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((0, len(names)), np.int64)]
        if left.num_rows and right.num_rows:
            width = max(longest(left.column("e")), longest(right.column("e")))
            e, q = matrix(left.column("e"), width), matrix(right.column("e"), width)
            step = max(1, BLOCK_SCORES // len(e))
            for at in range(0, len(q), step):
                out += pick(left, right.slice(at, step), scores_of(q[at:at + step], e))
        found = np.concatenate(out)
        return pa.table([pa.array(found[:, c].copy()) for c in range(len(names))], names=names)

    schema = StructType([StructField(c, LongType()) for c in names])
    return dealt.groupBy("cell", "grp").cogroup(asked.groupBy("cell", "grp")).applyInArrow(score, schema)


def positives(rows: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(q, id, score): the k best other rows of the same label of each anchor (q, id, label, e)."""

    def pick(left: pa.Table, right: pa.Table, scores: np.ndarray) -> list[np.ndarray]:
        ids, labels, out = left.column("id").to_numpy(), left.column("label").to_numpy(), []
        asked = zip(right.column("q").to_numpy(), right.column("id").to_numpy(), right.column("label").to_numpy(), scores)
        for q, own, label, row in asked:
            same = np.flatnonzero((labels == label) & (ids != own))
            top = same[first_places(row[same], ids[same], k)]
            out.append(np.column_stack([np.full(len(top), q), ids[top], row[top]]))
        return out

    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return meet(rows, anchors, pick, ["q", "id", "score"]).withColumn("_first", first).where(F.col("_first") <= k).drop("_first")


def slots(rows: DataFrame, anchors: DataFrame, k: int = NEGATIVES) -> DataFrame:
    """(q, slot, id, score): the k best rows of other labels in each slot of each anchor (q, id, label, e, uppers, lower). Slot i
    holds the scores up to uppers[i] and above uppers[i + 1]; the last one goes down to ``lower``."""

    def pick(left: pa.Table, right: pa.Table, scores: np.ndarray) -> list[np.ndarray]:
        ids, labels, out = left.column("id").to_numpy(), left.column("label").to_numpy(), []
        asked = zip(right.column("q").to_numpy(), right.column("id").to_numpy(), right.column("label").to_numpy(),
                    right.column("uppers").to_pylist(), right.column("lower").to_numpy(), scores)
        for q, own, label, uppers, lower, row in asked:
            some = np.flatnonzero((row <= uppers[0]) & (row >= lower) & (labels != label) & (ids != own))
            slot = len(uppers) - np.searchsorted(np.array(uppers[::-1]), row[some], side="left") - 1
            for number in np.unique(slot).tolist():
                here = some[slot == number]
                top = here[first_places(row[here], ids[here], k)]
                out.append(np.column_stack([np.full(len(top), q), np.full(len(top), number), ids[top], row[top]]))
        return out

    first = F.row_number().over(Window.partitionBy("q", "slot").orderBy(F.desc("score"), "id"))
    return meet(rows, anchors, pick, ["q", "slot", "id", "score"]).withColumn("_first", first).where(F.col("_first") <= k).drop("_first")


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   n_positives: int = POSITIVES, k: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every row that ``is_anchor`` holds
    for and each of its positives, the first k rows of other labels inside the positive's window."""
    rows = keep(taking_part(vectors, id_col, vector_col, label, scale), "vectors")
    anchors = keep(taking_part(vectors.where(is_anchor), id_col, vector_col, label, scale).distinct()
                   .withColumn("q", F.xxhash64("id", "label", "e")), "anchors")
    near = keep(positives(rows, anchors, n_positives)
                .withColumns({"upper": hundredths(F.col("score") * upper), "lower": -hundredths(-F.col("score") * lower)})
                .where("lower <= upper"), "positives")
    # at most n_positives rows an anchor
    limits = near.groupBy("q").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("uppers"), F.min("lower").alias("lower"))
    asked = keep(anchors.join(limits, "q"), "limits")
    entry = F.struct("slot", (-F.col("score")).alias("below"), "id")
    # at most n_positives slots of k rows, in descending order of scores
    found = slots(rows, asked, k).groupBy("q").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    suffix = F.slice(F.filter("entries", lambda x: -x["below"] <= F.col("upper")), 1, k)
    inside = F.filter(suffix, lambda x: -x["below"] >= F.col("lower"))
    windows = (near.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}).join(found, "q")
               .join(anchors.select("q", F.col("id").alias("anchor_id")), "q"))
    return (windows.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "x"))
            .select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"),
                    "positive_score", (-F.col("x.below")).alias("negative_score")))
