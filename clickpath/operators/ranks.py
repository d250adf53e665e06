"""Distributed ranking of a value column, and exact selection of a few ranks.

``rank_histogram`` collapses the input to one row per distinct value (per
group), then assigns each value the number of rows below it without a global
sort into one partition:

1. the distinct values are cut into ``buckets`` ranges at approximate-quantile
   boundaries (at most ``buckets - 1`` numbers computed once and inlined);
2. a tiny per-(group, bucket) table gives each bucket its offset;
3. a window *inside* each (group, bucket) adds the running count.

Work therefore spreads over groups x buckets even when one group holds most of
the rows. Rank-based statistics (Mann-Whitney, Kruskal-Wallis, Spearman, AUC,
average precision) and quantiles of many groups read this table.

A quantile of a whole column needs two ranks only, and those are selected by counting: a
sketch with a proven rank error bounds each wanted rank from both sides, one pass
counts the rows below and inside each interval, an interval with many rows is
narrowed by a sketch of what is in it, and only the distinct values inside
the last intervals are listed. Nothing is sorted and the column is never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

DEFAULT_BUCKETS = 128
#: Accuracy of the sketches that bound a rank: the rank error is at most rows / ACCURACY.
ACCURACY = 10_000
#: Rows of an interval whose distinct values are listed on the driver; larger ones are narrowed first.
LISTED_ROWS = 50_000


def rank_histogram(
    df: DataFrame,
    value: str,
    by: list[str] | tuple = (),
    counts: dict | None = None,
    buckets: int = DEFAULT_BUCKETS,
    bounds_by: str | None = None,
) -> DataFrame:
    """One row per (by..., value) with, for every count column ``c``:

    ``c`` (rows with this value), ``before_c`` (rows of the group with a smaller
    value) and ``total_c`` (rows of the group). ``counts`` maps names to
    aggregate expressions; default ``{"cnt": count(*)}``. NULL values are dropped.
    ``bounds_by`` (a low-cardinality column of ``by``, e.g. a test id) gives each
    of its values its own bucket cut points.
    """
    by = list(by)
    counts = counts or {"cnt": F.count(F.lit(1))}
    names = list(counts)
    hist = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[e.alias(n) for n, e in counts.items()])

    v = F.col(value).cast("double")
    if bounds_by is None:
        bk = bucket_of(v, value_bounds(hist, value, buckets))
    else:
        per_key = value_bounds_by(hist, value, bounds_by, buckets)
        bk = F.lit(0)
        for key, bounds in per_key.items():
            bk = F.when(F.col(bounds_by) == F.lit(key), bucket_of(v, bounds)).otherwise(bk)
    hist = hist.withColumn("_bk", bk)

    per_bucket = hist.groupBy(*by, "_bk").agg(*[F.sum(n).alias(f"_b_{n}") for n in names])
    w_all = Window.partitionBy(*by) if by else Window.partitionBy()
    w_b = w_all.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select(
        *by,
        "_bk",
        *[F.coalesce(F.sum(f"_b_{n}").over(w_b), F.lit(0)).alias(f"_off_{n}") for n in names],
        *[F.sum(f"_b_{n}").over(w_all).alias(f"total_{n}") for n in names],
    )
    w_in = Window.partitionBy(*by, "_bk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumns({f"_in_{n}": F.coalesce(F.sum(n).over(w_in), F.lit(0)) for n in names})
    out = hist.join(per_bucket, by + ["_bk"], "inner")
    out = out.withColumns({f"before_{n}": F.col(f"_off_{n}") + F.col(f"_in_{n}") for n in names})
    return out.select(*by, value, *names, *[f"before_{n}" for n in names], *[f"total_{n}" for n in names])


def value_bounds(hist: DataFrame, value: str, buckets: int) -> list[float]:
    """Sorted distinct approximate-quantile cut points of ``value`` (at most
    ``buckets - 1`` numbers, so a bounded result reaches the driver)."""
    if buckets <= 1:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    row = hist.select(F.percentile_approx(F.col(value).cast("double"), probs, 4 * buckets).alias("b")).first()
    return sorted({float(x) for x in (row["b"] or []) if x is not None})


def value_bounds_by(hist: DataFrame, value: str, key: str, buckets: int) -> dict:
    """Cut points per value of ``key`` (a handful of keys x ``buckets`` numbers)."""
    if buckets <= 1:
        return {}
    probs = [i / buckets for i in range(1, buckets)]
    rows = hist.groupBy(key).agg(
        F.percentile_approx(F.col(value).cast("double"), probs, 4 * buckets).alias("b")).collect()
    return {r[key]: sorted({float(x) for x in (r["b"] or []) if x is not None}) for r in rows}


def bucket_of(v: F.Column, bounds: list[float]) -> F.Column:
    """Number of cut points <= v, as a balanced CASE tree (log2 comparisons per row)."""
    def tree(lo: int, hi: int) -> F.Column:
        # bucket index lies in [lo, hi]
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2  # v >= bounds[mid - 1] -> index >= mid
        return F.when(v >= F.lit(bounds[mid - 1]), tree(mid, hi)).otherwise(tree(lo, mid - 1))
    return tree(0, len(bounds))


def average_rank(count: str = "cnt") -> F.Column:
    """Mid-rank (1-based) of the tied block: rows below + (ties + 1) / 2."""
    return F.col(f"before_{count}").cast("double") + (F.col(count).cast("double") + 1.0) / 2.0


def _margins(p: float) -> list[float]:
    """Sketch positions that are below and above the ranks next to ``p``, whatever the sketch's error."""
    return [max(0.0, p - 3 / ACCURACY), min(1.0, p + 3 / ACCURACY)]


def _finite(c: F.Column) -> F.Column:
    return F.when(~F.isnan(c), c)


def _middle(low: float, high: float) -> float:
    """A number from ``low`` to below ``high``."""
    if math.isinf(low):
        return low
    return math.nextafter(math.inf, 0) if math.isinf(high) else min(low / 2 + high / 2, math.nextafter(high, low)) if low / 2 + high / 2 >= low else low


def select_ranks(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[tuple[float, float, float]] | None]:
    """The two values next to each wanted position of several columns, exactly.

    For ``p`` of a column with n values the position is h = (n - 1) * p; the result is
    (value at floor(h), value at ceil(h), h). Ranks start at 0; NaN is larger than any number and
    null is no value. ``None`` marks a column without a value.

    Each round is one aggregate of ``df`` with a fixed-width buffer a number (counts) or a sketch; the
    driver sees those numbers and at the end the distinct values of the last intervals, at
    most ``LISTED_ROWS`` each.
    """
    cols = list(wanted)
    if not cols:
        return {}
    # the numbers of each column, computed once a row however often the aggregates below read them
    df = df.select(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    df = df.select("*", *[_finite(F.col(f"_v{i}")).alias(f"_x{i}") for i in range(len(cols))])
    x = {c: F.col(f"_x{i}") for i, c in enumerate(cols)}
    first = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(f"_v{i}").alias(f"n{i}"), F.count(x[c]).alias(f"m{i}"), F.min(x[c]).alias(f"lo{i}"), F.max(x[c]).alias(f"hi{i}"),
        F.percentile_approx(x[c], [q for p in wanted[c] for q in _margins(p)], ACCURACY).alias(f"q{i}"))]).first()

    spans: dict[tuple, list] = {}  # (column, rank) -> interval that holds it
    ends: dict[str, tuple] = {}
    places: dict[str, list] = {}
    for i, c in enumerate(cols):
        n, m = first[f"n{i}"], first[f"m{i}"]
        ends[c] = (first[f"lo{i}"], first[f"hi{i}"])
        places[c] = [(math.floor((n - 1) * p), math.ceil((n - 1) * p), (n - 1) * p) for p in wanted[c]] if n else []
        for k, (lo, hi, _) in enumerate(places[c]):
            known = first[f"q{i}"][2 * k:2 * k + 2] if m > ACCURACY else ends[c]
            spans.update({(c, rank): list(known) for rank in (lo, hi) if rank < m})
    found: dict[tuple, float] = {}
    while spans:
        keys = list(spans)
        counts = df.agg(*[e for k, (c, _) in enumerate(keys) for e in (
            F.count_if(x[c] < F.lit(spans[keys[k]][0])).alias(f"b{k}"), F.count_if(x[c] <= F.lit(spans[keys[k]][1])).alias(f"u{k}"))]).first()
        listed, narrowed = [], []
        for k, key in enumerate(keys):
            below, inside = counts[f"b{k}"], counts[f"u{k}"] - counts[f"b{k}"]
            if not below <= key[1] < below + inside:
                spans[key] = list(ends[key[0]])  # cannot happen within the sketch's error; start from the whole column
            elif spans[key][0] == spans[key][1]:
                found[key] = spans.pop(key)[0]
            else:
                (listed if inside <= LISTED_ROWS else narrowed).append((k, key, below, inside))
        if narrowed:
            # by a sketch of what is inside, and in the middle, where ties at both ends leave the sketch no choice
            middle = {k: _middle(*spans[key]) for k, key, _, _ in narrowed}
            row = df.agg(*[e for k, key, below, inside in narrowed for e in (
                F.percentile_approx(F.when(x[key[0]].between(F.lit(spans[key][0]), F.lit(spans[key][1])), x[key[0]]),
                                    _margins((key[1] - below + 0.5) / inside), ACCURACY).alias(f"q{k}"),
                F.count_if(x[key[0]] <= F.lit(middle[k])).alias(f"h{k}"))]).first()
            for k, key, _, _ in narrowed:
                half = (spans[key][0], middle[k]) if key[1] < row[f"h{k}"] else (math.nextafter(middle[k], math.inf), spans[key][1])
                spans[key] = [max(half[0], row[f"q{k}"][0]), min(half[1], row[f"q{k}"][1])]
        if listed:
            # of each row only the values inside an interval are passed on, and counted before the shuffle
            inside = F.array(*[F.when(x[key[0]].between(F.lit(spans[key][0]), F.lit(spans[key][1])),
                                      F.struct(F.lit(k).alias("k"), x[key[0]].alias("v"))) for k, key, _, _ in listed])
            rows = (df.select(F.explode(F.filter(inside, lambda e: e.isNotNull())).alias("e")).groupBy("e.k", "e.v")
                    .agg(F.count(F.lit(1)).alias("n")).collect())
            values: dict[int, list] = {}
            for r in rows:
                values.setdefault(r["k"], []).append((r["v"], r["n"]))
            for k, key, below, _ in listed:
                at = below
                for v, n in sorted(values[k]):
                    if at <= key[1] < at + n:
                        found[key] = v
                    at += n
                spans.pop(key)
    nan = float("nan")
    return {c: [(found.get((c, lo), nan), found.get((c, hi), nan), h) for lo, hi, h in places[c]] or None for c in cols}


def between_ranks(low: float, high: float, h: float) -> float:
    """Linear interpolation at position ``h`` between the values of its two ranks."""
    lo, hi = math.floor(h), math.ceil(h)
    return low if lo == hi else (hi - h) * low + (h - lo) * high


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float] | None]:
    """Exact global quantiles (numpy 'linear' rule) of several columns by selection. ``None`` marks
    a column with no non-null value."""
    return {c: v and [between_ranks(*t) for t in v] for c, v in select_ranks(df, {c: list(probs) for c in cols}).items()}


def quantile_columns(ranked: DataFrame, value: str, probs: list[float], by: list[str] | tuple = (), count: str = "cnt",
                     prefix: str = "q") -> DataFrame:
    """Exact linear-interpolation quantiles per group from a rank histogram.

    Position ``h = (n - 1) * p``; the values at ranks ``floor(h)`` and
    ``ceil(h)`` are picked out by a conditional aggregate, then interpolated.
    Returns one row per group with columns ``{prefix}0, {prefix}1, ...``.
    """
    by = list(by)
    total = F.col(f"total_{count}").cast("double")
    before = F.col(f"before_{count}")
    n = F.col(count)
    aggs = []
    for i, p in enumerate(probs):
        pos = (total - 1) * p
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [
            F.max(F.when((before <= lo) & (lo < before + n), F.col(value).cast("double"))).alias(f"_lo{i}"),
            F.max(F.when((before <= hi) & (hi < before + n), F.col(value).cast("double"))).alias(f"_hi{i}"),
            F.max(pos).alias(f"_pos{i}"),
        ]
    out = ranked.groupBy(*by).agg(*aggs)
    cols = []
    for i in range(len(probs)):
        lo_v, hi_v, pos = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_pos{i}")
        lo_i, hi_i = F.floor(pos), F.ceil(pos)
        interp = F.when(lo_i == hi_i, lo_v).otherwise((hi_i - pos) * lo_v + (pos - lo_i) * hi_v)
        cols.append(interp.alias(f"{prefix}{i}"))
    return out.select(*by, *cols)


def grouped_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str], prefix: str = "q") -> DataFrame:
    """Exact per-group quantiles without buffering a group's values in one task."""
    return quantile_columns(rank_histogram(df, value, by), value, probs, by, prefix=prefix)
