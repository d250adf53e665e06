"""Operator 3: homomorphic multiset fingerprints of documents, as built-in expressions only.

A text is the multiset of its paragraphs (lines, cut after sentence ends). Each paragraph
hashes to a wide vector; a fingerprint is the sum of these vectors, each lane modulo a
power of two:

* one lane that counts paragraphs, modulo 2^32,
* 4 lanes of 32-bit hashes modulo 2^32: with the rest they tell multisets apart,
* 128 lanes of one hash bit modulo 2^14, four to a long: read as +1 / -1 they are a random
  projection of the multiset, from which the likeness of two multisets is estimated.

Sums don't depend on the order of paragraphs, and ``insert`` and ``delete`` change a
fingerprint without the rest of the text. Everything is computed inside a row.

Defined cases: null and empty texts are the multiset of one empty paragraph; any length
works, as all lanes wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickpath.llm.common import in_order, keep, text_of

#: Fixed: where paragraphs part.
SEPARATOR = r"\n+|(?<=[.!?])[ \t]+"
WORD_LANES = 4
BIT_HASHES = 2
_WORD = 0xFFFFFFFF
_ONES = 0x0001000100010001
_LANES = 0x3FFF3FFF3FFF3FFF
BIT_LONGS = 16 * BIT_HASHES
#: Lanes in the order of the fingerprint: count, words, bits.
MASKS = [_WORD] * (1 + WORD_LANES) + [_LANES] * BIT_LONGS


def _total(values: Column, part, mask: int) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, h: (a + part(h)).bitwiseAND(F.lit(mask)))


def _hash(values: Column, k: int) -> Column:
    """Each paragraph's k-th hash, by a seed of its own."""
    return F.transform(values, lambda p: F.xxhash64(F.lit(k), p))


def with_fingerprint(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of a non-null text column as an array of longs."""
    cut = df.withColumn("_p", F.split(F.col(text_col), SEPARATOR))
    hashes = [f"_h{k}" for k in range(WORD_LANES + BIT_HASHES)]
    for k, h in enumerate(hashes):
        cut = cut.withColumn(h, _hash(F.col("_p"), k))
    lanes = [F.size("_p").cast("long")]
    lanes += [_total(F.col(h), lambda x: x.bitwiseAND(F.lit(_WORD)), _WORD) for h in hashes[:WORD_LANES]]
    for h in hashes[WORD_LANES:]:
        lanes += [_total(F.col(h), lambda x, i=i: F.shiftrightunsigned(x, i).bitwiseAND(F.lit(_ONES)), _LANES)
                  for i in range(16)]
    return cut.withColumn(name, F.array(*lanes)).drop("_p", *hashes)


def insert(a: Column, b: Column) -> Column:
    """The fingerprint of two multisets together."""
    masks = F.array(*(F.lit(m) for m in MASKS))
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + y), masks, lambda x, m: x.bitwiseAND(m))


def delete(a: Column, b: Column) -> Column:
    """The fingerprint of a without the paragraphs of b. Each lane borrows from a power of its own."""
    lend = F.array(*(F.lit(m) for m in MASKS))
    # x - y = x + (mask - y) + 1 in each lane
    ones = F.array(*([F.lit(1)] * (1 + WORD_LANES) + [F.lit(_ONES)] * BIT_LONGS)).cast("array<long>")
    minus = F.zip_with(F.zip_with(lend, b, lambda m, y: m - y), ones, lambda x, o: x + o)
    return insert(a, F.zip_with(minus, lend, lambda x, m: x.bitwiseAND(m)))


def as_text(fingerprint: Column) -> Column:
    """Fixed-width hexadecimal: 8 digits a word lane, 16 a long of bit lanes."""
    words, bits = 1 + WORD_LANES, BIT_LONGS
    return F.concat(*(F.lower(F.lpad(F.hex(fingerprint[k]), 8, "0")) for k in range(words)),
                    *(F.lower(F.lpad(F.hex(fingerprint[words + k]), 16, "0")) for k in range(bits)))


def _signs(fingerprint: Column) -> Column:
    """The bit lanes read as sums of +1 and -1, centred in their modulus."""
    count = F.element_at(fingerprint, 1)
    half = 1 << 14
    lane = lambda x, s: F.pmod(F.lit(2) * F.shiftrightunsigned(x, s).bitwiseAND(F.lit(0x3FFF)) - count + half, F.lit(2 * half)) - half
    return F.flatten(F.transform(F.slice(fingerprint, 2 + WORD_LANES, BIT_LONGS),
                                 lambda x: F.array(*(lane(x, s) for s in (0, 16, 32, 48)))))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def with_likeness(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with the estimated likeness of pairs of fingerprint columns: shared paragraphs over those of
    the larger text, 1 for equal fingerprints, between 0 and 1."""
    columns = list(dict.fromkeys(c for pair in pairs.values() for c in pair))
    out = df.withColumns({f"_s_{c}": _signs(F.col(c)) for c in columns})
    out = out.withColumns({f"_q_{c}": _dot(F.col(f"_s_{c}"), F.col(f"_s_{c}")) for c in columns})
    for name, (a, b) in pairs.items():
        most = F.greatest(f"_q_{a}", f"_q_{b}", F.lit(1)).cast("double")
        near = _dot(F.col(f"_s_{a}"), F.col(f"_s_{b}")) / most
        out = out.withColumn(name, F.when(F.col(a) == F.col(b), F.lit(1.0))
                             .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), near))))
    return out.drop(*(f"_s_{c}" for c in columns), *(f"_q_{c}" for c in columns))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint: array<long>) of every row."""
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    return with_fingerprint(rows, "_text", "fingerprint").select(id_col, F.char_length("_text").cast("long").alias("n_chars"), "fingerprint")


def with_next_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited, fp, edited_fp, next_fp) of every row: each text with its second half replaced
    by the beginning of the next document in descending id order (after the last: the first).

    Rows with equal id and text are one document in this order; other rows of one id are
    ordered by the hash of their text; a null id comes last. The order is made of range partitions
    of a thin table; the texts are shuffled once, and of each next text only as many
    characters as are wanted.
    """
    zero = F.lit("0").cast(docs.schema[id_col].dataType)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select(
        "text", F.xxhash64("text").alias("h"), F.col("id").isNull().alias("none"), F.coalesce("id", zero).alias("key"))
    thin = with_fingerprint(rows, "text", "fp").select(F.when(~F.col("none"), F.col("key")).alias("id"), "h", F.char_length("text").cast("long").alias("n"), "fp")
    thin = keep(thin, "fingerprints").dropDuplicates(["id", "h"])
    order = (F.desc_nulls_last("id"), F.asc("h"))
    parts = in_order(thin, *order)
    inside = Window.partitionBy("_part").orderBy(*order)
    mark = F.struct("id", "h", "fp", "n")
    seen = parts.select("*", F.lead(mark).over(inside).alias("_next"), F.lag(mark).over(inside).alias("_prev"))
    # one row a partition: where its neighbours begin and end; the ends of the order meet
    ends = parts.groupBy("_part").agg(F.min_by(mark, F.struct(_down("id"), "h")).alias("_first"),
                                      F.max_by(mark, F.struct(_down("id"), "h")).alias("_last"))
    across = Window.orderBy("_part")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("_part", F.coalesce(F.lead("_first").over(across), F.first("_first").over(whole)).alias("_after"),
                       F.coalesce(F.lag("_last").over(across), F.last("_last").over(whole)).alias("_before"))
    joined = seen.join(ends, "_part").select(
        "id", "h", "n", "fp", F.coalesce("_next", "_after").alias("nx"), F.coalesce("_prev", "_before").alias("pv"))
    named = lambda c: [F.col(f"{c}.id").isNull().alias("to_none"), F.coalesce(F.col(f"{c}.id"), zero).alias("to_key"), F.col(f"{c}.h").alias("to_h")]
    plan = joined.select(F.col("id").isNull().alias("none"), F.coalesce("id", zero).alias("key"), "h", "n", "fp",
                         F.col("nx.fp").alias("next_fp"), *named("pv"), F.floor(F.col("pv.n") / 2).cast("int").alias("want"))
    own = ["none", "key", "h"]
    plan = keep(plan, "neighbours")
    whole_rows = rows.join(plan, own)
    # of equal rows one passes its beginning on; they already stand together
    first = F.row_number().over(Window.partitionBy(*own).orderBy(*own))
    heads = (whole_rows.withColumn("_first", first).where("_first = 1")
             .select(F.col("to_none").alias("none"), F.col("to_key").alias("key"), F.col("to_h").alias("h"),
                     F.expr("substring(text, 1, want)").alias("head")))
    out = whole_rows.drop("to_none", "to_key", "to_h", "want").join(heads, own)
    keep_n = (F.col("n") - F.floor(F.col("n") / 2)).cast("int")
    out = out.withColumn("edited", F.concat(F.substring("text", F.lit(1), keep_n), F.col("head")))
    return with_fingerprint(out, "edited", "edited_fp").select(
        F.when(~F.col("none"), F.col("key")).alias(id_col), F.col("n").alias("n_chars"), "edited", "fp", "edited_fp", "next_fp")


def _down(column: str) -> Column:
    """Sorts ascending as the descending order with nulls last."""
    return F.struct(F.col(column).isNull().alias("null"), (-F.col(column).cast("decimal(38,0)")).alias("down"))
