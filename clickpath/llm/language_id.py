"""Operator 7: language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: how often each byte followed each context
of up to ``ORDER`` bytes in its training texts. A byte is coded in its longest known
context; where that context has never seen the byte, an escape (method C: distinct
followers over occurrences plus distinct followers) passes to the next shorter one,
down to a uniform order below zero. The trees are frozen after training, so a text's
exact code length is a sum over its bytes.

A text is read as its words, each coded from a blank that starts it to a blank that
ends it; contexts do not reach back across a blank. Words are runs of letters, in lower
case. The code length of a word is therefore a fixed vector with one entry a language;
workers keep those vectors, and a text's code length is their sum over its whole text.
The language with the shortest code wins; the score is its share of
2^(-bits a byte * SHARPNESS) over all languages.

Training: the trees are fitted on at most ``TRAIN_DOCS`` different labelled texts a language (those
with the smallest hash, so the choice doesn't depend on the order, the partitioning or the
number of copies); prediction reads every row.

Defined cases: null texts and texts without a letter give ``und`` and score 0; rows
whose language is null don't train; equal code lengths go to the smaller language name;
with no training row at all every text is ``und``; repeated rows each get a row.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from clickpath.llm.bpe_model import IntTable
from clickpath.llm.common import arrow_batches, keep, text_of, worker_state
from clickpath.llm.pretokens import LETTER, PieceTable, Splitter, blocks

#: Bytes of context.
ORDER = 4
#: Different labelled texts a language that the trees are fitted on, at most.
TRAIN_DOCS = 2000
#: Languages that can be learned; their counts, cuts and trees are broadcast.
MAX_LANGUAGES = 256
#: Largest number of contexts a language's tree keeps (most frequent first).
TREE_NODES = 200_000
SHARPNESS = 4.0
#: Words a worker remembers.
CACHE_WORDS = 300_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")  # for training; prediction reads runs of Unicode's letter categories


def words_of(text: str) -> Counter:
    """Lower-case runs of letters and how often each occurs."""
    return Counter(_WORD.findall(text.lower()))


def gram_keys(data: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Each gram of ``size`` bytes that ends before ``end``, as an integer that also holds its size."""
    key = np.full(len(end), size, np.int64)
    for k in range(size, 0, -1):
        key = key << 8 | data[np.maximum(end - k, 0)]
    return key


def coded_bytes(words: list[bytes]):
    """The bytes of the words with their blanks, the place of every coded byte, its word, and
    how many bytes of context it has inside the word."""
    size = np.array([len(w) + 1 for w in words], np.int64)
    data = np.frombuffer(b"".join(b" " + w for w in words) + b" ", np.uint8).astype(np.int64)
    at = np.arange(1, len(data))  # a word's last coded byte is the next one's first blank
    return data, at, np.repeat(np.arange(len(words)), size), at - np.repeat(np.cumsum(size) - size, size)


def grams_of(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of (context + following byte), contexts of 0 to ORDER bytes inside a word."""
    data, at, owner, reach = coded_bytes([w.encode() for w in words])
    weight = np.array(list(words.values()), np.float64)[owner]
    keys, counts = [], []
    for order in range(ORDER + 1):
        has = reach >= order
        key, back = np.unique(gram_keys(data, at[has] + 1, order + 1), return_inverse=True)
        keys.append(key)
        counts.append(np.bincount(back, weights=weight[has], minlength=len(key)).astype(np.int64))
    return np.concatenate(keys), np.concatenate(counts)


def training_rows(docs: DataFrame, text_col: str, lang_col: str, most: int) -> DataFrame:
    """At most ``most`` different labelled texts of each language, one row each, by the hash of the text. A first
    cut at a hash threshold, from the counts of different texts, leaves a bounded number of candidates to rank."""
    rows = (docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                    F.xxhash64(text_col).alias("_h")))
    # two passes: exact rank among the different hashes only, then the texts at or below the cut
    span = float(1 << 63)
    kinds = keep(rows.groupBy("lang", "_h").agg(F.lit(1).alias("_one")).select("lang", "_h"), "training_texts")
    counts = kinds.groupBy("lang").agg(F.count("*").alias("_n"))
    if counts.limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = F.least(F.lit(1.0), (F.lit(2.0) * most + 1000) / F.col("_n"))
    near = (kinds.join(F.broadcast(counts), "lang")
            .where(F.col("_h") <= F.lit(-span) + share * (2 * span)))
    cut = (near.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h")))
           .where(F.col("_r") <= most).groupBy("lang").agg(F.max("_h").alias("_cut")))
    return (rows.join(F.broadcast(cut), "lang").where(F.col("_h") <= F.col("_cut"))
            .groupBy("lang", "_h").agg(F.min("text").alias("text")).select("lang", "text"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> DataFrame:
    """(lang, gram, n): the context trees of all languages, at most TREE_NODES nodes a language."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in counts.items():
            if words:
                grams, n = grams_of(words)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams),
                                                  pa.array(n)], names=["lang", "gram", "n"])

    schema = StructType([StructField("lang", StringType()), StructField("gram", LongType()),
                         StructField("n", LongType())])
    grams = (training_rows(docs, text_col, lang_col, most).mapInArrow(run, schema)
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")  # shorter contexts have smaller keys
    return grams.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= TREE_NODES).drop("_r")


class Trees:
    """Frozen statistics of all languages; ``costs(words)`` are exact code lengths in each."""

    def __init__(self, lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = sorted(set(lang.tolist()))
        grams, row = np.unique(gram, return_inverse=True)
        # without its last byte, and one byte shorter
        size = np.array([(int(g).bit_length() + 7) // 8 - 1 for g in grams], np.int64)
        inner = grams - (size << (8 * size))
        contexts, context_of = np.unique((inner >> 8) + ((size - 1) << (8 * (size - 1))), return_inverse=True)
        count = np.zeros((len(grams), len(self.langs)))
        count[row, np.searchsorted(self.langs, lang)] = n
        place = self.langs
        total, kinds = np.zeros((len(contexts), len(place))), np.zeros((len(contexts), len(place)))
        np.add.at(total, context_of, count)
        np.add.at(kinds, context_of, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = np.log2((total + kinds)[context_of] / count)
            #: bits of an escape; a context never met passes on for nothing
            escape = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0.0)
        self.escape = np.append(escape, np.zeros((1, len(place))), axis=0)
        self.grams = IntTable(grams, np.arange(len(grams)))
        self.contexts = IntTable(contexts, np.arange(len(contexts)))
        #: bits of a gram's last byte in its context, all escapes below included, in each language
        self.bits = np.empty((len(grams) + 1, len(place)))
        self.bits[-1] = 8.0  # below order 0 all bytes are alike
        for k in range(1, ORDER + 2):
            own = np.flatnonzero(size == k)
            shorter = (inner[own] & ((1 << (8 * (k - 1))) - 1)) + ((k - 1) << (8 * (k - 1)))
            below = self.grams.get(shorter) if k > 1 else np.full(len(own), -1)
            self.bits[own] = np.where(count[own] > 0, hit[own], escape[context_of[own]] + self.bits[below])

    def costs(self, words: list[bytes]) -> np.ndarray:
        """A row a word: bits in each language, then the number of bytes coded."""
        data, at, owner, reach = coded_bytes(words)
        gram = np.full(len(at), -1, np.int64)
        bits = np.zeros((len(at), len(self.langs)))
        rows = np.arange(len(at))
        for order in range(ORDER, -1, -1):  # the longest context that has met the byte in some language
            some = reach[rows] >= order
            here = rows[some]
            found = self.grams.get(gram_keys(data, at[here] + 1, order + 1))
            gram[here] = found
            miss = here[found < 0]
            bits[miss] += self.escape[self.contexts.get(gram_keys(data, at[miss], order))]
            rows = np.append(rows[~some], miss)
        bits += self.bits[gram]
        out = np.empty((len(words), len(self.langs) + 1))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, weights=bits[:, k], minlength=len(words))
        out[:, -1] = np.bincount(owner, minlength=len(words))
        return out


class WordCosts:
    """A worker's table of word costs by the hash of the word; it starts anew when full."""

    def __init__(self, trees: Trees):
        self.trees = trees
        self.places = PieceTable(CACHE_WORDS)
        self.costs = np.zeros((0, len(trees.langs) + 1))

    def find(self, data: bytes, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        kinds, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = self.places.find(kinds)
        out = np.zeros((len(kinds), self.costs.shape[1]))
        old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        out[old] = self.costs[self.places.values[self.places.start[at[old]]]]
        if len(new):
            out[new] = self.trees.costs([data[a:b] for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist())])
            if len(self.costs) + len(new) > CACHE_WORDS:
                self.costs = self.costs[:0]
                self.places.clear()
            if len(new) <= CACHE_WORDS:
                self.places.add(kinds[new], np.arange(len(new)) + len(self.costs), np.ones(len(new), np.int64))
                self.costs = np.append(self.costs, out[new], axis=0)
        return out[back]


def text_costs(splitter: Splitter, table: WordCosts, texts: list[str]) -> np.ndarray:
    """A row a text: bits in each language, then the number of bytes coded."""
    total = np.zeros((len(texts), table.costs.shape[1]))
    for numbers, parts in blocks([t.lower().encode() for t in texts]):
        data = b"".join(parts)
        buffer = np.frombuffer(data, np.uint8)
        lead = np.append(np.flatnonzero((buffer & 0xC0) != 0x80), len(buffer))
        code = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        letter = splitter.classes[code] == LETTER
        if not letter.any():
            continue
        sizes = np.array([len(p) for p in parts], np.int64)
        starts = np.cumsum(sizes) - sizes
        first = np.zeros(len(code) + 1, bool)
        first[np.searchsorted(lead, starts)] = True
        before = np.append(False, letter[:-1]) & ~first[:-1]
        after = np.append(letter[1:], False) & ~first[1:]
        start, end = lead[:-1][letter & ~before], lead[1:][letter & ~after]
        owner = np.array(numbers)[np.searchsorted(starts, start, side="right") - 1]
        costs = table.find(data, start, end, splitter.hasher.spans(buffer, start, end))
        for k in range(costs.shape[1]):
            total[:, k] += np.bincount(owner, weights=costs[:, k], minlength=len(texts))
    return total


def judge(langs: list[str], total: np.ndarray):
    """(language, score, bits a byte) of each row of code lengths."""
    if not langs:
        return [UNKNOWN] * len(total), np.zeros(len(total)), np.zeros(len(total))
    some = total[:, -1] > 0
    rate = total[:, :-1] / np.maximum(total[:, -1:], 1)
    best = np.argmin(np.round(rate, 9), axis=1)
    least = rate[np.arange(len(rate)), best]
    score = 1.0 / np.exp2(-SHARPNESS * (rate - least[:, None])).sum(axis=1)
    return ([langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())],
            np.where(some, score, 0.0), np.where(some, least, 0.0))


def identify(docs: DataFrame, trees: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             carry: bool = False) -> DataFrame:
    """(id, lang_pred, score, bits_per_byte) of every row, and with ``carry`` the whole input row as a
    struct ``row``."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = trees.toArrow()  # at most TREE_NODES a language
    lang, gram, n = (rows.column(c).to_numpy() for c in ("lang", "gram", "n"))
    order = np.lexsort((gram, lang.astype(str)))
    model = spark.sparkContext.broadcast((uuid.uuid4().hex, lang[order].astype(str), gram[order], n[order]))
    names = ["id", "lang_pred", "score", "bits_per_byte", *(["row"] if carry else [])]

    def run(batches):
        key, *learned = model.value
        splitter = worker_state("language id", "splitter", 0, Splitter)
        costs = worker_state("language id", "costs", key, lambda: WordCosts(Trees(*learned)))
        for batch in batches:
            lang, score, rate = judge(costs.trees.langs, text_costs(splitter, costs, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64()),
                 *batch.columns[2:]], names=names)

    row = F.struct(*(F.col(c) for c in docs.columns))
    asked = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), *([row.alias("row")] if carry else []))
    schema = StructType([asked.schema["id"], StructField("lang_pred", StringType()), StructField("score", DoubleType()),
                         StructField("bits_per_byte", DoubleType()), *asked.schema.fields[2:]])
    return asked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
