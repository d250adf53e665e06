"""Operator 2: licence scan by Dice coefficient over word bigrams.

A text is normalised to lower-case words of letters and digits and hashed to word bigrams
as one array. For each licence template, the window of the text that shares most of its
bigrams is sought and compared with it by the Dice coefficient of the two bigram sets,
2 * shared / (size of the window's set + size of the template's); the whole text is such
a window if it is no longer than the size bounds allow. A window also holds the bigrams
of what the template must have (``MUST``: a grant's licence name, what tells notices of a family
apart), so that the words of a grant alone match nothing and no other licence's name stands in.

Size bounds prune before any comparison: sets of sizes a and b reach a coefficient t only
if min(a, b) >= t / (2 - t) * max(a, b), so a text with fewer bigrams than that of a
template, or in which fewer of the template's bigrams occur at all, skips it, and only
windows that begin at a bigram of the template and hold no more than the bound are looked at.

Every text is read whole, in one map without a shuffle. The templates are a fixed list.

Defined cases: null and empty texts and texts of one word match nothing; ties go to the
longer template, then to the smaller name; overlapping windows of other templates that
score less are left out; repeated rows each get a row; null ids pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from clickpath.llm.common import arrow_batches, text_of, worker_state
from clickpath.llm.license_templates import MUST, TEMPLATES
from clickpath.llm.pretokens import SpanHasher, blocks, mix

#: Least Dice coefficient of a match.
LEAST = 0.8
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Scanner:
    def __init__(self, templates: dict[str, list[str]], least: float):
        self.least = least
        self.hasher = SpanHasher(17)
        self.names, self.sets, self.musts = [], [], []
        for name, texts in templates.items():
            for text in texts:
                self.names.append(name)
                self.sets.append(np.unique(self.bigrams([text.encode()])[0]))
                must = self.bigrams([m.encode() for m in MUST.get(text, [])])
                self.musts.append(np.unique(np.concatenate(must)) if must else self.sets[-1][:0])
        all_, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
        order = np.argsort(all_, kind="stable")
        self.known, self.owner = all_[order], owner[order]

    def bigrams(self, texts: list[bytes]) -> list[np.ndarray]:
        got: list[list[np.ndarray]] = [[] for _ in texts]
        for numbers, parts in blocks([t.lower() for t in texts]):
            data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
            word = _IS_WORD[data]
            start = np.flatnonzero(word & np.append(True, ~word[:-1]))
            end = np.flatnonzero(~word & np.append(False, word[:-1]))
            hashes = self.hasher.spans(data, start, end)
            ends = np.cumsum([len(p) + 1 for p in parts])
            for k, own in zip(numbers, np.split(hashes, np.searchsorted(start, ends[:-1]))):
                got[k].append(own)
        words = [np.concatenate(g) if g else np.zeros(0, np.uint64) for g in got]
        factor = np.uint64(0x9E3779B97F4A7C15)
        return [mix(w[:-1] * factor + w[1:]) if len(w) > 1 else w[:0] for w in words]

    def matches(self, grams: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(name, coefficient, first word, end word), best first, not overlapping."""
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == grams)
        if not len(hit):
            return []
        # a bigram may be in several templates: they stand next to each other
        own = [hit], [self.owner[at[hit]]]
        step = at[hit] + 1
        while True:
            more = (step < len(self.known)) & (self.known[np.minimum(step, len(self.known) - 1)] == grams[hit])
            if not more.any():
                break
            hit, step = hit[more], step[more]
            own[0].append(hit)
            own[1].append(self.owner[step])
            step = step + 1
        place, template = np.concatenate(own[0]), np.concatenate(own[1])
        found = []
        ratio = self.least / (2 - self.least)
        for t in np.unique(template).tolist():
            size = len(self.sets[t])
            places = np.sort(place[template == t])
            must = self.musts[t]
            if len(grams) < ratio * size or len(np.unique(grams[places])) < ratio * size or not np.isin(must, grams[places]).all():
                continue
            longest = int(size / ratio)
            end = np.searchsorted(places, places + longest)
            # at most one window for each hit; those with too few hits are pruned
            for i in np.flatnonzero(end - np.arange(len(places)) >= ratio * size).tolist():
                inside = places[i:end[i]]
                kinds, first = np.unique(grams[inside], return_index=True)
                for last in np.sort(inside[first])[int(np.ceil(ratio * size)) - 1:].tolist():
                    window = np.unique(grams[places[i]:last + 1])
                    shared = len(np.unique(grams[inside[inside <= last]]))
                    dice = 2 * shared / (len(window) + size)
                    if dice >= self.least and np.isin(must, window).all():
                        found.append((-round(dice, 9), -size, self.names[t], int(places[i]), int(last) + 2))
        out, taken = [], []
        for dice, _, name, a, b in sorted(set(found)):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append((name, -dice, a, b))
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST,
         templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, n_bigrams, license, dice, matches) of every row: the best match and all of them, with word spans."""
    arrow_batches(docs.sparkSession)
    known = templates or TEMPLATES

    def run(batches):
        scanner = worker_state("licences", "scanner", (least, str(known)), lambda: Scanner(known, least))
        for batch in batches:
            grams = scanner.bigrams(batch.column(1).cast(pa.binary()).to_pylist())
            found = [scanner.matches(g) for g in grams]
            spans = pa.array([[{"license": n, "dice": d, "start": a, "end": b} for n, d, a, b in f] for f in found],
                             pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int32()),
                                                 ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(g) for g in grams], pa.int64()),
                 pa.array([f[0][0] if f else None for f in found], pa.string()),
                 pa.array([f[0][1] if f else 0.0 for f in found], pa.float64()), spans],
                names=[id_col, "n_bigrams", "license", "dice", "matches"])

    span = StructType([StructField("license", StringType()), StructField("dice", DoubleType()),
                       StructField("start", IntegerType()), StructField("end", IntegerType())])
    schema = StructType([docs.schema[id_col], StructField("n_bigrams", LongType()), StructField("license", StringType()),
                         StructField("dice", DoubleType()), StructField("matches", ArrayType(span))])
    return docs.select(F.col(id_col), text_of(text_col).alias(text_col)).mapInArrow(run, schema)
