"""Operator 9: BPE encoding and decoding by speculation and check.

``encode(docs)`` returns (id, ids: array<int>), ``decode(tokens)`` the text of any id
lists. Both are per-row maps in Arrow batches without a shuffle. A worker keeps the
encodings of the pre-tokens it has met in a table of bounded size; the misses of a
batch are proposed by greedy longest match, checked pair by pair in one vectorised
pass, and merged exactly only where a pair fails (see ``bpe_model``).

Defined cases: a null text is the empty text and gives no ids; a null id is passed
through; repeated rows give repeated results; special strings inside a text give
their own id, as the library does by default; null ids decode as the empty text;
invalid UTF-8 decodes with replacement characters; an id out of range raises.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from clickpath.llm.bpe_model import BpeModel, token_bytes
from clickpath.llm.common import arrow_batches, text_of, worker_state
from clickpath.llm.pretokens import PieceTable, Splitter, blocks, slices

#: Pre-tokens a worker remembers; the table starts anew when full.
CACHE_PIECES = 400_000
#: Pre-tokens of more bytes are encoded each time, not remembered.
CACHE_BYTES = 64
#: A vocabulary file is broadcast to the workers up to this size.
MAX_VOCABULARY_MB = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load_vocabulary(path: str) -> str:
    if os.path.getsize(path) > MAX_VOCABULARY_MB << 20:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_MB} MB")
    with open(path, encoding="utf-8") as f:
        return f.read()


def worker_model(spec: str) -> tuple[BpeModel, Splitter, PieceTable]:
    """The worker's model, splitter and table of known pre-tokens."""
    return worker_state("bpe", "model", spec, lambda: (BpeModel(spec), Splitter(), PieceTable(CACHE_PIECES)))


def encode_texts(model: BpeModel, splitter: Splitter, table: PieceTable, texts: list[str | bytes]):
    """Token ids of whole texts: all in a row, and how many each text has."""
    texts = [t.encode() if isinstance(t, str) else t for t in texts]
    got: list[list[np.ndarray]] = [[] for _ in texts]
    special = [s.encode() for s in model.special]
    plain = [b"" if any(s in t for s in special) else t for t in texts]
    for numbers, parts in blocks(plain):
        sizes = np.array([len(p) for p in parts], np.int64)
        found = splitter.split_block(b"".join(parts), np.cumsum(sizes) - sizes)
        if found is None:
            for k, part in zip(numbers, parts):
                got[k].append(encode_singly(model, part.decode()))
            continue
        ids, counts = encode_spans(model, table, b"".join(parts), *found, len(parts))
        for k, own in zip(numbers, np.split(ids, np.cumsum(counts)[:-1])):
            got[k].append(own)
    for k, t in enumerate(texts):
        if t and not plain[k]:
            got[k] = [encode_singly(model, t.decode())]
    sizes = np.array([sum(map(len, g)) for g in got], np.int64)
    flat = [x for g in got for x in g]
    return np.concatenate(flat) if flat else np.zeros(0, np.int32), sizes


def encode_spans(model: BpeModel, table: PieceTable, data: bytes, start, end, hashes, owner, n: int):
    """Ids of the pre-tokens of a block of n texts, and their number for each text."""
    kinds, one, back = np.unique(hashes, return_index=True, return_inverse=True)
    at = table.find(kinds)
    new = np.flatnonzero(at < 0)
    fresh, fresh_size = model.encode_pieces([data[a:b] for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist())])
    first, size = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
    old = np.flatnonzero(at >= 0)
    first[old], size[old] = table.start[at[old]], table.size[at[old]]
    first[new], size[new] = np.cumsum(fresh_size) - fresh_size + len(table.values), fresh_size
    values = np.append(table.values, fresh)
    each = size[back]
    ids = values[slices(first[back], each)]
    short = end[one[new]] - start[one[new]] <= CACHE_BYTES
    table.add(kinds[new[short]], fresh[np.repeat(short, fresh_size)], fresh_size[short])
    return ids, np.bincount(owner, weights=each, minlength=n).astype(np.int64)


def encode_singly(model: BpeModel, text: str) -> np.ndarray:
    """Ids of a text with special strings or with characters that only the library can class."""
    out = []
    for k, part in enumerate(model.parts(text)):
        out.append(np.array([model.special[part]], np.int32) if k % 2 else
                   model.encode_pieces([p.encode() for p in model.pieces(part)])[0] if part else np.zeros(0, np.int32))
    return np.concatenate(out)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           vocabulary: str | None = None, decoded: bool = False) -> DataFrame:
    """(id, ids) of every whole text, and with ``decoded`` the text that the ids decode to."""
    spark = docs.sparkSession
    arrow_batches(spark)
    spec = spark.sparkContext.broadcast(load_vocabulary(vocabulary or default_vocabulary()))

    def run(batches):
        model, splitter, table = worker_model(spec.value)
        for batch in batches:
            ids, sizes = encode_texts(model, splitter, table, batch.column(1).cast(pa.binary()).to_pylist())
            if len(ids) >= 1 << 31:
                raise ValueError("a batch of texts has over 2^31 tokens")
            ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
            out = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
            if decoded:
                out.append(decode_lists(model.bytes_of, ids, ends))
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "ids", "text"][:len(out)])

    rows = docs.select(F.col(id_col), text_of(text_col).alias(text_col))
    fields = [docs.schema[id_col], StructField("ids", ArrayType(IntegerType()))]
    return rows.mapInArrow(run, StructType(fields + [StructField("text", StringType())] * decoded))


def decode_lists(tokens: list[bytes], ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The text of each slice of ids."""
    if len(ids) and ids.min() < 0:
        raise ValueError("a negative token id")
    return pa.array([b"".join(map(tokens.__getitem__, ids[a:b].tolist())).decode("utf-8", "replace")
                     for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.string())


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids, text) of every whole text: ``encode`` and ``decode`` of its ids, in one map."""
    return encode(docs, id_col, text_col, vocabulary, decoded=True)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids",
           vocabulary: str | None = None) -> DataFrame:
    """(id, ids, text) of every list of ids; special tokens give their strings."""
    spark = tokens.sparkSession
    arrow_batches(spark)
    spec = spark.sparkContext.broadcast(load_vocabulary(vocabulary or default_vocabulary()))

    def run(batches):
        tokens = worker_state("bpe", "tokens", spec.value, lambda: token_bytes(spec.value))
        for batch in batches:
            lists = batch.column(1)
            texts = decode_lists(tokens, lists.values.to_numpy(), lists.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, texts], names=[id_col, "ids", "text"])

    rows = tokens.select(F.col(id_col), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, StructType([tokens.schema[id_col], StructField("ids", ArrayType(IntegerType())),
                                            StructField("text", StringType())]))


def digests(ids, text) -> list:
    """SHA-256 of the decimal ids joined by commas, and of the text."""
    return [F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256).alias("ids_sha256"),
            F.sha2(text, 256).alias("decoded_sha256")]
