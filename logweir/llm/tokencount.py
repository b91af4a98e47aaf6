"""Token counts without token ids: pieces are counted once per distinct pre-token.

1. The commonest pre-tokens of a bounded sample of documents (HEAD_TOKENS at most) are encoded once and
   broadcast with their numbers of pieces.
2. One pass over the texts gives each document's pre-token frequencies: those of the head are summed at
   once, the others stay as (pre-token, frequency).
3. The distinct others of all documents are encoded once each, joined to the frequencies and summed per
   document. Which pre-tokens are in the head changes the work, never a count; they are looked up by a
   hash and then compared byte by byte. Texts of all scripts go the same way, so what is common in any of
   them is in the head.

Special strings inside a text count as the library's default takes them: one token each.

Defined cases: a null text is empty, 0 bytes and 0 tokens; null ids and repeated rows keep their own
rows; an empty table gives an empty result. Other input columns are not carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, same_bytes, sample_below, slices, sorting_hash, with_id, written
from .tokens import encode_piece, parts, specials, split, tokenizer, vocabulary

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: The bounds of the head: documents it is taken from, and pre-tokens in it (about 6 MB).
SAMPLE_DOCS, HEAD_TOKENS = 20_000, 400_000
#: Distinct pre-tokens that a task of the sample holds before it hands them on.
MAX_HELD = 200_000


class Splitter:
    """Pre-tokens of many texts."""

    def __init__(self, name: str):
        self.library = tokenizer(vocabulary(name))
        self.special = specials(self.library)

    def split(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of the texts without their special strings, start and end there of the different
        pre-tokens, which of them each pre-token is, its text, and the texts' numbers of special strings."""
        cut = [parts(x, self.special) for x in texts]
        joined, start, end, row = split([y for x in cut for y in x], spaced=True)
        at, number = distinct(np.frombuffer(joined, np.uint8), start, end)
        many = np.array([len(x) for x in cut], np.int64)
        return joined, start[at], end[at], number, np.repeat(np.arange(len(texts)), many)[row], many - 1


@lru_cache(2)
def _splitter(name: str) -> Splitter:
    return Splitter(name)


def _frequencies(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """(pre-token, frequency) of a task's texts, added up as far as MAX_HELD allows."""
    splitter, held = _splitter(name), Counter()

    def handed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["piece", "n"])

    for batch in slices(batches, "text"):
        joined, start, end, number, _, _ = splitter.split([x or "" for x in batch.column("text").to_pylist()])
        for a, b, k in zip(start.tolist(), end.tolist(), np.bincount(number, minlength=len(start)).tolist(), strict=True):
            held[joined[a:b]] += k
        if len(held) > MAX_HELD:
            yield handed()
            held.clear()
    yield handed()


class Head:
    """Common pre-tokens and their numbers of tokens, in order of a hash."""

    def __init__(self, pieces: list[bytes], tokens: list[int]):
        ends = np.cumsum([0, *map(len, pieces)])
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        hashes = sorting_hash(self.data, ends[:-1], ends[1:])
        order = np.argsort(hashes, kind="stable")
        self.hash, self.start, self.end, self.tokens = hashes[order], ends[:-1][order], ends[1:][order], np.array(tokens, np.int64)[order]

    def tokens_of(self, joined: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of tokens of the pre-tokens, -1 for those that are not in the head. Of pre-tokens that share
        a hash one is found and the others are not: they count as rare."""
        out = np.full(len(start), -1, np.int64)
        if len(self.hash) and len(start):
            data = np.frombuffer(joined, np.uint8)
            piece = sorting_hash(data, start, end)
            at = np.minimum(np.searchsorted(self.hash, piece), len(self.hash) - 1)
            rows = np.flatnonzero(self.hash[at] == piece)
            rows = rows[same_bytes(data, start[rows], end[rows], self.data, self.start[at[rows]], self.end[at[rows]])]
            out[rows] = self.tokens[at[rows]]
        return out


def _pieces(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    library = tokenizer(vocabulary(name))
    for batch in batches:
        counts = [len(encode_piece(library, x)) for x in batch.column("piece").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(counts, pa.int64())], ["piece", "pieces"])


def count_pieces(distinct: DataFrame, vocabulary_name: str = VOCABULARY) -> DataFrame:
    """Number of tokens of each pre-token (binary column `piece`)."""
    return distinct.select("piece").mapInArrow(partial(_pieces, name=vocabulary_name), "piece binary, pieces long")


def _documents(batches: Iterator[pa.RecordBatch], name: str, head) -> Iterator[pa.RecordBatch]:
    splitter, known = _splitter(name), head.value
    key = TaskContext.get().partitionId() << 33  # of the rows that this task writes: no other task's, and fixed once written
    for batch in slices(batches, "text"):
        texts = [x or "" for x in batch.column("text").to_pylist()]
        joined, start, end, number, row, special = splitter.split(texts)
        tokens = known.tokens_of(joined, start, end)
        common = tokens[number] >= 0 if len(number) else np.zeros(0, bool)
        total = special + np.bincount(row[common], tokens[number[common]], len(texts)).astype(np.int64)
        # the others' frequencies in each text
        pair, n = np.unique(row[~common] * max(1, len(start)) + number[~common], return_counts=True)
        of, piece = pair // max(1, len(start)), pair % max(1, len(start))
        ends = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32())
        spelled = [joined[a:b] for a, b in zip(start[piece].tolist(), end[piece].tolist(), strict=True)]
        entry = pa.StructArray.from_arrays([pa.array(spelled, pa.binary()), pa.array(n, pa.int32())], ["piece", "n"])
        n_bytes = np.array([len(x) if x.isascii() else len(x.encode()) for x in texts], np.int64)
        columns = [batch.column("id"), pa.array(n_bytes), pa.array(np.arange(key, key + len(texts))), pa.array(total), pa.ListArray.from_arrays(ends, entry)]
        key += len(texts)
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "key", "head", "rare"])


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_name: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = sample_below(texts, "id", SAMPLE_DOCS).select("text").mapInArrow(partial(_frequencies, name=vocabulary_name), "piece binary, n long")
    common = sample.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(HEAD_TOKENS)
    rows = count_pieces(common, vocabulary_name).collect()
    head = spark.sparkContext.broadcast(Head([bytes(r.piece) for r in rows], [r.pieces for r in rows]))

    counted = written(texts.mapInArrow(partial(_documents, name=vocabulary_name, head=head), with_id(docs, id_col, "n_bytes long, key long, head long, rare array<struct<piece:binary,n:int>>")), "counted")
    rare = counted.select("key", F.explode("rare").alias("x")).select("key", "x.piece", "x.n")
    sums = rare.join(count_pieces(rare.select("piece").distinct(), vocabulary_name), "piece").groupBy("key").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    n_tokens = F.col("head") + F.coalesce("more", F.lit(0))
    return counted.select("id", "n_bytes", "key", "head").join(sums, "key", "left").select(F.col("id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
