"""Packing by shortest-pack-first over the length histogram.

1. Every text is tokenised once; documents longer than a sequence are cut into whole sequences and a
   rest. What is kept of a piece is its place, length and checksum.
2. The histogram of piece lengths (at most as many rows as a sequence has tokens) goes to the driver.
   Lengths are placed longest first, each into the packing pattern with the most room; a pattern is a
   list of lengths with a count of how often it occurs. A step uses up a length or a pattern, so there
   are about two patterns for each length at the most.
3. Pieces of one length are ranked, in salted groups whose counts are then summed up, and the rank
   finds a piece's pattern, its repetition (the sequence) and its offset.

Defined cases: a null text is empty; an empty text is one piece, its end token; a null id is kept like
any other; repeated rows are packed one by one, and of equal pieces either may come first; an empty
table gives no pieces. Other input columns are not carried. Texts of any length are tokenised whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import distinct, slices, with_id, written
from .tokens import MAX_CACHED, encode_piece, lowered, specials, split, tokenizer, vocabulary

MAX_TOKENS, END_ID = 2048, 1
VOCABULARY = "word_bpe_49k.json"
#: Rows of one length that are ranked in one group, about.
RANKED_ROWS = 200_000


class Encoder:
    """Ids of many texts. The ids of a pre-token are found once and kept by its bytes."""

    def __init__(self, name: str):
        self.library = tokenizer(vocabulary(name))
        self.special = specials(self.library)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, "<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them without special tokens added."""
        low = [lowered(x, self.special) for x in texts]
        joined, start, end, row = split([x or "" for x in low], spaced=False)
        at, inverse = distinct(np.frombuffer(joined, np.uint8), start, end)
        number = self._numbers([joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])[inverse]
        first = self.first[number]
        length = self.first[number + 1] - first
        before = np.cumsum(length) - length
        ids = self.ids[np.repeat(first - before, length) + np.arange(int(length.sum()))] if len(number) else self.ids[:0]
        cuts = np.append(before, len(ids))[np.searchsorted(row, np.arange(len(texts) + 1))]
        return [ids[cuts[i] : cuts[i + 1]] if x is not None else np.array(self.library.encode(texts[i], add_special_tokens=False).ids, "<u4") for i, x in enumerate(low)]

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each pre-token: its ids are self.ids[self.first[number] : self.first[number + 1]]."""
        if len(self.known) > MAX_CACHED:
            self._clear()
        known = self.known
        numbers = list(map(known.get, pieces))
        for i in [i for i, x in enumerate(numbers) if x is None]:
            ids = encode_piece(self.library, pieces[i])
            numbers[i] = known[pieces[i]] = n = len(known)
            used = int(self.first[n])
            if used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), "<u4")])
            if n + 2 > len(self.first):
                self.first = np.concatenate([self.first, np.zeros(len(self.first), np.int64)])
            self.ids[used : used + len(ids)] = ids
            self.first[n + 1] = used + len(ids)
        return np.array(numbers, np.int64)


@lru_cache(2)
def _encoder(name: str) -> Encoder:
    return Encoder(name)


def _pieces(batches: Iterator[pa.RecordBatch], name: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, end = _encoder(name), np.array([end_id], "<u4")
    for batch in slices(batches, "text"):
        source, start, length, crc, total = [], [], [], [], []
        for i, ids in enumerate(encoder.encode([x or "" for x in batch.column("text").to_pylist()])):
            ids = np.append(ids, end)
            raw = ids.tobytes()
            for at in range(0, len(ids), size):
                source.append(i)
                start.append(at)
                length.append(min(size, len(ids) - at))
                crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                total.append(len(ids))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(source, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["id", "start", "length", "ids_crc32", "doc_tokens"])


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, vocabulary_name: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most max_tokens tokens: id, start, length, ids_crc32, doc_tokens."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(partial(_pieces, name=vocabulary_name, size=max_tokens, end_id=end_id), with_id(docs, id_col, "start long, length long, ids_crc32 long, doc_tokens long"))


def patterns(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Packing patterns with their counts. by_room[r]: patterns with r free places."""
    by_room: dict[int, list[tuple[list[int], int]]] = {}
    rooms = np.zeros(size + 1, bool)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        grown: list[tuple[int, tuple[list[int], int]]] = []
        while left:
            fitting = np.flatnonzero(rooms[length:])
            if not len(fitting):
                grown.append((size - length, ([length], left)))
                break
            room = length + int(fitting[-1])
            lengths, count = by_room[room].pop()
            used = min(left, count)
            if used < count:
                by_room[room].append((lengths, count - used))
            if not by_room[room]:
                rooms[room] = False
            grown.append((room - length, ([*lengths, length], used)))
            left -= used
            if length <= room - length:  # the shortest pack may be this one again
                by_room.setdefault(room - length, []).append(grown.pop()[1])
                rooms[room - length] = True
        for room, pattern in grown:
            by_room.setdefault(room, []).append(pattern)
            rooms[room] = True
    return [p for room in sorted(by_room) for p in by_room[room]]


def slots(found: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, by slot: the first rank in it, the first sequence, the offset."""
    at: dict[int, list[tuple[int, int, int]]] = {}
    filled: dict[int, int] = {}
    sequence = 0
    for lengths, count in found:
        offset = 0
        for length in lengths:
            at.setdefault(length, []).append((filled.get(length, 0), sequence, offset))
            filled[length] = filled.get(length, 0) + count
            offset += length
        sequence += count
    return {k: tuple(np.array(v, np.int64).T) for k, v in at.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, vocabulary_name: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = written(tokenized_pieces(docs, id_col, text_col, max_tokens, vocabulary_name, end_id), "pieces")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    place = docs.sparkSession.sparkContext.broadcast(slots(patterns(histogram, max_tokens)))
    groups = max(64, -(-max(histogram.values(), default=0) // RANKED_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before.select("length", "salt", "before"), ["length", "salt"]).withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        ranks = rank.to_numpy()
        for n, rows in length.groupby(length.to_numpy()).indices.items():
            first, sequences, offsets = place.value[int(n)]
            slot = np.searchsorted(first, ranks[rows], "right") - 1
            sequence[rows], offset[rows] = sequences[slot] + ranks[rows] - first[slot], offsets[slot]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("place", placed("length", "rank")).select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "place.sequence_id", "place.offset")
