"""Benchmark decontamination by winnowing.

Every benchmark item and every document is fingerprinted: of each window of WINDOW consecutive k-gram
hashes the minimum is kept. Two texts that share SPAN = K + WINDOW - 1 words in a row share a
fingerprint, so the join of the fingerprints misses no shared span of that length. Around each hit the
document's spans of SPAN words that have this fingerprint are extended to: each is looked up among the
items' spans, compared as it is spelled, and neighbouring ones are merged. So a text that repeats a word
or a line is as much work as its length, however often a fingerprint occurs on either side. Items of
fewer than SPAN words are too short for the guarantee: they are looked up whole at every position of the
document.

Defined cases: a null or wordless text has no words and no hits; wordless items are in no document;
repeated items count one by one, under their own ids; null item ids are left out of the list of ids;
repeated documents are judged one by one; an empty benchmark contaminates nothing. Other input columns
are not carried.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, grams, same_bytes, slices, utf8, with_id, words, written

SPAN, K = 13, 5
WINDOW = SPAN - K + 1
#: Bytes of a benchmark that is broadcast, at the most; fingerprints of a larger one are joined.
BROADCAST_BYTES = 16 << 20
#: Bits of the sketch of its fingerprints, and parts that each span is dealt to in the join.
SKETCH_BITS, SALTS = 1 << 26, 16
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def winnow(gram: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the minima (the first of equals) of all windows of `gram`, each once."""
    if len(gram) <= window:
        return np.array([gram.argmin()]) if len(gram) else np.zeros(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(gram, window).argmin(axis=1) + np.arange(len(gram) - window + 1)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


class Text:
    """The words of many texts: their hashes, their bytes and each text's first word."""

    def __init__(self, texts: pa.Array):
        data, offsets = utf8(texts)
        self.hash, self.start, self.end, self.row = words(data, offsets, IS_WORD)
        self.low = LOWER[data]
        self.first = np.searchsorted(self.row, np.arange(len(texts) + 1))

    def spelled(self, at: int, m: int) -> bytes:
        """The m words from word `at` on, joined by a blank."""
        return b" ".join(self.low[x:y].tobytes() for x, y in zip(self.start[at : at + m].tolist(), self.end[at : at + m].tolist(), strict=True))

    def windows(self, m: int) -> np.ndarray:
        """Words from which m words go on in the same text."""
        at = np.arange(max(0, len(self.row) - m + 1))
        return at[self.row[at] == self.row[at + m - 1]] if m else at


def prints(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints of texts of at least SPAN words, each text by itself."""
    at = np.concatenate([np.zeros(0, np.int64), *(text.first[i] + winnow(grams(text.hash[text.first[i] : text.first[i + 1]], K)) for i in np.flatnonzero(np.diff(text.first) >= SPAN))])
    return at, grams(text.hash, K)[at] if len(at) else np.zeros(0, np.uint64)


def has_print(gram: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Of each window of WINDOW gram hashes, whether its fingerprint is known (known: for each gram)."""
    if len(gram) < WINDOW or not known.any():
        return np.zeros(max(0, len(gram) - WINDOW + 1), bool)
    return known[np.lib.stride_tricks.sliding_window_view(gram, WINDOW).argmin(axis=1) + np.arange(len(gram) - WINDOW + 1)]


class Spans:
    """The different spans of m words of the items: a hash, a place where each is spelled, and its items."""

    def __init__(self, text: Text, at: np.ndarray, m: int):
        self.text, self.m = text, m
        item, spelled = text.row[at], {}
        hashes = grams(text.hash, m)[at] if len(at) else np.zeros(0, np.uint64)
        _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        place = at[first]
        # spans that share a hash and are spelled otherwise (made to) are spans of their own
        repeats = np.flatnonzero(at != place[number])
        for r in repeats[~same_words(text, at[repeats], text, place[number[repeats]], m)].tolist():
            known = len(spelled)
            number[r] = len(first) + (n := spelled.setdefault(text.spelled(int(at[r]), m), known))
            if n == known:
                place = np.append(place, at[r])
        pairs = np.unique(np.stack([number, item]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        own = grams(text.hash, m)[place] if len(place) else hashes
        order = np.argsort(own, kind="stable")
        rank = np.argsort(order)
        self.hash, self.place = own[order], place[order]
        span, self.item = rank[pairs[0]], pairs[1]
        again = np.argsort(span, kind="stable")
        self.item = self.item[again]
        self.first = np.searchsorted(span[again], np.arange(len(place) + 1))
        self.most = int(np.unique(self.hash, return_counts=True)[1].max()) if len(self.hash) else 0

    def find(self, doc: Text, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places at which a document has one of the spans, and which."""
        if not len(at) or not len(self.hash):
            return at[:0], at[:0]
        gram = grams(doc.hash, self.m)[at]
        low = np.searchsorted(self.hash, gram)
        out, which = [], []
        for d in range(self.most):  # one, unless spans share a hash
            rows = np.flatnonzero(low + d < len(self.hash))
            rows = rows[self.hash[low[rows] + d] == gram[rows]]
            rows = rows[same_words(doc, at[rows], self.text, self.place[low[rows] + d], self.m)]
            out.append(at[rows])
            which.append(low[rows] + d)
        return np.concatenate(out), np.concatenate(which)


def same_words(one: Text, at: np.ndarray, other: Text, place: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words from each place on are spelled alike in two texts."""
    same = one.hash[at] == other.hash[place]
    for j in range(m):
        rows = np.flatnonzero(same)
        a, b = at[rows] + j, place[rows] + j
        same[rows] = same_bytes(one.low, one.start[a], one.end[a], other.low, other.start[b], other.end[b])
    return same


class Index:
    """The fingerprints of benchmark items, and their spans."""

    def __init__(self, ids: list[str | None], texts: list[str | None]):
        self.ids, self.text = ids, Text(pa.array(texts, pa.large_string()))
        self.hash = np.unique(prints(self.text)[1])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hash & np.uint64(len(self.maybe) - 1)] = True
        long = self.text.windows(SPAN)
        self.long = Spans(self.text, long, SPAN)
        length = np.diff(self.text.first)
        short = [m for m in np.unique(length).tolist() if 0 < m < SPAN]
        self.short = [Spans(self.text, self.text.first[:-1][length == m], m) for m in short]

    def hits(self, doc: Text) -> Iterator[tuple[np.ndarray, int, np.ndarray, Spans]]:
        """(places, number of words, spans, their table) of what documents share with the items."""
        gram = grams(doc.hash, K)
        known = self.maybe[gram & np.uint64(len(self.maybe) - 1)]
        maybe = np.flatnonzero(known)
        known[maybe] = np.isin(gram[maybe], self.hash)
        at = np.flatnonzero(has_print(gram, known))
        at, which = self.long.find(doc, at[doc.row[at] == doc.row[at + SPAN - 1]])
        yield at, SPAN, which, self.long
        for spans in self.short:
            at = doc.windows(spans.m)
            at = at[np.isin(grams(doc.hash, spans.m)[at], spans.hash)]
            at, which = spans.find(doc, at)
            yield at, spans.m, which, spans


_indexes: dict[str, Index] = {}

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, hit_spans array<struct<start:long,end:long>>"


def _judged(ids: pa.Array, text: Text, spans: list[list[tuple[int, int]]], items: list[set[str]]) -> pa.RecordBatch:
    """A row for each document, of its hits' spans (in its own words) and items."""
    spans, names = [joined(x) for x in spans], [sorted(x) for x in items]
    total, hit = np.diff(text.first), np.array([sum(b - a for a, b in x) for x in spans], np.int64)
    shown = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], SPANS)
    columns = [ids, pa.array(total, pa.int64()), pa.array(hit), pa.array([len(x) for x in names], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array((hit > 0) & (20 * hit >= total)), pa.array(names, pa.list_(pa.string())), shown]
    return pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "hit_spans"])


def _looked_up(batches: Iterator[pa.RecordBatch], held, key: str) -> Iterator[pa.RecordBatch]:
    """Documents against a broadcast benchmark."""
    if (index := _indexes.get(key)) is None:
        _indexes.clear()
        index = _indexes.setdefault(key, Index(*held.value))
    for batch in slices(batches, "text"):
        text = Text(batch.column("text"))
        spans: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
        items: list[set[str]] = [set() for _ in range(batch.num_rows)]
        for at, m, which, found in index.hits(text):
            row = text.row[at]
            for r, start in zip(row.tolist(), (at - text.first[row]).tolist(), strict=True):
                spans[r].append((start, start + m))
            for r, x in np.unique(np.stack([row, which]), axis=1).T.tolist():
                items[r].update(index.ids[i] for i in found.item[found.first[x] : found.first[x + 1]].tolist() if index.ids[i] is not None)
        yield _judged(batch.column("id"), text, spans, items)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of the spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# a benchmark beyond the bound: a join of fingerprints

PRINT = "hash long, span binary, key long"


def _digest(text: Text, at: int, m: int) -> bytes:
    return hashlib.blake2b(text.spelled(at, m), digest_size=16).digest()


def _fingerprint(gram: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The fingerprints of the windows from these grams on."""
    return np.lib.stride_tricks.sliding_window_view(gram, WINDOW)[at].min(axis=1) if len(at) else gram[:0]


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different spans of each item: their fingerprint, a digest of their words, the item."""
    for batch in slices(batches, "text"):
        text, key = Text(batch.column("text")), batch.column("key").to_numpy()
        rows: dict[tuple[int, bytes, int], None] = {}
        at = text.windows(SPAN)
        for p, h in zip(at.tolist(), _fingerprint(grams(text.hash, K), at).view(np.int64).tolist(), strict=True):
            rows[h, _digest(text, p, SPAN), int(key[text.row[p]])] = None
        length = np.diff(text.first)
        for i in np.flatnonzero((length > 0) & (length < SPAN)).tolist():
            p, m = int(text.first[i]), int(length[i])
            rows[int(grams(text.hash[p : p + m], m).view(np.int64)[0]), _digest(text, p, m), int(key[i])] = None
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64()))], ["hash", "span", "key"])


def _short_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of words of short items."""
    for batch in slices(batches, "text"):
        length = np.unique(np.diff(Text(batch.column("text")).first))
        yield pa.RecordBatch.from_arrays([pa.array(length[(length > 0) & (length < SPAN)], pa.int64())], ["m"])


def _doc_prints(batches: Iterator[pa.RecordBatch], sketch, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """The different spans of each document, and its runs of as many words as short items have, with all their
    places; of both only those whose hash the sketch may hold."""
    bits: np.ndarray = sketch.value

    def held(hashes: np.ndarray) -> np.ndarray:
        place = (hashes & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
        return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)

    for batch in slices(batches, "text"):
        text, key = Text(batch.column("text")), batch.column("key").to_numpy()
        places: dict[tuple[int, bytes, int, int], list[int]] = defaultdict(list)
        for m in [0, *lengths]:
            if m:
                gram = grams(text.hash, m)
                at = text.windows(m)
                at = at[held(gram[at])]
                hashes = gram[at]
            else:
                gram = grams(text.hash, K)
                at = np.flatnonzero(has_print(gram, held(gram)))
                at = at[text.row[at] == text.row[at + SPAN - 1]]
                hashes = _fingerprint(gram, at)
            for p, h, r in zip(at.tolist(), hashes.view(np.int64).tolist(), text.row[at].tolist(), strict=True):
                places[h, _digest(text, p, m or SPAN), m or SPAN, r].append(p - int(text.first[r]))
        rows = list(places)
        spans = [joined([(p, p + x[2]) for p in places[x]]) for x in rows]
        shown = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], SPANS)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary()), pa.array([int(key[x[3]]) for x in rows], pa.int64()), shown], ["hash", "span", "key", "spans"])


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        spans = [[(y["start"], y["end"]) for y in x or ()] for x in batch.column("spans").to_pylist()]
        yield _judged(batch.column("id"), Text(batch.column("text")), spans, [set(x or ()) for x in batch.column("items").to_pylist()])


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs: id, text; items: item, text. Items with equal text are one in the join. Fingerprint and digest of
    the words are the key, so only spans that are shared meet, one row for each document and different span.
    The sketch of the items' hashes, of a fixed size, spares the shuffle of the others; spans are salted."""
    spark = docs.sparkSession
    docs = written(docs.withColumn("key", F.monotonically_increasing_id()), "documents")
    named = written(items.withColumn("same", F.sha2("text", 256)), "items")
    texts = written(named.groupBy("same").agg(F.first("text").alias("text")).withColumn("key", F.monotonically_increasing_id()), "texts")
    known = written(texts.select("key", "text").mapInArrow(_item_prints, PRINT), "prints")
    bit = F.pmod("hash", F.lit(SKETCH_BITS))
    rows = known.select((bit / 8).cast("int").alias("byte"), F.pow(F.lit(2), bit % 8).cast("int").alias("bits")).groupBy("byte").agg(F.bit_or("bits")).toArrow()
    sketch = np.zeros(SKETCH_BITS >> 3, np.uint8)
    sketch[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    lengths = [r[0] for r in texts.select("text").mapInArrow(_short_lengths, "m long").distinct().collect()]
    spans = "array<struct<start:long,end:long>>"
    found = docs.select("key", "text").mapInArrow(partial(_doc_prints, sketch=spark.sparkContext.broadcast(sketch), lengths=sorted(lengths)), f"{PRINT}, spans {spans}")
    salted = known.select("hash", "span").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = written(found.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "span", "salt"]).drop("salt"), "hits")
    spans = met.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    ids = named.join(texts.select("same", F.col("key").alias("text_key")), "same").filter("item is not null").select(F.col("text_key").alias("item"), F.col("item").alias("item_id"))
    pairs = met.select("key", "hash", "span").join(known.withColumnRenamed("key", "item"), ["hash", "span"]).select("key", "item").distinct()
    names = pairs.join(ids, "item").groupBy("key").agg(F.collect_set("item_id").alias("items"))
    whole = docs.join(spans, "key", "left").join(names, "key", "left").select("id", "text", "spans", "items")
    return whole.mapInArrow(_put_together, with_id(docs, "id", SCHEMA))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each document: n_words, n_hit (words inside a shared span of SPAN words, or a whole shorter
    item), n_items and item_ids (items so found), items_sha256 (of the ids, sorted and comma-joined),
    contaminated (a word in 20 is hit, at least), and hit_spans (word positions).

    A benchmark of at most BROADCAST_BYTES goes to every executor; of a larger one the fingerprints are
    joined with those of the documents."""
    docs_ = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16)).first()[0] or 0
    if size > BROADCAST_BYTES:
        return _joined(docs_, items).withColumnRenamed("id", id_col)
    held = docs.sparkSession.sparkContext.broadcast(tuple(x.to_pylist() for x in items.toArrow().columns))
    return docs_.mapInArrow(partial(_looked_up, held=held, key=uuid.uuid4().hex), with_id(docs, id_col, SCHEMA)).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (all columns) that are not contaminated."""
    kept = docs.select(F.struct(*docs.columns).alias("row_"), F.col("text").alias("text_"))
    return find_contamination(kept, benchmark, "row_", "text_").filter("not contaminated").select("row_.*")
