"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

1. Every text becomes the sorted set of its shingles' 64-bit hashes. Texts with equal sets are one class
   from here on. A class keeps its size, a bitmap signature (each hash sets one bit; the width follows
   the size band) and the prefix of its set: two sets this similar share a hash among the first
   size - least overlap + 1, in any order that is the same for all. Hashes that are common in a bounded
   sample come last in that order, which spares work and changes no result.
2. Classes that share a prefix hash meet in its tiles, by blocks of TILE. There, sorted by size, only
   neighbours within the size band are compared, and the bit counts of their signatures bound their
   overlap from above. Pairs that pass join the tile's classes to a forest, so that a tile of many
   copies gives one link for each and not every pair.
3. The components of these links hold every similar pair. Each is dealt into blocks of BLOCK classes;
   their sets are made from the texts once more, and bounds and then exact intersections of the sorted
   arrays decide. Pairs of blocks follow only where a component still has classes apart, and only for
   the classes outside its largest part.
4. The components of the exact links are the result. Comparisons within what is already joined are left
   out; no link between two parts is.

Defined cases: null, empty and wordless texts have an empty set, link with nothing and are their own
component; a null id is its own component's smallest unless another member has an id; rows that repeat
an id, or a text, keep their own rows; an empty table gives an empty result. Other input columns are not
carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import concluded, keyed_grams, new_keys, partitions_for, sample_below, slices, unused, utf8, with_id, words, written
from .components import components

IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Classes of one shared hash that are compared in one tile, and classes whose sets meet in one block.
TILE, BLOCK = 512, 256
#: Tile rows in one shuffle partition, about.
PARTITION_ROWS = 1_000_000
#: The sample for the order of hashes: documents, and common hashes kept.
SAMPLE_DOCS, COMMON_HASHES = 32_000, 250_000
#: Hashes seen in so many of the sample's documents are dealt to tiles by blocks from the start.
HOT = 8


def shingles(texts: pa.Array, keys: tuple[int, ...]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text, under the job's keys, one for each word of a shingle;
    texts of fewer words are one shingle."""
    k = len(keys)
    word, _, _, row = words(*utf8(texts), IS_WORD)
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    gram = keyed_grams(word, k, keys)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(gram[a : b - k + 1]))
        else:
            out.append(keyed_grams(word[a:b], b - a, keys) if b > a else gram[:0])
    return out


def width(n: int) -> int:
    """Bits of a signature: a power of two, 1 to 2 for each shingle."""
    return max(64, 1 << (n - 1).bit_length())


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The signature as 64-bit words. Folding its halves together gives that of half the width."""
    bits = np.zeros(width(len(hashes)), bool)
    bits[hashes & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def least_overlap(a, b, num: int, den: int):
    """Shingles that sets of these sizes share at least if num/den of their union is shared."""
    return -(-(num * (a + b)) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


class Forest:
    """Union-find over the rows of a tile."""

    def __init__(self, label: np.ndarray):
        self.label = label

    def join(self, i: int, others: np.ndarray) -> list[int]:
        """Joins row i with the others; returns those that were apart from it, one for each part."""
        new = []
        for j in others.tolist():
            if self.label[j] != self.label[i]:
                new.append(j)
                self.label[self.label == self.label[j]] = self.label[i]
        return new


def _signatures(batches: Iterator[pa.RecordBatch], keys: tuple[int, ...], num: int, den: int, common) -> Iterator[pa.RecordBatch]:
    ranked, _ = common.value
    for batch in slices(batches, "text"):
        sizes, digests, short, bitmaps, prefixes = [], [], [], [], []
        for hashes in shingles(batch.column("text"), keys):
            digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
            sizes.append(len(hashes))
            digests.append(digest)
            short.append(int.from_bytes(digest[:8], "little", signed=True))
            bitmaps.append(bitmap(hashes).tobytes() if len(hashes) else b"")
            n = prefix_length(len(hashes), num, den) if len(hashes) else 0
            if len(ranked) and n:
                at = np.minimum(np.searchsorted(ranked, hashes), len(ranked) - 1)
                usual = ranked[at] == hashes
                hashes = np.concatenate([hashes[~usual][:n], hashes[usual][: max(0, n - int((~usual).sum()))]])
            prefixes.append(hashes[:n].view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("seal"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(short, pa.int64()), pa.array(bitmaps, pa.binary()), lists], ["id", "seal", "n", "digest", "key", "bits", "prefix"])


def _shingle_rows(batches: Iterator[pa.RecordBatch], keys: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *shingles(batch.column("text"), keys)]).view(np.int64))], ["hash"])


def common_hashes(docs: DataFrame, keys: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that several documents of a bounded sample share, sorted, and those that many share. Of more
    than COMMON_HASHES the rarer counts are left out, as they come."""
    sample = sample_below(docs, "id", SAMPLE_DOCS).select("text").distinct()
    counts = written(sample.mapInArrow(partial(_shingle_rows, keys=keys), "hash long").groupBy("hash").count().filter("count > 1"), "common")
    least, held = HOT, 0
    for count, n in counts.groupBy(F.least("count", F.lit(HOT)).alias("c")).agg(F.count("*")).orderBy(F.desc("c")).collect():
        held += n
        if held > COMMON_HASHES:
            break
        least = count
    if held > COMMON_HASHES and least == HOT:
        counts = counts.orderBy(F.desc("count"), "hash").limit(COMMON_HASHES)
    found = counts.filter(F.col("count") >= least).toPandas().to_numpy(np.int64)
    return np.sort(found[:, 0].view(np.uint64)), np.sort(found[found[:, 1] >= HOT, 0].view(np.uint64))


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each group, one group at a time; rows come sorted by the names."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in names])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = tuple(keys[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _pairs(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the hashes that a few classes share, and the rows of the others. A pair is left out where
    its sizes are too far apart, or where, were this the first hash that both have, too few would follow
    it in one of them; the pair then meets at its first one, or is not similar."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    hashes, key, n, place = (table.column(x).to_numpy() for x in ("hash", "key", "n", "place"))
    order = np.lexsort((key, n, hashes))
    hashes, key, n, rest = hashes[order], key[order], n[order], (n - place)[order]
    cuts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    count = np.diff(np.append(cuts, len(hashes)))
    count = np.repeat(count, count)
    few = count <= FEW
    found = []
    for d in range(1, FEW):
        i = np.flatnonzero((hashes[d:] == hashes[:-d]) & few[d:] & (den * n[:-d] >= num * n[d:]) & (key[d:] != key[:-d]) & (np.minimum(rest[d:], rest[:-d]) >= least_overlap(n[d:], n[:-d], num, den))) if len(key) > d else np.zeros(0, int)
        found.append(np.stack([np.minimum(key[i], key[i + d]), np.maximum(key[i], key[i + d])]))
    found = np.unique(np.concatenate(found, axis=1), axis=1)
    none = np.zeros(found.shape[1], np.int64)
    many = np.flatnonzero(~few)
    for a, b, h, size in ((found[0], found[1], none, none), (key[many], key[many], hashes[many], n[many])):
        for at in range(0, len(a), 1 << 18):
            x = slice(at, at + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(a[x]), pa.array(b[x]), pa.array(h[x]), pa.array(size[x])], ["a", "b", "hash", "n"])


#: A hash that so many classes share at most gives all its pairs; beyond, tiles.
FEW = 8


def ones(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


def folded(bits: np.ndarray, words64: int) -> np.ndarray:
    """Signatures (one in each row) at a smaller width."""
    while bits.shape[1] > words64:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class Tile:
    """Classes in order of size, with their signatures."""

    def __init__(self, n: np.ndarray, bits: list[np.ndarray]):
        self.n = n
        self.bits = bits
        self.wide = np.array([len(x) for x in bits])

    def bound(self, i: int, others: np.ndarray) -> np.ndarray:
        """An upper bound on the overlap of row i with each of the others: what only one of the two has
        is at least the bits that the other lacks."""
        out = np.zeros(len(others), np.int64)
        for size in np.unique(self.wide[others]).tolist():
            at = np.flatnonzero(self.wide[others] == size)
            least = min(size, len(self.bits[i]))
            theirs = folded(np.stack([self.bits[j] for j in others[at].tolist()]), least)
            own = folded(self.bits[i][None, :], least)
            out[at] = np.minimum(self.n[i] - ones(own & ~theirs), self.n[others[at]] - ones(theirs & ~own))
        return out

    def passing(self, i: int, others: np.ndarray, num: int, den: int) -> np.ndarray:
        return others[self.bound(i, others) >= least_overlap(self.n[i], self.n[others], num, den)] if len(others) else others


def _tiles(batches: Iterator[pa.RecordBatch], names: list[str], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The forest of pairs that pass the bounds, of each tile; with a column `label`, between what has
    other labels, one of the two a straggler."""
    for table in _groups(batches, names):
        key, n = (table.column(x).to_numpy() for x in ("key", "n"))
        order = np.lexsort((key, n))
        bits = table.column("bits").to_pylist()
        forest, straggler = _apart(table, key, order)
        key, n = key[order], n[order]
        tile = Tile(n, [np.frombuffer(bits[x], np.uint64) for x in order])
        ends = np.searchsorted(num * n, den * n, "right")
        found = []
        for i in range(len(key)):
            others = np.arange(i + 1, ends[i])
            others = others[(forest.label[others] != forest.label[i]) & (straggler[others] | straggler[i])]
            found += [(key[i], key[j]) for j in forest.join(i, tile.passing(i, others, num, den))]
        if found:
            a, b = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _apart(table: pa.Table, own: list, order: np.ndarray) -> tuple[Forest, np.ndarray]:
    """What is joined at the outset, and which rows are compared with all others."""
    if "label" not in table.column_names:
        return Forest(np.unique(own, return_inverse=True)[1][order]), np.ones(len(order), bool)
    label = np.unique(table.column("label").to_pylist(), return_inverse=True)[1]
    return Forest(label[order]), table.column("straggler").to_numpy().astype(bool)[order]


def _bounded(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures allow them to be similar."""
    for batch in batches:
        sizes = [pa.compute.binary_length(batch.column(x)).to_numpy(zero_copy_only=False) // 8 for x in ("bits_a", "bits_b")]
        na, nb = (batch.column(x).to_numpy() for x in ("na", "nb"))
        keep = np.zeros(batch.num_rows, bool)
        for wa, wb in np.unique(np.stack(sizes), axis=1).T.tolist():
            rows = np.flatnonzero((sizes[0] == wa) & (sizes[1] == wb))
            a, b = (np.frombuffer(b"".join(batch.column(x).take(pa.array(rows)).to_pylist()), np.uint64).reshape(len(rows), w) for x, w in (("bits_a", wa), ("bits_b", wb)))
            a, b = folded(a, min(wa, wb)), folded(b, min(wa, wb))
            most = np.minimum(na[rows] - ones(a & ~b), nb[rows] - ones(b & ~a))
            keep[rows] = most >= least_overlap(na[rows], nb[rows], num, den)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _sets(batches: Iterator[pa.RecordBatch], keys: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The sets of the texts that belong to the classes they were joined to."""
    for batch in slices(batches, "text"):
        found = shingles(batch.column("text"), keys)
        right = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() == d for x, d in zip(found, batch.column("digest").to_pylist(), strict=True)]
        out = pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("part"), batch.column("block"), pa.array([x.tobytes() for x in found], pa.binary())], ["digest", "part", "block", "hashes"])
        yield out.filter(pa.array(right, pa.bool_()))


def _once(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Without rows that repeat the one before in all of these columns."""
    last = None
    for batch in batches:
        keep = []
        for row in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            keep.append(row != last)
            last = row
        yield batch.filter(pa.array(keep, pa.bool_()))


def _exact(batches: Iterator[pa.RecordBatch], names: list[str], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The forest of exact links within each block, told apart as in _tiles."""
    for table in _groups(batches, names):
        digest = table.column("digest").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        n = np.array([len(x) for x in sets])
        order = np.lexsort((np.unique(digest, return_inverse=True)[1], n))
        forest, straggler = _apart(table, digest, order)
        n, sets, digest = n[order], [sets[x] for x in order], [digest[x] for x in order]
        tile = Tile(n, [bitmap(x) for x in sets])
        ends = np.searchsorted(num * n, den * n, "right")
        found = []
        for i in range(len(n)):
            others = np.arange(i + 1, ends[i])
            others = others[(forest.label[others] != forest.label[i]) & (straggler[others] | straggler[i])]
            for j in tile.passing(i, others, num, den).tolist():
                if forest.label[j] != forest.label[i]:
                    shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if den * shared >= num * (n[i] + n[j] - shared):
                        forest.join(i, np.array([j]))
                        found.append((digest[i], digest[j]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], ["a", "b"])


def _prefix_rows(batches: Iterator[pa.RecordBatch], common) -> Iterator[pa.RecordBatch]:
    """A row for each hash of a class's prefix: its place there, and whether it is hot."""
    _, hot = common.value
    for batch in batches:
        lists = batch.column("prefix")
        hashes = lists.flatten().to_numpy(zero_copy_only=False)
        length = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(length) - length, length)
        row = pa.array(np.repeat(np.arange(batch.num_rows), length))
        yield pa.RecordBatch.from_arrays([pa.array(hashes), batch.column("key").take(row), batch.column("n").take(row), pa.array(place.astype(np.int32)), pa.array(np.isin(hashes.view(np.uint64), hot))], ["hash", "key", "n", "place", "hot"])


def dealt(rows: DataFrame, names: list[str], *more: str) -> DataFrame:
    """Rows with equal names in one partition, one after another."""
    return rows.repartition(partitions_for(rows.sparkSession, 0, 1), *names).sortWithinPartitions(*names, *more)


def crossing(rows: DataFrame, group: str, key: str, size: int) -> DataFrame:
    """Tiles (group, block, chunk) in which every row of a group outside its largest label meets every
    row of the group: `straggler` marks the first. Groups of one label have none. rows: a column `label`."""
    by_label = rows.groupBy(group, "label").count()
    about = by_label.groupBy(group).agg(F.max(F.struct("count", "label")).alias("main"), F.sum("count").alias("all"), F.count("*").alias("labels")).filter("labels > 1")
    about = about.select(group, F.col("main.label").alias("main"), F.ceil(F.col("all") / size).alias("blocks"), F.ceil((F.col("all") - F.col("main.count")) / size).alias("chunks"))
    placed = rows.drop("block").join(about, group).withColumn("block", F.pmod(F.xxhash64(key), "blocks")).withColumn("chunk", F.pmod(F.xxhash64(key, F.lit(1)), "chunks")).withColumn("straggler", F.col("label") != F.col("main"))
    every = placed.withColumn("straggler", F.lit(False)).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    few = placed.filter("straggler").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return every.unionByName(few).drop("main", "blocks", "chunks")


def _candidates(nodes: DataFrame, common, num: int, den: int) -> DataFrame:
    """Links (a, b) between keys, whose components hold every similar pair of classes."""
    spark = nodes.sparkSession
    rows = nodes.select("key", "n", "prefix").mapInArrow(partial(_prefix_rows, common=common), "hash long, key long, n long, place int, hot boolean")
    total = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    met = written(rows.filter("not hot").select("hash", "key", "n", "place").repartition(partitions_for(spark, total, PARTITION_ROWS), "hash").mapInArrow(partial(_pairs, num=num, den=den), "a long, b long, hash long, n long"), "met")
    bits = nodes.select("key", "n", "bits")
    pairs = met.filter("a != b").select("a", "b").distinct()
    pairs = pairs.join(bits.toDF("a", "na", "bits_a"), "a").join(bits.toDF("b", "nb", "bits_b"), "b").mapInArrow(partial(_bounded, num=num, den=den), "a long, b long")

    shared = met.filter("a = b").select("hash", F.col("a").alias("key")).union(rows.filter("hot").select("hash", "key"))
    blocks = shared.groupBy("hash").agg(F.ceil(F.count("*") / TILE).alias("blocks"), F.count("*").alias("all")).filter("`all` > 1")
    placed = written(shared.join(blocks, "hash").select("hash", "key", "blocks", F.pmod(F.xxhash64("key", "hash"), "blocks").alias("block")), "tiles")
    names = ["hash", "block"]
    links = written(pairs.union(dealt(placed.join(bits, "key"), names).mapInArrow(partial(_tiles, names=names, num=num, den=den), "a long, b long")), "candidates")
    large = placed.filter("blocks > 1").drop("blocks")
    if not large.limit(1).count():
        return links
    labels = components(links)
    labelled = large.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    names = ["hash", "block", "chunk"]
    tiles = dealt(crossing(labelled, "hash", "key", TILE).join(bits, "key"), names)
    return links.union(written(tiles.mapInArrow(partial(_tiles, names=names, num=num, den=den), "a long, b long"), "candidates"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """id, n_shingles (k-word shingles of the text, distinct) and component_id of every row: the smallest
    id that links lead to. Two rows link when their sets share num/den of their union, at least."""
    spark, keys = docs.sparkSession, new_keys(k)
    # the seal tells rows of one id (or none) apart when a class's text is read again
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("seal"))
    common = spark.sparkContext.broadcast(common_hashes(texts, keys))
    rows = written(texts.mapInArrow(partial(_signatures, keys=keys, num=num, den=den, common=common), with_id(docs, id_col, "seal long, n long, digest binary, key long, bits binary, prefix array<long>")), "signatures")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "seal")).alias("rep")
    nodes = rows.filter("n > 0").groupBy("digest").agg(least, *(F.first(c).alias(c) for c in ("n", "key", "bits", "prefix")))
    nodes = written(nodes.select("digest", F.col("rep.id").alias("rep"), F.col("rep.seal").alias("seal"), "n", "key", "bits", "prefix"), "classes")

    parts = components(_candidates(nodes, common, num, den)).withColumnRenamed("node", "key").withColumnRenamed("label", "part")
    size = parts.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = written(nodes.select("digest", "rep", "seal", "key").join(parts, "key").join(size, "part").select("digest", "rep", "seal", "part", "blocks", F.pmod(F.xxhash64("digest"), "blocks").alias("block")), "members")
    own = members.select("digest", "rep", "seal", "part", "block")
    wanted = texts.join(own, texts["id"].eqNullSafe(own["rep"]) & (texts["seal"] == own["seal"])).select("text", "digest", "part", "block")
    sets = written(wanted.mapInArrow(partial(_sets, keys=keys), "digest binary, part long, block long, hashes binary"), "sets")
    names = ["part", "block"]
    links = written(_linked(dealt(sets, names, "digest"), names, num, den), "links")
    labels = components(links)
    large = members.filter("blocks > 1").select("digest")
    if large.limit(1).count():
        labelled = sets.join(large, "digest", "left_semi").join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
        names = ["part", "block", "chunk"]
        labels = components(links.union(written(_linked(dealt(crossing(labelled, "part", "digest", BLOCK), names, "straggler", "digest"), names, num, den), "links")))

    classes = nodes.select("digest", "rep").join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    found = classes.join(classes.groupBy("label").agg(F.min("rep").alias("least")), "label").select("digest", "least")
    out = rows.select("id", "n", "digest").join(found, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _linked(rows: DataFrame, names: list[str], num: int, den: int) -> DataFrame:
    same = [*names, *(x for x in ("straggler",) if x in rows.columns), "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _exact(_once(batches, same), names, num, den)

    return rows.mapInArrow(run, "a binary, b binary")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row (all columns) of each component: that with the smallest id, of rows that share it any one;
    a null id comes after all others. Rows without shingles stay. Near-duplicates share 0.8 of their
    five-word shingles by default.

    The join runs on keys of the rows of a written table, so repeated and null ids are rows like others. The rows to
    leave out are written by their keys, and the join's tables deleted, before the texts are read once more."""
    row = unused("row_", docs.columns)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows", compression="zstd")
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))

    def copies() -> DataFrame:
        found = jaccard_components(rows.select(key.alias("id"), F.col(text_col).alias("text")), "id", "text", k, num, den)
        return found.filter((F.col("n_shingles") > 0) & (F.col("id.row") != F.col("component_id.row"))).select(F.col("id.row").alias(row))

    return rows.join(concluded(docs.sparkSession, copies, "copies"), row, "left_anti").drop(row)
