"""Periodic runs in texts: stretches of words that repeat with a period, found by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q, at least max(LEAST, TIMES * q) words long,
that no neighbouring word extends. In the words of one text:

1. Periods up to SHORT: the words are compared with themselves at each such lag.
2. Longer periods, by scales of q0 < q <= q0 * 3/2. A gram has as many words as the largest period of the
   scale, so equal grams within a run lie a multiple of its period apart. The smallest gram (in a fixed
   pseudo-random order) of each window of consecutive grams is kept. Windows are as wide as lets every run
   of the scale hold a window and its copy one period on, so each run keeps two equal grams, one period
   apart, with no equal one kept between them.
3. Each pair of neighbouring equal kept grams whose distance is in the scale seeds a run, unless a run of
   that period covers it. It is extended word by word to both sides; its length and whether a divisor of
   the distance is a period too decide.

Grams are told apart by exact ranks (a gram of 2n words by the ranks of its two halves), so no run is
missed by a hash. A text in which no gram of a scale repeats is done with.

Every text stands alone: no shuffle, and the memory of a task follows its longest text.

Defined cases: null, empty and wordless texts have no runs and an empty collapsed text; a null or repeated
id is a row like others; an empty table gives an empty result. Other input columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, slices, with_id

#: Shortest run in words, and in periods. The scales of step 2 rest on three periods.
LEAST, TIMES = 24, 3
#: Periods that are found by comparing at every lag.
SHORT = 8
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers of the words: equal for equal ones."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading elements are the same, looked at in blocks of growing size."""
    at, step = 0, 64
    while at < len(x):
        apart = np.flatnonzero(x[at : at + step] != y[at : at + step])
        if len(apart):
            return at + int(apart[0])
        at, step = at + step, 2 * step
    return len(x)


def _is_smallest(ids: np.ndarray, start: int, q: int) -> bool:
    """Whether no divisor of q is a period of the run, too."""
    rest, f = q, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            if np.array_equal(ids[start : start + q], ids[start + q // f : start + q // f + q]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def _sliding(x: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """The pick (minimum or maximum) of each w consecutive elements."""
    width = 1
    while 2 * width <= w:
        x, width = pick(x[:-width], x[width:]), 2 * width
    return pick(x[: len(x) - (w - width)], x[w - width :]) if w > width else x


def _kept_grams(gram: np.ndarray, w: int) -> np.ndarray:
    """Positions that are smallest in some window of w."""
    if len(gram) < w:
        return np.zeros(0, np.int64)
    least = _sliding(gram, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), w, np.maximum) == gram)


def _short_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, min(SHORT, len(ids) // TIMES) + 1):
        same = np.zeros(len(ids) - q + 2, np.int8)
        same[1:-1] = ids[q:] == ids[:-q]
        edges = np.flatnonzero(np.diff(same))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= max(LEAST, TIMES * q) - q
        found += [(s, e - s + q, q) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True) if _is_smallest(ids, s, q)]
    return found


def _seeded_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    n, found = len(ids), []
    rank, size, q0 = ids, 1, SHORT
    while TIMES * (q0 + 1) <= n:
        top = min(q0 + q0 // 2, n // TIMES)
        while 2 * size <= top:
            values, rank = np.unique(rank[:-size] * n + rank[size:], return_inverse=True)
            if len(values) == len(rank):  # no gram repeats, so no longer one does
                return found
            size *= 2
        last = len(ids) - top + 1
        gram = mixed((rank[:last] * n + rank[top - size : top - size + last]).view(np.uint64))
        at = _kept_grams(gram, (TIMES - 1) * (q0 + 1) + 1 - top)
        at = at[np.argsort(gram[at], kind="stable")]
        apart = np.diff(at)
        seed = np.flatnonzero((gram[at[1:]] == gram[at[:-1]]) & (apart > q0) & (apart <= top))
        seed = seed[np.lexsort((at[seed], apart[seed]))]
        covered = (0, 0)
        for p, q in zip(at[seed].tolist(), apart[seed].tolist(), strict=True):
            if covered[0] == q and p < covered[1]:
                continue
            end = p + _agreeing(ids[p : n - q], ids[p + q :])
            start = p - _agreeing(ids[:p][::-1], ids[q : p + q][::-1])
            covered = (q, end)
            if end - start + q >= max(LEAST, TIMES * q) and _is_smallest(ids, start, q):
                found.append((start, end - start + q, q))
        q0 = top if top < n // TIMES else n
    return found


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one text's word numbers, by start, then period."""
    return sorted(_short_runs(ids) + _seeded_runs(ids)) if len(ids) >= LEAST else []


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: a run's words after its first period go."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equal ones the first."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("start", "length", "period")
    for batch in slices(batches, "text"):
        counts, runs, best, collapsed = [], [], [], []
        for text in batch.column("text").to_pylist():
            words = (text or "").encode().split()  # of bytes: at blanks and \t to \r alone
            own = runs_of(word_ids(words))
            if own:
                words = [w for w, keep in zip(words, kept_words(len(words), own).tolist(), strict=True) if keep]
            counts.append(len(own))
            runs.append([dict(zip(names, r, strict=True)) for r in own])
            best.append(dict(zip(names, best_run(own), strict=True)) if own else None)
            collapsed.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(best, RUN), pa.array(collapsed, pa.string())], ["id", "n_runs", "runs", "best", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_runs, runs (structs of start, length and period in words), best (the run of most periods, null
    without runs) and collapsed (the words that stay, joined by one space) of every row."""
    run = "struct<start: long, length: long, period: long>"
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_found, with_id(docs, id_col, f"n_runs long, runs array<{run}>, best {run}, collapsed string"))
    return found.withColumnRenamed("id", id_col)
