"""Periodic runs against a plain search of every lag, in word numbers and through the query."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from logweir.llm import periodic
from logweir.llm.queries import op13_periodic_runs
from tests.llm.test_operators import ODD, SF, frame, none, odd  # noqa: F401


def plain_runs(words):
    """Every lag on its own, and every smaller period tried."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q):
                own = words[i : i + length]
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out)


def repeated(draw_from, n, changes):
    """Words with stretches copied from some distance before."""
    words = [draw_from.randrange(draw_from.choice([1, 2, 3, 60])) for _ in range(n)]
    for _ in range(changes):
        a, p = draw_from.randrange(n), draw_from.randrange(1, n // 2)
        for i in range(a + p, min(n, a + int(p * draw_from.uniform(1.5, 6)))):
            words[i] = words[i - p]
    return words


def test_runs_of_words():
    r = random.Random(3)
    found = 0
    for _ in range(900):
        words = repeated(r, r.choice([23, 24, 25, 60, 130, 250]), r.randrange(5))
        got = periodic.runs_of(np.array(words, np.int64))
        assert got == plain_runs(words)
        found += sum(q > periodic.SHORT for _, _, q in got)
    assert found > 50


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=30).flatmap(lambda x: st.integers(1, 7).map(lambda k: x * k)), max_size=6))
def test_runs_of_any_words(parts):
    words = [x for part in parts for x in part]
    assert periodic.runs_of(np.array(words, np.int64)) == plain_runs(words)


def test_long_texts_take_little_time():
    r = random.Random(5)
    period = [r.randrange(900) for _ in range(41_000)]
    words = [r.randrange(900) for _ in range(77)] + (period * 5)[:170_001] + [-1, *[7] * 30]
    assert periodic.runs_of(np.array(words, np.int64)) == [(77, 170_001, 41_000), (len(words) - 30, 30, 1)]
    assert periodic.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]


def plain_row(doc_id, text):
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g, words = h // 10, (text or "").encode().split()
    if h % 10 == 0 and words:
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None, None, None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines, kept = "".join(f"{s},{length},{q}\n" for s, length, q in runs), b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [None, "", " \n", "x " * 60, "a b c d e f g h i j k " * 9 + "a b", "é\x1f\xa0日 " * 40, "tick\x0btock\x0c" * 30]
    docs.filter("n_chars < 4000").select("doc_id", "text").union(spark.createDataFrame([(-i, t) for i, t in enumerate(extra, 1)] + [(None, "x " * 60), (-4, extra[3])], "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    got = [tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(str(plain_row(*r)) for r in rows)
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_rows(spark, odd, none):  # noqa: F811
    found = periodic.find_runs(odd)
    rows = found.collect()
    assert found.columns == ["doc_id", "n_runs", "runs", "best", "collapsed"] and len(rows) == len(ODD) + 3
    by = {r.doc_id: r for r in rows}
    assert tuple(by[6].best) == (0, 30_000, 1) and by[6].collapsed == "word" and by[0].n_runs == 0 and by[0].best is None and by[0].collapsed == ""
    assert periodic.find_runs(none).count() == 0
    texts = frame(spark, ["b a " * 20]).select("text", "label", "key")
    assert periodic.find_runs(texts, "key", "text").first().collapsed == "b a"
