"""Language identification by words first, backing off to character n-grams.

Training counts words by language over a bounded sample of labelled documents, in Spark, and the
n-grams of these words; the model keeps all of them. A word that the model knows scores its smoothed log
frequency in each language. An unseen word is scored from its character n-grams: from each place on the
longest n-gram that the model knows, from MAX_GRAM characters down to one, each step down costing BACKOFF.
The score of a text is the sum over its words; the probability of the best language among all, tempered
by the number of words, is the confidence. Words are runs of letters of any script.

Defined cases: null or letterless text is `und` with score 0; ties go to the first language by name;
with no labelled row every text is `und`; repeated rows are judged one by one. Other input columns are
not carried.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_below, slices, with_id, written

#: The bound of the fit: labelled documents in the sample, about.
SAMPLE_DOCS = 5_000
MAX_GRAM, BACKOFF = 4, math.log(0.4)
#: Longest word that n-grams are taken of; what is beyond it is scored as a further word.
MAX_WORD = 40
MAX_CACHED = 200_000


#: Runs of letters, and of numerals that are no digits, which tokens() takes out.
WORD = re.compile(rf"[^\W\d_]{{1,{MAX_WORD}}}")


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]  # row in word_logs: log frequency in each language
    word_logs: np.ndarray
    grams: dict[str, int]  # row in gram_logs
    gram_logs: np.ndarray  # row 0: of a character that no n-gram has
    key: str = ""  # tells models apart, where scores are kept


class Backoff:
    """Scores of unseen words from the model's n-grams, many words at a time. The n-grams are a tree: in the
    table of each length, the number of an n-gram's head times the number of characters, and its last one."""

    def __init__(self, model: Model):
        self.logs = model.gram_logs
        names = sorted({g[:n] for g in model.grams for n in range(1, len(g) + 1)})
        self.chars = np.unique(np.array([ord(c) for x in names for c in x], np.int64))
        number = {chr(c): i for i, c in enumerate(self.chars.tolist())}
        self.keys, self.rows, head = [], [], {"": 0}
        for n in range(1, MAX_GRAM + 1):
            mine = sorted((head[x[:-1]] * len(number) + number[x[-1]], x) for x in names if len(x) == n)
            head = {x: i for i, (_, x) in enumerate(mine)}
            self.keys.append(np.array([k for k, _ in mine], np.int64))
            self.rows.append(np.array([model.grams.get(x, -1) for _, x in mine], np.int64))

    def scores(self, words: list[str]) -> np.ndarray:
        """N-grams overlap, so each counts for a part."""
        end = np.cumsum([len(w) + 2 for w in words])
        first = np.append(0, end[:-1])
        given = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4")
        char = np.minimum(np.searchsorted(self.chars, given), max(0, len(self.chars) - 1))
        char = np.where(self.chars[char] == given, char, -1) if len(self.chars) else np.full(len(given), -1)
        left = np.repeat(end, end - first) - np.arange(len(given))
        row, longest = np.zeros(len(given), np.int64), np.zeros(len(given), np.int64)
        at, head = np.arange(len(given)), np.zeros(len(given), np.int64)
        for n, (keys, rows) in enumerate(zip(self.keys, self.rows, strict=True), 1):
            some = left[at] >= n
            at, head = at[some], head[some]
            last = char[at + n - 1]
            key = head * len(self.chars) + last
            found = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            known = (last >= 0) & (keys[found] == key) if len(keys) else np.zeros(len(at), bool)
            at, head = at[known], found[known]
            held = rows[head] >= 0
            row[at[held]], longest[at[held]] = rows[head[held]], n
        # a word's end cuts n-grams short at no cost
        steps = np.where(longest == np.minimum(left, MAX_GRAM), 0, MAX_GRAM - longest)
        return (np.add.reduceat(self.logs[row], first) + np.add.reduceat(steps, first)[:, None] * BACKOFF) / MAX_GRAM


class Scorer:
    """Scores of words: the model's, and those of unseen words, MAX_CACHED of them at the most."""

    def __init__(self, model: Model):
        self.model, self.backoff = model, Backoff(model)
        self._reset()

    def _reset(self) -> None:
        self.unseen: dict[str, int] = {}
        self.scores = np.zeros((len(self.model.words) + (1 << 12), len(self.model.languages)))
        self.scores[: len(self.model.words)] = self.model.word_logs

    def rows(self, words: list[str]) -> np.ndarray:
        """The row in `scores` of each word."""
        known = self.model.words
        numbers = list(map(known.get, words))
        if None in numbers:
            if len(self.unseen) > MAX_CACHED:
                self._reset()
            unseen, size = self.unseen, len(known)
            if new := list(dict.fromkeys(w for w, x in zip(words, numbers, strict=True) if x is None and w not in unseen)):
                start = size + len(unseen)
                if start + len(new) > len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros((max(len(new), start >> 1), self.scores.shape[1]))])
                self.scores[start : start + len(new)] = self.backoff.scores(new)
                unseen.update(zip(new, range(start, start + len(new)), strict=True))
            numbers = [unseen[w] if x is None else x for w, x in zip(words, numbers, strict=True)]
        return np.array(numbers, np.int64)


_scorers: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """The scorer that this process has for the model; it keeps the last model's alone."""
    if model.key not in _scorers:
        _scorers.clear()
        _scorers[model.key] = Scorer(model)
    return _scorers[model.key]


def tokens(text: str) -> list[str]:
    low = text.lower()
    found = WORD.findall(low)
    if not low.isascii() and not all(map(str.isalpha, found)):
        found = WORD.findall("".join(c if c.isalpha() else " " for c in low))
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in slices(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.update((lang, x) for x in tokens(text or ""))
        if len(held) > MAX_CACHED:
            yield _rows(held)
            held.clear()
    yield _rows(held)


def _rows(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["lang", "word", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of counted words, with a mark at either end."""
    held: Counter = Counter()
    for batch in batches:
        for lang, word, n in zip(*(batch.column(x).to_pylist() for x in ("lang", "word", "n")), strict=True):
            padded = f"<{word}>"
            for size in range(1, MAX_GRAM + 1):
                for i in range(len(padded) - size + 1):
                    held[lang, padded[i : i + size]] += n
            if len(held) > MAX_CACHED:
                yield _rows(held)
                held.clear()
    yield _rows(held)


def logs(keys: list[str], langs: list[str], counts: list[int], languages: list[str], groups: list[int]) -> tuple[dict[str, int], np.ndarray]:
    """A number for each key, and its smoothed log frequency in each language among the keys of its group.
    What a key lacks in a language counts the same in each, so that a rare key speaks for where it was seen."""
    number: dict[str, int] = {}
    at = np.array([number.setdefault(x, len(number)) for x in keys], np.int64)
    column = np.searchsorted(languages, langs)
    table, group = np.zeros((len(number), len(languages))), np.zeros(len(number), np.int64)
    table[at, column], group[at] = counts, groups
    size = np.zeros((max(groups, default=0) + 1, len(languages)))
    np.add.at(size, (groups, column), counts)
    return number, np.log(table / np.maximum(size, 1)[group] + 0.5 / np.maximum(size.sum(axis=1), 1)[group, None])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of the labelled documents (lang not null); at most about sample_docs of them are read, and
    every word and n-gram of these is kept."""
    labelled = docs.filter(F.col(lang_col).isNotNull()).select(F.col(key_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sample = sample_below(labelled, "key", sample_docs).select("lang", "text")
    counts = written(sample.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    grams = counts.mapInArrow(_cut, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = [[x.to_pylist() for x in df.select("word", "lang", "n").toArrow().columns] for df in (counts, grams)]
    languages = sorted(set(found[0][1]))
    words, word_logs = logs(*found[0], languages, [0] * len(found[0][0]))
    number, gram_logs = logs(*found[1], languages, [len(x) - 1 for x in found[1][0]])
    unknown = np.full((1, len(languages)), math.log(1e-7))
    return Model(languages, words, word_logs, {k: v + 1 for k, v in number.items()}, np.concatenate([unknown, gram_logs]), uuid.uuid4().hex)


def _predicted(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    scores = scorer(model)
    for batch in slices(batches, "text"):
        found = [tokens(text) if text and model.languages else [] for text in batch.column("text").to_pylist()]
        size = np.array([len(x) for x in found])
        row = np.repeat(np.arange(len(found)), size)
        number = scores.rows([w for x in found for w in x])
        total = np.zeros((len(found), max(1, len(model.languages))))
        for i in range(len(model.languages)):
            total[:, i] = np.bincount(row, scores.scores[number, i], len(found))
        # longer texts are surer, but words are not independent: the root of their number counts
        total /= np.sqrt(np.maximum(size, 1))[:, None]
        chance = np.exp(total - total.max(axis=1, keepdims=True))
        top, some = chance.argmax(axis=1), size > 0
        lang = [model.languages[i] if s else "und" for i, s in zip(top.tolist(), some.tolist(), strict=True)]
        best = np.where(some, chance.max(axis=1) / chance.sum(axis=1), 0.0)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(best, pa.float64())], ["id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row. id_col may be a struct of whatever is to be carried."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_predicted, model=held), with_id(rows, "id", "lang_pred string, score double")).withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.4) -> DataFrame:
    """The rows (all columns) whose language the model tells with at least this confidence."""
    carried = docs.select(F.struct(*docs.columns).alias("row_"), F.col(text_col).alias("text_"))
    return predict(carried, model, "row_", "text_").filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("row_.*")
