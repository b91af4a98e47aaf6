"""Secret scans by rules and by two character Markov models, in DataFrame functions only.

Rules find assignments, access keys and hexadecimal runs. The method adds what they miss: every run of
CANDIDATE characters is scored by the mean log-likelihood ratio, over its pairs of neighbouring
characters, of a model of random strings against a model of ordinary identifiers. Both are trained from
labelled samples; a candidate above the threshold that meets no rule's span is a secret of kind
`markov`.

Defined cases: null text is empty and has no secrets; a pair that no sample holds counts by its second
character; without samples every ratio is 0 and the method adds nothing; repeated rows are
scanned one by one; null ids are kept. Only the columns asked for are carried. Time is linear in a text's
length, and grows with the power 1.5 of its number of hits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_below

#: The rules' kinds and patterns, with the least length of a match (of its value).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 12
#: What the models judge, and the ratio (nats a pair) from which on it is a secret.
CANDIDATE, THRESHOLD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", 0.7
#: Distinct characters that a candidate has at least: rulers and fillers have fewer.
LEAST_DISTINCT = 8
#: Codes of the characters that the models know: "+" to "z".
FIRST_CODE, CODES = 43, 80
#: Weight of a character's own frequency beside the pairs that are seen.
PRIOR = 20
#: Documents that the labelled samples are taken from, at the most.
SAMPLE_DOCS = 5_000


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, start: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element what `join` makes of `start` and all elements before it. Elements are taken in blocks
    of about the root of their number, so that long arrays are not copied once for each element."""

    def scanned(items: Column, begin: Column) -> Column:
        none = F.struct(begin.alias("at"), F.filter(F.array(begin), lambda _: F.lit(False)).alias("all"))
        step = lambda state, x: F.struct(join(state["at"], x).alias("at"), F.concat(state["all"], F.array(state["at"])).alias("all"))
        return F.aggregate(items, none, step, lambda state: state["all"])

    def over(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        cut = F.transform(F.sequence(F.lit(1), F.size(v), size), lambda i: F.slice(v, i, size))
        return bound(cut, lambda blocks: F.flatten(F.zip_with(blocks, scanned(F.transform(blocks, lambda x: F.aggregate(x, start, lambda a, b: join(a, b))), start), lambda x, begin: scanned(x, begin))))

    # a block's own total joins with what is before it, so `join` has to be associative, and `start` neutral
    return bound(values, lambda v: F.when(F.size(v) == 0, F.filter(F.array(start), lambda _: F.lit(False))).otherwise(over(v)))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _found(text: Column, pattern: str, kind: int) -> Column:
    """Spans of the pattern's matches as (start, kind, end, value): the text between matches gives the places."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def spans(x: Column) -> Column:
        both = F.zip_with(F.slice(x["gaps"], 1, F.size(x["matches"])), x["matches"], lambda g, m: F.length(g) + F.length(m))
        starts = F.zip_with(running(both, F.lit(0), _sum), F.slice(x["gaps"], 1, F.size(x["matches"])), lambda at, g: at + F.length(g))
        ended = F.zip_with(starts, x["matches"], lambda at, m: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(m)).alias("end")))
        return F.zip_with(ended, x["values"], lambda s, v: F.struct(s["start"], s["kind"], s["end"], v.alias("value")))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == 0 else matches
    parts = F.struct(matches.alias("matches"), F.split(text, pattern, -1).alias("gaps"), values.alias("values"))
    return F.when(F.rlike(text, F.lit(pattern)), bound(parts, spans)).otherwise(none)


def rule_spans(text: Column) -> Column:
    """Spans of the three rules, each leftmost and without overlap; matches that are too short are dropped."""
    assign = F.filter(_found(text, ASSIGN, 0), lambda x: F.length(x["value"]) >= LEAST_VALUE)
    return F.array_sort(F.concat(assign, _found(text, ACCESS, 1), _found(text, HEX, 2)))


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(value, random): values that the rules find, and ordinary identifiers around them, of a bounded sample."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sample = sample_below(docs.select(F.col(id_col).alias("id"), text.alias("text")), "id", SAMPLE_DOCS)
    values = F.concat(F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)), lambda x: F.length(x) >= LEAST_VALUE), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    words = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z_]{6,}+(?![A-Za-z0-9+/_=-])"), F.lit(0))
    pairs = F.concat(F.transform(values, lambda x: F.struct(x.alias("value"), F.lit(True).alias("random"))), F.transform(words, lambda x: F.struct(x.alias("value"), F.lit(False).alias("random"))))
    return sample.select(F.explode(pairs).alias("x")).select("x.value", "x.random")


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of characters, random against ordinary, by code of the
    first times CODES plus code of the second."""
    at = F.sequence(F.lit(1), F.length("value") - 1)
    pairs = samples.filter(F.length("value") > 1).select("random", F.explode(F.transform(at, lambda i: F.substr("value", i, F.lit(2)))).alias("pair"))
    counts = {(r[0], r[1]): r[2] for r in pairs.filter(F.rlike("pair", F.lit("^[+-z]{2}$"))).groupBy("random", "pair").count().collect()}

    def logs(random: bool) -> list[float]:
        """Of the second character after the first; unseen pairs fall back on how often the second one is."""
        rows = [[counts.get((random, chr(FIRST_CODE + a) + chr(FIRST_CODE + b)), 0) for b in range(CODES)] for a in range(CODES)]
        second = [sum(column) for column in zip(*rows, strict=True)]
        share = [(n + 1) / (sum(second) + CODES) for n in second]
        return [math.log((n + PRIOR * share[b]) / (sum(row) + PRIOR)) for row in rows for b, n in enumerate(row)]

    return [a - b for a, b in zip(logs(True), logs(False), strict=True)]


def ratio(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's pairs."""
    held = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c) - FIRST_CODE)
    pairs = bound(codes, lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.get(held, a * CODES + b)))
    return F.aggregate(pairs, F.lit(0.0), _sum) / (F.length(value) - 1)


def _unmet(more: Column, base: Column) -> Column:
    """The spans of `more` that meet none of `base`. Of all in order, what begins before a span meets it if
    the furthest end so far is beyond its start, what begins after it if the next start is before its end."""
    kind = "struct<start:int,kind:int,end:int,value:string>"
    everything = F.array_sort(F.concat(more, base).cast(f"array<{kind}>"))
    far = F.lit(2**31 - 1)

    def free(x: Column) -> Column:
        ends = running(F.transform(x, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(F.lit(0))), F.lit(0), F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(x, lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(far))), far, F.least))
        beside = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("ended"), s.alias("next")))
        marked = F.zip_with(x, beside, lambda s, b: F.struct(s.alias("span"), ((s["kind"] == 3) & (b["ended"] <= s["start"]) & (b["next"] >= s["end"])).alias("free")))
        return F.transform(F.filter(marked, lambda m: m["free"]), lambda m: m["span"])

    return F.when(F.size(base) == 0, more).otherwise(bound(everything, free))


def find_secrets(docs: DataFrame, model: list[float], text_col: str = "text", out: str = "secrets", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a column `out`: spans (start, kind, end, value) by start, then kind; kind numbers KINDS,
    places are characters, the end is exclusive."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    based = docs.withColumn(out, F.struct(rule_spans(text).alias("base"), _found(text, CANDIDATE, 3).alias("more")))
    base, more = F.col(out)["base"], F.col(out)["more"]
    added = F.filter(_unmet(more, base), lambda c: (F.size(F.array_distinct(F.split(c["value"], ""))) >= LEAST_DISTINCT) & (ratio(c["value"], model) >= threshold))
    return based.withColumn(out, F.when(F.size(more) == 0, base).otherwise(F.array_sort(F.concat(base, added))))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of spans (by start) replaced by the mark. Spans are taken in blocks, so that
    the text is walked once for each block and each block's part once for each span."""

    def parts(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(x), size), lambda i: F.slice(x, i, size))

        def block(b: Column) -> Column:
            low = F.get(b, F.lit(0))["ended"]
            here = F.substr(text, low + 1, F.array_max(F.transform(b, lambda s: s["end"])) - low)

            def piece(h: Column) -> Column:
                one = lambda s: F.when(s["start"] >= s["ended"], F.concat(F.substr(h, s["ended"] - low + 1, s["start"] - s["ended"]), F.lit(mark))).otherwise("")
                return F.array_join(F.transform(b, one), "")

            return bound(here, piece)

        return F.concat(F.array_join(F.transform(blocks, block), ""), F.substr(text, F.array_max(F.transform(x, lambda s: s["end"])) + 1, F.length(text)))

    def placed(s: Column) -> Column:
        ended = running(F.transform(s, lambda x: x["end"]), F.lit(0), F.greatest)
        return F.zip_with(s, ended, lambda x, e: F.struct(x["start"], x["end"], e.alias("ended")))

    return F.when(F.size(spans) > 0, bound(bound(spans, placed), parts)).otherwise(text)


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256 (of the rules' spans) and spans (all of them) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = find_secrets(rows, model)
    base = F.filter("secrets", lambda x: x["kind"] < 3)

    def count(kind: int) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = map(count, range(3))
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("secrets")).alias("spans"))
