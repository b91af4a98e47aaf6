"""Conversation structure repair: the cheapest edits that give a conversation well-formed turns, by a
square-root checkpointed dynamic programme.

The roles' initials of a repaired conversation are empty or an optional system turn and then pairs of
user and assistant. Each row is kept (0), given the other role (Rerole, 3) or deleted (4; a blank or
repeated row must be), empty turns can be inserted anywhere (3 each), and a truncated row that is not
deleted adds 3. Of the cheapest edits those whose letters D, I, K, R are ASCII-least are taken.

1. Rows become facts: role, a digest of the text, what is wrong with it. Equal rows of a turn become one
   fact with a count, and the first turn of each (conversation, role, text) is found by a grouping; so
   no text is compared with another, and a text that repeats a million times is a number.
2. The facts are dealt by ranges of (conversation, turn, role, digest). A conversation's stretch of a
   partition is a run. A run that is not the partition's first or last is a whole conversation: its rows'
   cost vectors are computed backwards and stored at every square root of its rows; walking forward, one
   block's vectors at a time are computed again, and the letters are emitted.
3. A conversation may go on over partitions, so the first and last run of each are open: two a partition.
   Their cost matrices (least cost from each state to each) come to the driver, which chains them from
   the end: the vectors at the partitions' borders are the coarse checkpoints. Open runs are then walked
   from every state, and the driver follows the states.
4. Texts are shuffled once, by conversation, and stream in order with the letters that belong to them
   (`repaired_rows`, `repaired_digests`): a task holds a row and one run's letters, not a conversation.
   A digest reads its conversation in one task, since it is defined over the rows in order.

Defined cases: null role and text count as one space; a null turn comes before all others and is left
out of gaps; rows of one turn are ordered by role and digest of the text; rows with a null conversation id
are one conversation; a role is told by its first letter alone (an empty or other role fits nowhere);
an empty table gives an empty result. Other input columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from .common import with_id, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant.
STATES = range(4)
#: The state after a user or assistant turn that fits, whichever the state asks for.
TURN = (2, 2, 3, 2)
#: By initial: system, user, assistant, other. The state that a kept row leads to, or none.
KEPT = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)
INITIALS = "sua"
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: A fact's code is its initial, plus these.
GONE, CUT = 4, 8
#: No way.
NEVER = 1 << 60
Vector = tuple[int, int, int, int]
#: What is left to pay after the last row, by state: two insertions after system, one after user.
END: Vector = (0, 2 * INSERT, INSERT, 0)
BLANKS = " \t\n\x0b\f\r"


@lru_cache(1 << 16)
def _relative(code: int, after: Vector) -> Vector:
    initial, extra = code & 3, TRUNCATED if code & CUT else 0
    base = []
    for q in STATES:
        costs = [DELETE + after[q]]
        if not code & GONE:
            costs.append(REROLE + extra + after[TURN[q]])
            if KEPT[initial][q] is not None:
                costs.append(KEEP + extra + after[KEPT[initial][q]])
        base.append(min(costs))
    return tuple(min(base[q], INSERT + base[TURN[q]], 2 * INSERT + base[TURN[TURN[q]]]) for q in STATES)


def before(code: int, copies: int, after: Vector) -> Vector:
    """The cost vector before a fact's rows (the first, then copies that go), from that after them."""
    least = min(after)
    rest = _relative(code, tuple(NEVER if x >= NEVER >> 1 else x - least for x in after))
    more = least + DELETE * (copies - 1)
    return tuple(NEVER if x >= NEVER >> 1 else x + more for x in rest)


@lru_cache(1 << 16)
def _letters(code: int, here: Vector, after: Vector, q: int) -> tuple[str, int]:
    """The letters of one row from state q, ASCII-least of the cheapest, and the state after it."""
    initial, extra, out = code & 3, TRUNCATED if code & CUT else 0, ""
    while True:
        if here[q] == DELETE + after[q]:
            return out + "D", q
        if here[q] == INSERT + here[TURN[q]]:
            out, q = out + "I", TURN[q]
        elif KEPT[initial][q] is not None and here[q] == KEEP + extra + after[KEPT[initial][q]]:
            return out + "K", KEPT[initial][q]
        else:
            return out + "R", TURN[q]


def first_vector(codes: bytes, copies: dict[int, int], end: Vector) -> Vector:
    for i in range(len(codes) - 1, -1, -1):
        end = before(codes[i], copies.get(i, 1), end)
    return end


def walk(codes: bytes, copies: dict[int, int], end: Vector, starts: Iterable[int], last: bool) -> list[tuple[str, int]]:
    """The letters and the last state of the facts, from each of the start states. Vectors are kept at
    every square root of the facts. last: the conversation ends here, so what it lacks is inserted."""
    n = len(codes)
    step = isqrt(max(n - 1, 0)) + 1
    kept = {n: end}
    vector = end
    for i in range(n - 1, -1, -1):
        vector = before(codes[i], copies.get(i, 1), vector)
        if i % step == 0:
            kept[i] = vector
    states = list(starts)
    letters: list[list[str]] = [[] for _ in states]
    for at in range(0, n, step):
        to = min(at + step, n)
        vectors = [kept[to]]
        for i in range(to - 1, at - 1, -1):
            vectors.append(before(codes[i], copies.get(i, 1), vectors[-1]))
        vectors.reverse()
        for i in range(at, to):
            # the copies are deleted: the vector between the first row and them is a sum
            more, after = copies.get(i, 1) - 1, vectors[i - at + 1]
            after = tuple(x + DELETE * more for x in after)
            least = min(after)
            here, after = (tuple(x - least for x in v) for v in (vectors[i - at], after))
            for k, q in enumerate(states):
                new, states[k] = _letters(codes[i], here, after, q)
                letters[k].append(new + "D" * more)
    out = []
    for q, parts in zip(states, letters, strict=True):
        while last and END[q]:
            parts.append("I")
            q = TURN[q]
        out.append(("".join(parts), q))
    return out


def row_facts(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows as the operator sees them: id, turn, role, text, digest of the text."""
    rows = rows.select(F.col(conv).alias("id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _counted(rows: DataFrame) -> DataFrame:
    """A fact for each (id, turn, role, digest): n rows, blank, truncated, and whether the first of its kind."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    keys = ["id", "turn", "role", "digest"]
    facts = rows.select(*keys, (F.length(end) == 0).alias("blank"), (~F.substring(end, -1, 1).isin(*".!?")).alias("cut"))
    facts = facts.groupBy(*keys).agg(F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("later"), "turn")  # null turns come first
    firsts = facts.groupBy("id", "role", "digest").agg(F.min(place).alias("at")).select("id", F.col("at.turn").alias("turn"), "role", "digest")
    none = F.lit(None).cast("boolean")
    both = facts.withColumn("first", F.lit(False)).unionByName(firsts.select("*", none.alias("blank"), none.alias("cut"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("first")))
    return both.groupBy(*keys).agg(*(F.max(x).alias(x) for x in ("blank", "cut", "first")), F.sum("n").alias("n"))


_ORDER = (F.asc_nulls_first, ("id", "turn", "role", "digest"))


def _ordered() -> list[Column]:
    how, names = _ORDER
    return [how(x) for x in names]


RUN = (
    "part int, place int, open boolean, id {id}, turn long, role string, digest binary, least long, most long, turns long, first_turn long, last_turn long, first_initial int, last_initial int, "
    "blank long, duplicate long, truncated long, illegal long, cost long, audit string, codes binary, copy_of array<long>, copies array<long>, matrix array<long>"
)


class _Run:
    """One conversation's facts in one partition, gathered row by row."""

    def __init__(self, part: int, place: int, key: tuple):
        self.part, self.place, self.key = part, place, key
        self.codes, self.copies, self.count = bytearray(), {}, Counter()
        self.least = self.most = None
        self.turns = 0
        self.first_turn = self.last_turn = key[1]
        self.initial = None

    def add(self, turn, initial: int, blank: bool, cut: bool, first: bool, n: int) -> None:
        if turn is not None:
            self.turns += self.least is None or turn != self.last_turn
            self.least, self.most = turn if self.least is None else self.least, turn
        self.last_turn = turn
        self.count["illegal"] += n - 1 + (self.initial is not None and (self.initial, initial) not in LEGAL)
        self.initial = initial
        if n > 1:
            self.copies[len(self.codes)] = n
        if blank:
            self.count["blank"] += n
        else:
            self.count["duplicate"] += n - first
            self.count["truncated"] += first and cut
        self.codes.append(initial | (GONE if blank or not first else CUT if cut else 0))

    def row(self, open_: bool) -> dict:
        codes, copies = bytes(self.codes), self.copies
        out = dict(zip(("id", "turn", "role", "digest"), self.key, strict=True)) | {x: self.count[x] for x in ("blank", "duplicate", "truncated", "illegal")}
        out |= {"part": self.part, "place": self.place, "open": open_, "least": self.least, "most": self.most, "turns": self.turns, "first_turn": self.first_turn, "last_turn": self.last_turn}
        out |= {"first_initial": codes[0] & 3, "last_initial": self.initial, "cost": None, "audit": None, "codes": None, "copy_of": None, "copies": None, "matrix": None}
        if open_:
            to = [first_vector(codes, copies, tuple(0 if q == end else NEVER for q in STATES)) for end in STATES]
            return out | {"codes": codes, "copy_of": list(copies), "copies": list(copies.values()), "matrix": [to[end][q] for q in STATES for end in STATES]}
        return out | {"cost": first_vector(codes, copies, END)[0], "audit": walk(codes, copies, END, [0], True)[0][0]}


def _runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    run, place, out = None, 0, []
    for batch in batches:
        columns = [batch.column(x).to_pylist() for x in ("part", "id", "turn", "role", "digest", "blank", "cut", "first", "n")]
        for part, id_, turn, role, digest, blank, cut, first, n in zip(*columns, strict=True):
            if run is None or id_ != run.key[0]:
                if run is not None:
                    out.append(run.row(run.place == 0))
                    place += 1
                run = _Run(part, place, (id_, turn, role, digest))
            initial = INITIALS.find(role[:1]) if role else -1
            run.add(turn, initial if initial >= 0 else 3, blank, cut, first, n)
        if len(out) > 2000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if run is not None:
        out.append(run.row(True))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open runs, walked from every state."""
    for batch in batches:
        for r in batch.to_pylist():
            found = walk(r["codes"], dict(zip(r["copy_of"], r["copies"], strict=True)), tuple(r["end"]), STATES, r["last"])
            yield pa.RecordBatch.from_pydict({"part": pa.array([r["part"]] * 4, pa.int32()), "place": pa.array([r["place"]] * 4, pa.int32()), "state": pa.array(list(STATES), pa.int32()), "letters": [x for x, _ in found], "to": pa.array([q for _, q in found], pa.int32())})


def chained(runs: list[dict]) -> list[list[dict]]:
    """Open runs in order, one list for each conversation, each run with the cost vector at its end."""
    chains: list[list[dict]] = []
    for r in sorted(runs, key=lambda r: (r["part"], r["place"])):
        if chains and chains[-1][-1]["id"] == r["id"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    for chain in chains:
        vector = END
        for r in reversed(chain):
            r["end"], r["last"] = vector, r is chain[-1]
            m = np.array(r["matrix"], np.int64).reshape(4, 4)
            vector = tuple(np.minimum((m + np.array(vector)).min(axis=1), NEVER).tolist())
        chain[0]["cost"] = vector[0]
    return chains


class Repair:
    """Repaired conversations of a table.

    conversations: id, gaps (turns missing between the least and the greatest), blank, duplicate, truncated
    (rows whose first fault it is), illegal (neighbours whose roles do not follow), cost and audit (the edits'
    letters). The facts and runs are written to the shared folder.
    """

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.spark, self.id_col = rows.sparkSession, conv
        self.rows = row_facts(rows, conv, turn, role, text)
        self.id_type = self.rows.schema["id"].dataType
        facts = _counted(self.rows).repartitionByRange(*_ordered()).sortWithinPartitions(*_ordered()).withColumn("part", F.spark_partition_id())
        ddl = RUN.format(id=self.id_type.simpleString())
        schema = to_arrow_schema(StructType.fromDDL(ddl))
        self.runs = written(facts.mapInArrow(lambda batches: _runs(batches, schema), ddl), "runs")
        key = ["id", "turn", "role", "digest"]
        done = self.runs.filter("not open")
        gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0).cast("long"))
        counts = ["blank", "duplicate", "truncated", "illegal"]
        self.pieces = done.select(*key, F.col("audit").alias("letters"))
        self.conversations = done.select("id", gaps.alias("gaps"), *counts, "cost", "audit")
        more = self._open(key, counts)
        if more:
            self.pieces, self.conversations = self.pieces.union(more[0]), self.conversations.union(more[1])
        self.conversations = self.conversations.withColumnRenamed("id", conv)

    def _open(self, key: list[str], counts: list[str]) -> tuple[DataFrame, DataFrame] | None:
        """Pieces and conversations of the open runs: two rows of each partition, at the most, are on the driver."""
        about = ["part", "place", "id", "first_turn", "last_turn", "first_initial", "last_initial", "matrix"]
        chains = chained([r.asDict() for r in self.runs.filter("open").select(*about).collect()])
        if not chains:
            return None
        place = ["part", "place"]
        ends = self.spark.createDataFrame([(r["part"], r["place"], list(r["end"]), r["last"]) for c in chains for r in c], "part int, place int, end array<long>, last boolean")
        walked = written(self.runs.filter("open").select(*place, "codes", "copy_of", "copies").join(ends, place).mapInArrow(_walked, "part int, place int, state int, letters string, to int"), "walked")
        to = {(r.part, r.place, r.state): r.to for r in walked.select(*place, "state", "to").collect()}
        chosen = []
        for chain in chains:
            q, last = 0, None
            for r in chain:
                illegal = last is not None and (last["last_initial"], r["first_initial"]) not in LEGAL
                same = last is not None and r["first_turn"] is not None and r["first_turn"] == last["last_turn"]
                chosen.append((r["part"], r["place"], q, chain[0]["part"], chain[0]["place"], chain[0]["cost"], int(illegal), int(same)))
                q, last = to[r["part"], r["place"], q], r
        picked = self.spark.createDataFrame(chosen, "part int, place int, state int, head_part int, head_place int, cost long, more_illegal long, same_turn long")
        whole = self.runs.filter("open").drop("cost").join(picked, place).join(walked, [*place, "state"])
        gaps = F.coalesce(F.max("most") - F.min("least") + 1 - F.sum(F.col("turns") - F.col("same_turn")), F.lit(0).cast("long"))
        sums = [F.sum(F.col(x) + F.col("more_illegal") if x == "illegal" else F.col(x)).alias(x) for x in counts]
        audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place, "letters"))), lambda x: x.letters), "")
        grouped = whole.groupBy("head_part", "head_place").agg(F.first("id").alias("id"), gaps.alias("gaps"), *sums, F.first("cost").alias("cost"), audit.alias("audit"))
        return whole.select(*key, "letters"), grouped.select("id", "gaps", *counts, "cost", "audit")

    def _streamed(self) -> DataFrame:
        """Rows and letters by conversation, in order; letters come before the first of their rows."""
        rows = self.rows.select("id", "turn", "role", "digest", F.lit(True).alias("is_row"), "text")
        both = rows.union(self.pieces.select("id", "turn", "role", "digest", F.lit(False).alias("is_row"), F.col("letters").alias("text")))
        return both.repartition("id").sortWithinPartitions(*_ordered(), "is_row").select("id", "turn", "role", "is_row", "text")

    def repaired_rows(self) -> DataFrame:
        """The repaired conversations: id, turn (null for an inserted row), role, text, edit (K, R or I) and
        place, the row's number in its conversation. Deleted rows are left out."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _repaired(batches):
                found = [x for x in batch if x[3]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], kind), *(pa.array([x[i] for x in found], t) for i, t in ((2, pa.int64()), (3, pa.string()), (4, pa.string()), (5, pa.string()), (1, pa.int64())))], ["id", "turn", "edit", "role", "text", "place"])

        kind = to_arrow_type(self.id_type)
        out = self._streamed().mapInArrow(rows, with_id(self.rows, "id", "turn long, edit string, role string, text string, place long"))
        return out.withColumnRenamed("id", self.id_col)

    def repaired_digests(self) -> DataFrame:
        """id and repaired_sha256, of the repaired rows as `role:text`, joined by newlines."""

        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, last, done = None, None, []
            for batch in _repaired(batches):
                for id_, place, _, edit, role, text in batch:
                    if not edit:
                        if hasher is not None:
                            done.append((last, hasher.hexdigest()))
                        hasher, last = hashlib.sha256(), id_
                        continue
                    hasher.update(("\n" if place else "").encode() + role.encode() + b":" + text.encode())
                if len(done) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], kind), pa.array([x for _, x in done])], ["id", "repaired_sha256"])
                    done = []
            if hasher is not None:
                done.append((last, hasher.hexdigest()))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], kind), pa.array([x for _, x in done], pa.string())], ["id", "repaired_sha256"])

        kind = to_arrow_type(self.id_type)
        out = self._streamed().mapInArrow(digests, with_id(self.rows, "id", "repaired_sha256 string"))
        return out.withColumnRenamed("id", self.id_col)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(id, place, turn, edit, role, text) of the repaired rows, and one row without edit where a
    conversation begins; a list for each batch and one for what is inserted at the very end."""
    known, id_, state, place, letters, at = False, None, 0, 0, "", 0
    out: list[tuple] = []

    def inserted() -> None:
        nonlocal state, place, at
        while at < len(letters) and letters[at] == "I":
            state = TURN[state]
            out.append((id_, place, None, "I", "user" if state == 2 else "assistant", ""))
            place, at = place + 1, at + 1

    for batch in batches:
        for new, turn, role, is_row, text in zip(*(batch.column(x).to_pylist() for x in ("id", "turn", "role", "is_row", "text")), strict=True):
            if not known or new != id_:
                inserted()
                known, id_, state, place, letters, at = True, new, 0, 0, "", 0
                out.append((id_, None, None, None, None, None))
            if not is_row:
                letters, at = text, 0
                continue
            inserted()
            edit, at = letters[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                state = TURN[state]
                role = "user" if state == 2 else "assistant"
            else:
                state = KEPT[INITIALS.find(role[0])][state]
            out.append((id_, place, turn, edit, role, text))
            place += 1
        yield out
        out = []
    inserted()
    if out:
        yield out
