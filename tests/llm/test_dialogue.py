"""Conversation repair against a plain search over all edit sequences, in one partition and over many."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from logweir.llm import dialogue
from logweir.llm.queries import ORACLE, damaged, op12_conversation_repair
from tests.llm.test_operators import SF

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def accepted(initials):
    if not initials:
        return True
    rest = initials[1:] if initials[0] == "s" else initials
    return len(rest) > 0 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2)


def plain_repair(rows):
    """The cheapest edits of one conversation's rows, by a search from the front that keeps the ASCII-least."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = {r[1] for r in rows if r[1] is not None}
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))

    @lru_cache(None)
    def best(i, tail, length):
        """Least (cost, letters) from row i on, where the initials so far end in `tail` (one letter)."""
        options = []
        if i == len(rows):
            if tail in ("", "a"):
                options.append((0, ""))
        else:
            _, _, role, _ = rows[i]
            extra = 3 if faults[i] == "truncated" else 0
            cost, letters = best(i + 1, tail, 0)
            options.append((cost + 4, "D" + letters))
            if faults[i] not in ("blank", "duplicate"):
                for edit, new, price in [("K", role[:1], 0), ("R", "u", 3), ("R", "a", 3)]:
                    if (tail, new) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        cost, letters = best(i + 1, new, 0)
                        options.append((cost + price + extra, edit + letters))
        if length < 3:
            for new in "ua":
                if (tail, new) in {("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    cost, letters = best(i, new, length + 1)
                    options.append((cost + 3, "I" + letters))
        return min(options, default=(10**9, ""))

    cost, audit = best(0, "", 0)
    repaired, i = [], 0
    for edit in audit:
        wanted = "user" if not repaired or repaired[-1][0][0] in "sa" else "assistant"
        if edit == "I":
            repaired.append((wanted, ""))
            continue
        if edit != "D":
            repaired.append((rows[i][2] if edit == "K" else wanted, rows[i][3]))
        i += 1
    assert accepted("".join(r[0] for r, _ in repaired))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, sha, repaired)


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return {k: plain_repair(v) for k, v in by.items()}


def made(seed, convs, most):
    r = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(r.randrange(most)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            text = r.choice(["Yes.", "No!", "Why?", "well", "", " \n", "End. \t\x0b", None, f"number {turn}.", f"number {turn}"])
            rows.append((conv if conv else None, r.choice([turn, turn, turn, turn + 40, None]), role, text))
    return rows


def whole(row):
    return tuple(row[x] for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def test_query(spark, tmp_path):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    rows = given + [(None if r[0] is None else r[0] + 10_000, *r[1:]) for r in made(1, 60, 14)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    expected = plain(plain_damage(rows))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = op12_conversation_repair(spark, str(tmp_path)).collect()
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        assert whole(r) == expected.get(r.conv_id, (*none, None))[:8], r
    assert {x for r in got for x in r.audit} == set("DIKR")


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_conversations_over_many_partitions(spark, parts):
    """Long conversations are cut by the partitions; their pieces come together again."""
    r = random.Random(parts)
    rows = made(2, 6, 10) + [(100, t if t % 9 else None, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["a.", "b", f"{t // 3}.", f"{t}?", ""])) for t in range(300)]
    rows += [(101, 5, "user", "same.")] * 50 + [(101, t, "assistant", "same.") for t in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        frame = spark.createDataFrame(rows, SCHEMA)
        repair = dialogue.Repair(frame)
        found = {x.conv_id: x for x in repair.conversations.collect()}
        shas = {x.conv_id: x.repaired_sha256 for x in repair.repaired_digests().collect()}
        repaired = defaultdict(list)
        for x in repair.repaired_rows().collect():
            repaired[x.conv_id].append((x.place, x.role, x.text, x.edit, x.turn))
        opened = repair.runs.filter("open").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = plain([(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows])
    assert set(found) == set(expected) and opened <= 2 * parts
    for conv, e in expected.items():
        f = found[conv]
        assert (f.gaps, f.blank, f.duplicate, f.truncated, f.illegal, f.cost, f.audit, shas[conv]) == e[:8], conv
        own = sorted(repaired[conv])
        assert [(x[1], x[2]) for x in own] == e[8] and [x[0] for x in own] == list(range(len(own)))
        assert all((x[3] == "I") == (x[4] is None) or x[3] in "KR" for x in own)


def test_walk_of_many_rows():
    """Checkpoints at square roots give what all vectors kept would give."""
    r = random.Random(9)
    for n in (0, 1, 2, 15, 16, 17, 400):
        codes = bytes(r.choice([0, 1, 1, 2, 2, 3, 5, 6, 9, 10]) for _ in range(n))
        copies = {i: r.randrange(2, 5) for i in range(0, n, 7)}
        vectors = [dialogue.END]
        for i in range(n - 1, -1, -1):
            vectors.append(dialogue.before(codes[i], copies.get(i, 1), vectors[-1]))
        letters, q = dialogue.walk(codes, copies, dialogue.END, [0], True)[0]
        assert q in (0, 3) and dialogue.END[q] == 0
        price = {"K": 0, "R": 3, "D": 4, "I": 3}
        rows = [c for i, c in enumerate(codes) for c in [c] + [4] * (copies.get(i, 1) - 1)]
        cut = sum(3 for x, c in zip([x for x in letters if x != "I"], rows, strict=True) if x != "D" and c & 8)
        assert sum(map(price.get, letters)) + cut == vectors[-1][0] == dialogue.first_vector(codes, copies, dialogue.END)[0]


def test_odd_tables(spark):
    empty = dialogue.Repair(spark.createDataFrame([], SCHEMA))
    assert empty.conversations.count() == empty.repaired_rows().count() == empty.repaired_digests().count() == 0
    clash = spark.createDataFrame([("c", 1, "user", "Hi.", 1, "x"), ("c", 2, "assistant", "Yes.", 1, "y"), (None, None, None, None, 1, None)], "chat string, turn int, role string, text string, n int, letters string")
    repair = dialogue.Repair(clash, "chat")
    assert {r.chat: r.audit for r in repair.conversations.collect()} == {"c": "KK", None: "D"}
    assert {r.chat for r in repair.repaired_rows().collect()} == {"c"}
    assert "op12_conversation_repair" in ORACLE or damaged(spark.read.parquet(f"{SF}/conversations.parquet")).filter(F.col("text").isNull()).count() == 0
