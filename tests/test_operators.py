"""Operators on small frames with known rows."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from logweir.functions.redact import redact_ip
from logweir.operators import charts, mapping, prepare, presets, routing, rule_index, schema
from logweir.operators import filters as f
from logweir.operators import nested as nested_values
from logweir.operators.projection import unnest
from logweir.paths import drop_at, flat_map, has_path, leaves, set_at
from logweir.plans import stored
from logweir.rules import FilterRule as R
from logweir.rules import RoutingRule
from logweir.sinks import payloads
from logweir.sources import vendors

NESTED = "id string, metadata array<struct<user:array<struct<name:string,tags:array<string>>>,ip:string>>, labels map<string,string>"
ROWS = [("a", [([("x", ["u", "v"]), ("y", [])], "1.2.3.4")], {"n": "5", "t": "true"}), ("b", [([], None), ([("z", None)], "x")], {"n": "z"}), ("c", None, None)]


@pytest.fixture(scope="module")
def nested(spark):
    return spark.createDataFrame(ROWS, NESTED)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_filters_through_arrays(nested):
    assert ids(f.filter_events(nested, [R("metadata.user.name", "=", "y")])) == ["a"]
    assert ids(f.filter_events(nested, [R("metadata.user.tags", "list_includes", "u")])) == ["a"]
    assert ids(f.filter_events(nested, [R("metadata.user.tags", "list_includes_regexp", "^v")])) == ["a"]
    assert ids(f.filter_events(nested, [R("labels.n", ">", 4)])) == ["a"]
    assert ids(f.filter_events(nested, [R("labels.t", "=", True)])) == ["a"]
    with pytest.raises(ValueError):
        f.filter_events(nested, [R("metadata.none", "=", 1)])


def test_negation_keeps_nulls_in_search_and_not_in_routing(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 7)], "id string, v int")
    assert ids(f.filter_events(df, [R("v", ">", 5, negate=True)])) == ["a", "b"]
    assert ids(f.filter_events(df, [R("v", "range", values=(5, 9), negate=True)])) == ["a", "b"]
    assert ids(f.filter_events(df, [R("v", "=", None, negate=True)])) == ["a", "c"]
    assert ids(df.filter(routing.matches(df, [R("v", ">", 5, negate=True)]))) == ["a"]
    assert ids(df.filter(routing.matches(df, [R("w", "=", 5, negate=True)]))) == []


def test_routing_by_join_equals_routing(spark):
    df = spark.createDataFrame([(str(i), i % 3, "ab"[i % 2]) for i in range(30)], "id string, n int, s string")
    rules = [RoutingRule(1, (R("n", "=", 1),)), RoutingRule(2, (R("n", "=", 2), R("s", "=", "b"))), RoutingRule(3, (R("s", "=", "z"),))]
    one = {r.id: sorted(r.rule_ids) for r in routing.match_rules(df, rules).collect() if r.rule_ids}
    assert one == {r.id: r.rule_ids for r in routing.match_rules_join(df, routing.conditions(spark, rules)).collect()}
    assert routing.route(df.withColumn("via_rule_id", F.lit(1)), rules).count() == 0


def test_times():
    now = dt.datetime(2024, 3, 31, 12, 30, 5)
    assert f.time_literal("1704067200") == f.time_literal("1704067200000") == f.time_literal("2024-01-01T01:00:00+01:00") == dt.datetime(2024, 1, 1)
    assert f.relative_range("this@month", now)[0] == dt.datetime(2024, 3, 1)
    assert f.relative_range("last@1mm", now)[0] == dt.datetime(2024, 2, 1)
    assert f.relative_range("this@week", now)[0] == dt.datetime(2024, 3, 25)
    assert f.shifted(dt.datetime(2024, 1, 31), 1, "month") == dt.datetime(2024, 2, 29)
    assert f.chart_range(now, now, "minute", now) == (now - dt.timedelta(minutes=1), now + dt.timedelta(minutes=1))
    with pytest.raises(ValueError):
        f.relative_range("soon", now)
    with pytest.raises(ValueError):
        f.typed("x", leaves(__import__("pyspark.sql.types", fromlist=["StructType"]).StructType.fromDDL("a int"))[0][1])


def test_paths(nested, spark):
    assert has_path(nested, "metadata.user.tags") and not has_path(nested, "metadata.user.x")
    assert unnest(nested, "metadata.user.name").count() == 3
    assert unnest(nested, "metadata.user.name", outer=True).count() == 5
    df = spark.createDataFrame([(1, (2, "x"))], "a int, s struct<b:int,c:string>")
    assert set_at(df, "s.d.e", F.lit(9)).select("s.d.e", "s.b").first() == (9, 2)
    assert drop_at(drop_at(df, "s.b"), "s.c").columns == ["a"]
    assert flat_map_of(df) == {"a": "1", "s.b": "2", "s.c": "x"}


def flat_map_of(df):
    return df.select(flat_map(df).alias("m")).first().m


def test_names_and_cleaning(spark):
    assert [prepare.safe_name(x) for x in ("ok", "a-b", "1a", "a b", "_TABLE_x", "-1 é", "x" * 130)] == ["ok", "_a_b", "_1a", "_a_b", "__TABLE_x", "___1__", "_" + "x" * 128]
    df = spark.createDataFrame([(None, [["", None], ["x"]], {"k": "", "l": "v"})], "a string, b array<array<string>>, c map<string,string>")
    assert prepare.drop_empty_values(df).first() == (None, [["x"]], {"l": "v"})
    clean = prepare.normalize_column_names(spark.createDataFrame([(1, 2)], "`a-b` int, _a_b int"))
    assert clean.columns == ["_a_b"] and clean.first()[0] == 2
    again = prepare.drop_empty_values(prepare.normalize_column_names(clean))
    assert again.collect() == clean.collect()


def test_mapping(spark):
    bodies = ['{"a":{"b":1,"c":[1,null,{"d":2}]},"t":"2024-01-01 00:00:01Z","n":-5,"e":[{"x":1},7,{"y":"z"}],"lvl":"Warn"}', '{"n":"300.9","t":1704067200,"a":{}}', "broken", None]
    df = mapping.as_variant(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string"), "body")
    P = mapping.Field
    fields = [P("u", "uint8", ("$.n",)), P("i", "int32", ("$.n",)), P("t", "datetime64", ("$.t",), precision=0), P("m", "flat_map", ("$.a",)), P("e", "array_flat_map", ("$.e",)), P("lvl", "string", ("$.lvl",), value_map={"warn": "W"}, default="?"), P("k", "array_string", ("$.a.c",)), P("kn", "array_string", ("$.a.c",), filter_nil=True)]
    got = mapping.map_events(df, fields, keep=("id",)).orderBy("id").collect()
    assert [tuple(r)[1:4] for r in got] == [(0, -5, 1704067201), (255, 300, 1704067200), (0, 0, 0), (0, 0, 0)]
    assert got[0].m == {"b": "1", "c": '[1,null,{"d":2}]'} and got[0].e == [{"x": "1"}, {"y": "z"}] and got[0].lvl == "W" and got[1].lvl == "?"
    assert got[0].k == ["1", "", '{"d":2}'] and len(got[0].kn) == 2 and got[2].k == []


def test_presets_on_odd_events(spark):
    df = mapping.as_variant(spark.createDataFrame([('{"metadata":{"level":"loud"},"gauge":{"value":2}}',), ("[1]",), (None,)], "b string"), "b")
    logs = presets.map_logs(df).select("severity_text", "severity_number").collect()
    assert [tuple(r) for r in logs] == [("INFO", 9)] * 3
    assert [r[0] for r in presets.map_metrics(df).select("value").collect()] == [2.0, 0.0, 0.0]
    assert presets.map_traces(df).count() == 3


def test_schema(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":{"c":"x"}}'), (2, '{"a":"s","b":{"c":null},"l":[1,2.5]}'), (3, "{"), (4, None)], "id int, body string")
    found = dict(schema.flat_types(schema.infer_schema(df, "body")))
    assert found["b.c"] == "string" and found["l"] == "list<float>" and found["a"] == "string"
    held = schema.infer_schema(df.filter("id = 1"), "body")
    assert [tuple(r) for r in schema.schema_conflicts(df, held, "id", "body").collect()] == [(2, "a", "string", "integer")]
    assert schema.schema_updates(df, held, "body", locked=True) == held
    assert schema.schema_updates(df, held, "body", limit=2) == held
    assert schema.sample_rate(1e9) == 1e-5 and schema.sample_rate(0.1) == 1.0


def test_redaction(spark):
    text = "v4 10.0.0.1, v6 2001:db8::1 ::1 fe80::1%eth0 12:30:45 999.1.1.1.1"
    df = spark.createDataFrame([(text, [{"k": "1.1.1.1"}])], "a string, b array<map<string,string>>")
    row = redact_ip(df).first()
    assert row.a.startswith("v4 REDACTED, v6 REDACTED REDACTED REDACTED 12:30:45") and row.b == [{"k": "REDACTED"}]


def test_stored_queries(spark):
    assert stored.parameters("SELECT @a, '@b', :c") == ["a", "c"]
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("hidden")
    views = {"seen": spark.createDataFrame([(i,) for i in range(5)], "x int")}
    assert stored.run_over_views(spark, views, "SELECT * FROM seen WHERE x > @n", {"n": 2}).count() == 2
    with pytest.raises(Exception, match="hidden"):
        stored.run_over_views(spark, views, "SELECT * FROM hidden").count()


def test_charts(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, 0, 5), 600), ("b", dt.datetime(2024, 1, 1, 2), 503)], "id string, timestamp timestamp_ntz, status int")
    chart = charts.status_chart(df, "status", "hour").orderBy("timestamp").collect()
    assert [(r.other, r.status_5xx, r.total) for r in chart] == [(0, 0, 1), (0, 1, 1)]
    filled = charts.fill_missing(charts.chart(df, period="hour").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 3), "hour")
    assert [r.value for r in filled.collect()] == [0, 1, 0, 1]
    with pytest.raises(ValueError):
        charts.chart(df, "min", "status")


def test_syslog(spark):
    lines = ["<34>1 2003-10-11T22:14:15.003Z h su - ID47 - 'su root' failed", '<13>1 - - - - - [a@1 k="v"] {"x": 1}', "120 <190>1 2024-01-01T00:00:00+00:00 h app router - method=GET path=\"/a b\" status=200", "no line", None]
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    plain = [r.syslog for r in vendors.parse_syslog(df, "l").collect()]
    assert (plain[0].facility, plain[0].severity, plain[0].message) == ("auth", "crit", "'su root' failed")
    assert plain[1].sd[0].value == "v" and plain[1].json == '{"x":1}' and plain[3] is None and plain[4] is None
    router = vendors.parse_syslog(df, "l", "heroku").collect()[2].syslog
    assert router.length == 120 and router.logfmt == {"method": "GET", "path": "/a b", "status": "200"}


def test_syslog_lines_are_cut(spark):
    df = spark.createDataFrame([("1", dt.datetime(2024, 1, 1), "é" * 50)], "id string, timestamp timestamp_ntz, event_message string")
    line = payloads.to_syslog_lines(df, 100).first().line
    size, rest = line.split(" ", 1)
    assert int(size) == 100 and rest.startswith("<133>1 2024-01-01T00:00:00.000Z - logs - 1 - ")


@pytest.mark.parametrize("text,wanted", [
    ("login of host 172.16.4.77 via 203.0.113.9 failed", "login of host REDACTED via REDACTED failed"),
    ("route fd12:3456:0789:0abc:0000:0000:0000:00ff is up", "route REDACTED is up"), ("fd12:9:a::c:77", "REDACTED"),
    ("v4=198.51.100.23; v6 fd00::beef", "v4=REDACTED; v6 REDACTED"), ("peer 203.0.113.40, no 99203.0.113.400", "peer REDACTED, no 99203.0.113.400"),
    ("0.0.0.0 or ::2\tor ::", "REDACTED or REDACTED\tor REDACTED"), ("1.2.3.4.5.6.7.8.9", "REDACTED.REDACTED.9"), ("300.1.2.3.4 1.2.3.256 001.02.3.099", "300.REDACTED 1.2.3.256 REDACTED"), ("1.2.3.4.5", "REDACTED.5"), ("(8.8.8.8).", "(REDACTED)."), ("256.1.1.1 x1.2.3.4 1.2.3.4_", "256.1.1.1 x1.2.3.4 1.2.3.4_"),
    ("1:2:3:4:5:6:7 1:2:3:4:5:6:7:8:9 1::2::3 g::1 12345::1 12:30:45", "1:2:3:4:5:6:7 1:2:3:4:5:6:7:8:9 1::2::3 g::1 12345::1 12:30:45"), ("fe80::1%eth0 2001::1%eth0", "REDACTED 2001::1%eth0"),
    ("1:2:3:4:5:6:7:: ::2:3:4:5:6:7:8 x", "REDACTED REDACTED x"), ("", ""), (None, None), ("nothing of the kind", "nothing of the kind"),
])
def test_redaction_of_addresses(spark, text, wanted):
    from logweir.functions.redact import redact_text

    assert spark.createDataFrame([(text,)], "t string").select(redact_text(F.col("t"))).first()[0] == wanted


def test_rule_index(spark):
    """The index gives what each rule gives on its own, over typed, nested, missing and odd values."""
    rng = random.Random(5)
    texts = ["", "a", "ab", "abc", "b.c", "xabcx", "é(", None]
    row = lambda i: (str(i), rng.choice([*range(-3, 6), None]), rng.choice([-1.5, 0.0, 2.0, 2.5, float("nan"), float("inf"), None]), rng.choice(texts), rng.choice([["a", "b"], ["c"], [], None]), {"t": rng.choice(texts), "n": rng.choice([1, 2, None])}, rng.choice([True, False, None]))
    df = spark.createDataFrame([row(i) for i in range(120)], "id string, i long, d double, s string, l array<string>, m struct<t:string,n:int>, b boolean")
    numbers, words = [-3, 0, 1, 2, 2.5, 9], ["a", "ab", "b", "abc", "é(", "zz", "."]

    def condition():
        path = rng.choice(["i", "d", "s", "l", "m.t", "m.n", "b", "none"])
        negate = rng.random() < 0.3
        if path in ("s", "m.t"):
            op = rng.choice(["=", "contains", "contains", "~", "in", ">"])
            return R(path, op, values=tuple(rng.sample(words, 2)), negate=negate) if op == "in" else R(path, op, re.escape(rng.choice(words)) if op == "~" else rng.choice([*words, None] if op == "=" else words), negate=negate)
        if path == "l":
            return R(path, rng.choice(["list_includes", "list_includes_regexp"]), rng.choice("abc"), negate=negate)
        if path == "b":
            return R(path, "=", rng.choice([True, False]), negate=negate)
        op = rng.choice(["=", ">", ">=", "<", "<=", "range", "in"])
        return R(path, op, values=tuple(sorted(rng.sample(numbers, 2))), negate=negate) if op in ("range", "in") else R(path, op, rng.choice(numbers), negate=negate)

    rules = [RoutingRule(1000 - i, tuple(condition() for _ in range(rng.choice([0, 1, 1, 2, 3])))) for i in range(150)] + [RoutingRule(5, (R("i", "=", 1),)), RoutingRule(5, (R("i", "=", 2),))]
    expected = {r.id: sorted(set(r.rule_ids)) for r in routing.match_rules(df, rules).collect() if r.rule_ids}
    assert len(expected) > 100
    for most in (20_000, 60):
        rule_index.MAX_RULES, kept = most, rule_index.MAX_RULES
        try:
            assert {r.id: r.rule_ids for r in rule_index.match_rules_index(df, rules).collect()} == expected
        finally:
            rule_index.MAX_RULES = kept
    assert rule_index.match_rules_index(df, []).count() == 0 and rule_index.match_rules_index(df, rules[:0] + [RoutingRule(1, (R("none", "=", 1),))]).columns == ["id", "rule_ids"]


def test_trie_patterns():
    needles = ["a", "ab", "abc", "b.c", "b.", "é(", "x"]
    found = re.findall(f"(?=({rule_index.trie_pattern(needles)}))", "zabcab.cé(xb.")
    assert found == ["abc", "ab", "b.c", "é(", "x", "b."]


def test_paths_are_read_together(spark):
    text = '{"level":"low","Level":"up","a":{"b":{"c":5}},"s":3,"x y":{"k":"q"},"l":[{"n":1}]}'
    df = mapping.as_variant(spark.createDataFrame([(1, text), (2, '{"a":{"b":7},"s":{"t":"u"},"l":{"n":4}}'), (3, None)], "id int, json string"), "json")
    paths = {"low": "$.level", "up": "$.Level", "whole": "$.a.b", "leaf": "$.a.b.c", "s": "$.s", "t": "$.s.t", "q": "$['x y'].k", "n": "$.l[0].n"}
    got = {r.id: r for r in mapping.map_events(df, [mapping.Field(k, "string", (v,)) for k, v in paths.items()], keep=("id",)).collect()}
    assert tuple(got[1]) == (1, "low", "up", '{"c":5}', "5", "3", "", "q", "1")
    assert tuple(got[2]) == (2, "", "", "7", "", '{"t":"u"}', "u", "", "") and set(got[3][1:]) == {""}
    plan = presets.map_metrics(df)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"variant_get\(event#", plan)) < 10  # not one for each of more than a hundred paths


def test_flat_maps_of_many_levels(spark):
    deep = lambda n: '{"k":' * n + "1" + "}" * n
    texts = [deep(12), deep(20), '{"a":{"b":1.50,"c":[{"x":1}],"d":null,"e":{}},"a.b":"top","t":"{\\"q\\":1}","big":123456789012345678901234567890,"f":1e300,"u":true}', "[1]", "x", None]
    df = mapping.as_variant(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, json string"), "json")
    field = [mapping.Field("all", "flat_map", ("$",))]
    rows = {r.id: r.all for r in mapping.map_events(df, field, keep=("id",)).collect()}
    assert rows[0] == {".".join("k" * 8): deep(4)} and rows[1] == {".".join("k" * 8): deep(12)}
    assert {r.id: r.all for r in mapping.map_events(df, field, keep=("id",), levels=12).collect()}[0] == {".".join("k" * 12): "1"}
    assert rows[2] == {"a.b": "top", "a.c": '[{"x":1}]', "t": '{"q":1}', "big": "123456789012345678901234567890", "f": "1.0E300", "u": "true"} and rows[3] == rows[4] == rows[5] == {}
    depth = nested_values.object_depth(df, "event")
    assert depth == 20 and {r.id: r.all for r in mapping.map_events(df, field, keep=("id",), levels=depth).collect()}[1] == {".".join("k" * 20): "1"}
    plan = mapping.map_events(df, field)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_paths_of_many_levels(spark):
    texts = ['{"a":{"b":[{"c":1},{"c":"x","d":[1,2.5]}],"e":[],"f":[[1]],"g":null},"h":[1,"x"],"i":[null,true],"j":1.5,"k":[{"l":{"m":[{"n":2}]}},3]}', '{"a":' * 14 + "7" + "}" * 14, "3", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, body string")
    found = {}
    for r in schema.variant_paths(df, "id", "body").collect():
        found.setdefault(r.key, set()).add((r.path, r.type))
    assert found["0"] == {("a", "map"), ("a.b", "map"), ("a.b.c", "integer"), ("a.b.c", "string"), ("a.b.d", "list<float>"), ("h", "list<variant>"), ("i", "list<boolean>"), ("j", "float"), ("k", "list<variant>"), ("k.l", "map"), ("k.l.m", "map"), ("k.l.m.n", "integer")}
    assert found["1"] == {(".".join("a" * n), "map") for n in range(1, 9)} and set(found) == {"0", "1"}


def test_expired_days_go(spark, tmp_path):
    """A day is first left out by readers, then its folder goes; a reader that has listed files reads on."""
    from logweir.sinks import tables

    path = str(tmp_path / "events")
    rows = [(str(i), dt.datetime(2024, 1, 1 + i % 10, 5)) for i in range(40)] + [("none", None)]
    tables.write_events(spark.createDataFrame(rows, "id string, timestamp timestamp_ntz"), path)
    reader = spark.read.parquet(path)
    days = lambda df: sorted({str(r.date) for r in df.select("date").collect()})
    folders = lambda: sorted(x.name for x in (tmp_path / "events").iterdir() if x.name.startswith("date="))
    today = dt.date(2024, 1, 11)
    assert tables.remove_expired(spark, path, 5, today, now=1000.0) == ([f"2024-01-0{d}" for d in range(1, 7)], [])
    assert days(tables.read_live(spark, path)) == ["2024-01-07", "2024-01-08", "2024-01-09", "2024-01-10", "None"] and len(folders()) == 11 and reader.count() == 41
    assert tables.remove_expired(spark, path, 5, today, now=1001.0) == ([], []) and len(folders()) == 11
    assert tables.remove_expired(spark, path, 4, today, now=1000.0 + tables.GRACE_SECONDS) == (["2024-01-07"], [f"2024-01-0{d}" for d in range(1, 7)])
    assert len(folders()) == 5 and days(tables.read_live(spark, path)) == ["2024-01-08", "2024-01-09", "2024-01-10", "None"]
    assert list(tables.expired_days(spark, path)) == ["2024-01-07"]


def test_mapping_computes_each_step_once(spark):
    texts = [' 7 ', 'true', '-1', '1e3', 'x', None, '99999999999999999999', '2.9']
    df = mapping.as_variant(spark.createDataFrame([(0, json.dumps({"list": texts, "n": " 300 ", "N": 4, "on": "yes"}))], "id long, json string"), "json")
    fields = [mapping.Field("many", "array_uint64", ("$.list",)), mapping.Field("some", "array_int32", ("$.list",), filter_nil=True), mapping.Field("one", "uint8", ("$.n",)), mapping.Field("other", "uint8", ("$.N",)), mapping.Field("on", "bool", ("$.on",))]
    out = mapping.map_events(df, fields, keep=("id",))
    got = out.first()
    assert [int(x) for x in got.many] == [7, 1, 0, 1000, 0, 0, 2**64 - 1, 2]
    assert got.some == [7, 1, -1, 1000, 0, 2**31 - 1, 2] and (got.one, got.other, got.on) == (255, 4, True)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(trim(") == len(fields)
