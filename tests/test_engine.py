import datetime
import math
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import values
from brindle.functions.types import default_of, diff, from_hints, parse_schema, parse_type, type_text
from brindle.operators.cast import CastError, cast_to
from brindle.operators.merge import merged
from brindle.operators.union import combined
from brindle.plans import ast as A
from brindle.plans.compile import BindError, compile_expression, filter_rows, glob_regex, run
from brindle.plans.parser import ParseError, parse, parse_statement
from brindle.plans.prune import ALWAYS, NEVER, Bounds, certainty, partition_split
from brindle.sources import avro, records, textlines
from brindle.sources.table import Catalog, Conflict, Table

ROUND = ["a = 1 and (b <> 2 or c is not null) and not d", "x between 1 and 2", "s like 'a%' escape '!'", "s not ilike '_b'", "a.b[0][-1]['k'] = 2", "-(a + b) * 3 - 4 / (5 % x)", "cast(a as decimal(9, 2)) > decimal(9, 2) '1.50'", "case when a then 1 else 2 end", "[1, 2]", "{'a': 1}", "struct(a as b, c as c)", "&holder.partition['y'] = '1'", ":p = 3", "x is not distinct from null", "a not in (1, 2)", "utf8 null", "get(a, -1)", "a - (b - c)", "(a or b) and c", "not (a and b)", "p glob 'x/**/y*'", '"odd name" = \'it\'\'s\'']


@pytest.mark.parametrize("source", ROUND)
def test_text_and_json_round_trip(source):
    e = parse(source)
    assert parse(str(e)) == e and A.from_json(A.to_json(e)) == e


@pytest.mark.parametrize("source", ["a in ()", "a rlike 'x'", "a -> b", "a[1:2]", "sqrt(a)", "lower()", "a =", "(a", "case a when 1 then 2 end", "concat_ws(',', a)", "(select a)", "a ; b", "(" * 70 + "a" + ")" * 70])
def test_refused_texts(source):
    with pytest.raises(ParseError):
        parse(source)


@pytest.mark.parametrize("source", ["select a from t", "select a group by b", "select", "select a limit x"])
def test_refused_statements(source):
    with pytest.raises(ParseError):
        parse_statement(source)


SCHEMA = parse_schema("i int64, j int32, f float64, d decimal(9,2), s utf8, b bool, t timestamptz, a list<int64>, x struct<leg: utf8>, m map<utf8, int64>")


@pytest.mark.parametrize("source", ["s > 1", "b = 1", "d + f", "nope = 1", "x.nope", "lower(i)", "s + s", "truncate(t, 'month')", "size(s)", "i and b", ":missing = 1", "coalesce(s, i)"])
def test_refused_types(spark, source):
    with pytest.raises(BindError):
        compile_expression(source, SCHEMA)


@pytest.mark.parametrize(("source", "kind"), [("j + 1", "int32"), ("i + j", "int64"), ("i + f", "float64"), ("d + d", "decimal(10, 2)"), ("d * d", "decimal(18, 4)"), ("d / d", "decimal(15, 6)"), ("length(s)", "int64"), ("year(t)", "int32"), ("[i, j]", "list<int64>"), ("j / 2", "int32"), ("d % d", "decimal(9, 2)")])
def test_result_types(spark, source, kind):
    t = compile_expression(source, SCHEMA)
    assert type_text(t.type) == kind
    df = spark.createDataFrame([], SCHEMA).select(t.col.alias("x"))
    assert df.schema["x"].dataType == t.type


def rows(spark):
    import decimal

    at = datetime.datetime(2023, 11, 14, 22, 13, 20)
    data = [(1, 1.5, decimal.Decimal("1.50"), "alpha", True, at), (-3, math.nan, decimal.Decimal("-0.25"), "beta", False, datetime.datetime(1970, 1, 1)), (None,) * 6, (100, math.inf, decimal.Decimal("100.00"), "Alpha", None, at), (0, 0.0, decimal.Decimal("0.00"), "", True, at)]
    return spark.createDataFrame(data, "i long, f double, d decimal(9,2), s string, b boolean, t timestamp")


@pytest.mark.parametrize(("source", "want"), [("i = 1", [1]), ("i <> 1", [-3, 0, 100]), ("i is null", [None]), ("not i = 1", [-3, 0, 100]), ("f = f", [-3, 0, 1, 100]), ("d = 1.5", [1]), ("s like 'a%'", [1]), ("s ilike 'a%'", [1, 100]), ("b", [0, 1]), ("i in (1, null)", [1]), ("i not in (1, null)", []), ("b is distinct from true", [-3, None, 100]), ("i between -3 and 0", [-3, 0]), ("b or i = 100", [0, 1, 100]), ("not (b and i > 0)", [-3, 0]), ("i / 0 is null", [-3, 0, None, 1, 100]), ("d / 3 = decimal(15,6) '0.500000'", [1])])
def test_predicates_keep_exactly_true_rows(spark, source, want):
    got = [r["i"] for r in filter_rows(rows(spark), source).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_arithmetic_nulls_on_overflow_and_truncates(spark):
    df = spark.createDataFrame([(2**63 - 1, -(2**63), -7, 2**31 - 1)], "a long, b long, c long, e int")
    got = run(df, "select a + 1 as p, -b as n, b / -1 as q, c / 2 as t, c % 2 as m, e + 1 as i, a * 2 as x, cast(2 as decimal(3,0)) / cast(3 as decimal(3,0)) as d, cast(-2 as decimal(3,0)) / cast(3 as decimal(3,0)) as g, 1.0 / 0 as inf").first()
    assert (got["p"], got["n"], got["q"], got["t"], got["m"], got["i"], got["x"]) == (None, None, None, -3, -1, None, None)
    assert (str(got["d"]), str(got["g"]), got["inf"]) == ("0.666666", "-0.666666", math.inf)


def test_substring_windows_and_negative_length(spark):
    df = spark.createDataFrame([("abcdef",)], "s string")
    got = run(df, "select substring(s,0,5) as a, substring(s,1,2) as b, substring(s,-3,2) as c, substring(s,-7,3) as d, substring(s,4,9) as e, substring(s,9,1) as f, trim(concat('  x ', ' ')) as t").first()
    assert tuple(got) == ("abcd", "ab", "de", "ab", "def", "", "x")
    with pytest.raises(Exception, match="negative length"):
        run(df, "select substring(s, 1, -1) as x").collect()


def test_order_defaults_put_nulls_last_then_first(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "a int")
    assert [r[0] for r in run(df, "select a order by a").collect()] == [1, 2, None]
    assert [r[0] for r in run(df, "select a order by a desc").collect()] == [None, 2, 1]
    assert "TakeOrderedAndProject" in run(df, "select a order by a limit 1")._jdf.queryExecution().executedPlan().toString()


def test_globs():
    import re

    assert re.search(glob_regex("*.csv"), "a/b/c.csv") and not re.search(glob_regex("a/*.csv"), "x/a/c.csv")
    assert re.search(glob_regex("a/**/c.csv"), "a/b/x/c.csv") and re.search(glob_regex("a/**/c.csv"), "a/c.csv")


# --- merge


def merge_of(spark, stored, incoming, keys=("k",)):
    s = spark.createDataFrame(stored, "k int, v string")
    i = spark.createDataFrame([(*r, n) for n, r in enumerate(incoming)], "k int, v string, n int")
    return sorted(map(tuple, merged(s, i, list(keys), "n").collect()), key=str)


@pytest.mark.parametrize(("stored", "incoming", "want"), [
    ([(1, "a")], [(1, "b")], [(1, "b")]), ([(1, "a")], [(2, "b")], [(1, "a"), (2, "b")]), ([(1, "a"), (1, "b")], [(1, "c")], [(1, "c"), (1, "c")]),
    ([(1, "a")], [(1, "b"), (1, "c")], [(1, "c")]), ([], [(1, "b"), (1, "c")], [(1, "c")]), ([(None, "a")], [(None, "b")], [(None, "b")]), ([(1, "a")], [(1, None)], [(1, None)]), ([(1, "a")], [], [(1, "a")]),
])
def test_merge_contract(spark, stored, incoming, want):
    assert merge_of(spark, stored, incoming) == sorted(want, key=str)


def test_merge_refuses_unknown_keys_and_repeats_without_order(spark):
    s = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError, match="key"):
        merged(s, s, ["z"])
    with pytest.raises(Exception, match="ordinal"):
        merged(s, s.union(s), ["k"]).collect()
    assert merged(s, s, ["k"]).collect() == s.collect()


# --- casts and unions


def test_safe_casts_default_required_fields(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    assert [r[0] for r in cast_to(df, parse_schema("a int64!")).collect()] == [1, 0, 0]
    assert [r[0] for r in cast_to(df, parse_schema("a int64")).collect()] == [1, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cast_to(df, parse_schema("a int64"), safe=False).collect()
    with pytest.raises(CastError):
        cast_to(df, parse_schema("a map<utf8, int64>"))
    with pytest.raises(CastError):
        cast_to(spark.createDataFrame([(1, 2)], "b int, c int").toDF("b", "B"), parse_schema("b int64"))


def test_union_refuses_type_conflicts(spark):
    with pytest.raises(ValueError, match="differ"):
        combined(spark.range(1), spark.createDataFrame([("x",)], "ID string"))


# --- schemas


def test_types_parse_print_and_default():
    for t in ("struct<a: int64!, b: list<decimal(9, 2)>>", "map<utf8, float64>", "timestamp_ntz", "date", "binary"):
        assert type_text(parse_type(t)) == t
    for bad in ("decimal(50,2)", "list<", "nope", "timestamp(ns)"):
        with pytest.raises(ValueError):
            parse_type(bad)
    assert default_of(parse_schema("a int64!, b utf8, c utf8!")) == (0, None, "")
    assert diff(parse_schema("a int64, b utf8!"), parse_schema("A int32, c utf8")) == ["~ a: int64 -> int32", "- b: utf8", "+ c: utf8"]

    class Row:
        a: int
        b: str | None
        c: list[float]

    assert from_hints(Row) == parse_schema("a int64!, b utf8, c list<float64!>!")


# --- pruning


def test_pruning_never_loses_a_row(spark):
    rng = random.Random(2)
    checks = ["a = {v}", "a <> {v}", "a < {v}", "a <= {v}", "a > {v}", "a >= {v}", "a in ({v}, 3)", "a between {v} and 7", "a is null", "a is not null", "not a = {v}", "a = {v} or a > 8", "a > 2 and a < {v}", "a is distinct from {v}", "a is not distinct from {v}", "{v} < a"]
    everything = [[rng.choice([None, *range(10)]) for _ in range(rng.randint(1, 4))] for _ in range(40)]
    df = spark.createDataFrame([(g, v) for g, vs in enumerate(everything) for v in vs], "g int, a long")
    for text in checks:
        e = parse(text.format(v=rng.randint(0, 9)))
        hit = {r["g"]: r["n"] for r in filter_rows(df, e).groupBy("g").agg(F.count("*").alias("n")).collect()}
        for g, vs in enumerate(everything):
            known = [v for v in vs if v is not None]
            b = Bounds(min(known, default=None), max(known, default=None), len(vs) - len(known), len(vs))
            said = certainty(e, {"a": b})
            assert not (said == NEVER and hit.get(g)), (text, vs)
            assert not (said == ALWAYS and hit.get(g, 0) != len(vs)), (text, vs)
    own, rest = partition_split(parse("y = 1 and price > 2 and y < m"), {"y", "m"})
    assert [str(x) for x in own] == ["y = 1", "y < m"] and [str(x) for x in rest] == ["price > 2"]


# --- records, files


def test_records_overwrite_append_merge_and_limits(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, symbol string")
    empty = records.read(spark, path, options=records.Options(schema=df.schema))
    assert empty.collect() == []
    records.write(df, path)
    records.append(spark.createDataFrame([("3", "c")], "id string, symbol string"), path)
    records.write(spark.createDataFrame([(2, "B"), (9, "n")], "id long, symbol string"), path, options=records.Options(merge_by_names=("id",)))
    assert sorted(map(tuple, records.read(spark, path).collect())) == [(1, "a"), (2, "B"), (3, "c"), (9, "n")]
    assert records.read(spark, path, options=records.Options(max_row_size=0)).collect() == []
    sizes = [records.read(spark, path, options=records.Options(max_byte_size=n)).count() for n in (0, 1, 60, 10_000)]
    assert sizes[0] == 0 and sizes[1] == 1 and sizes == sorted(sizes) and sizes[-1] == 4
    with pytest.raises(ValueError):
        records.Options(merge_by_names=("id",), max_row_size=1)
    with pytest.raises(ValueError):
        records.read(spark, path, options=records.Options(select_by_names=("nope",)))


def test_avro_values_and_files():
    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": ["null", "long"]}, {"name": "b", "type": {"type": "array", "items": "string"}}, {"name": "c", "type": {"type": "map", "values": "double"}}, {"name": "d", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}}]}
    import decimal

    data = [{"a": None if k % 3 == 0 else (-1) ** k * k**7, "b": ["x" * k], "c": {"k": k / 2}, "d": decimal.Decimal(k).scaleb(-2)} for k in range(300)]
    for codec in ("null", "deflate", "zstandard"):
        assert list(avro.rows_of(avro.container(schema, data, codec, block=70))) == data
    with pytest.raises(ValueError):
        list(avro.rows_of(avro.container(schema, data)[:-5]))
    assert avro.single_object("long", 5)[:2] == b"\xc3\x01" and avro.fingerprint('"int"') == 0x7275D51A3F395C8F


def test_text_records(spark, tmp_path):
    (tmp_path / "a.log").write_text("pre\n2024-01-02 03:04:05.123_456 [p-a1:b2:3] [lg] (INFO) hello 12\n cont\n2024-01-02T03:04:06+02:00 (ww) x 7\r\n")
    got = textlines.read_text_lines(spark, f"file://{tmp_path}/a.log", textlines.LineOptions("timestamp", True, r"(?P<word>\w+) (?P<n>\d+)")).orderBy("rownum").collect()
    assert [(r["rownum"], r["lines"], r["offset"]) for r in got] == [(1, 1, 0), (2, 2, 4), (3, 1, 71)]
    assert (got[1]["level"], got[1]["logger"], got[1]["thread"], got[1]["word"], got[1]["n"]) == ("INFO", "lg", "p-a1:b2:3", "hello", 12)
    assert got[1]["unix"] % 10**9 == 123456000 and got[1]["message"].endswith("12\n cont")
    assert got[2]["level"] == "WARN" and got[2]["unix"] == 1704157446 * 10**9
    assert [r["hash"] for r in got] == [values.fnv1a(r["message"].encode()) for r in got]


def test_values():
    assert values.fnv1a(b"") == 0xCBF29CE484222325 - (1 << 64)
    import struct

    assert values.wkb_text(struct.pack("<BIdd", 1, 1, 1.0, 2.5)) == "POINT (1 2.5)"
    assert values.placeholders({"a": ["x {{ N }}"]}, {"N": "1"}) == {"a": ["x 1"]}
    with pytest.raises(KeyError):
        values.placeholders("{{ M }}", {})
    assert values.load("a = 1", "toml") == {"a": 1} and values.load(values.dump({"a": [1]}, "yaml"), "yaml") == {"a": [1]}


# --- tables


def test_table_snapshots_refs_and_evolution(spark, tmp_path):
    schema = parse_schema("id int64!, symbol utf8, venue utf8")
    make = lambda rows: spark.createDataFrame(rows, "id long, symbol string, venue string")
    c = Catalog(spark, f"file://{tmp_path}/w")
    t = c.create("ns", "t", schema, ["venue"])
    assert c.namespaces() == ["ns"] and c.tables("ns") == ["t"] and t.scan().collect() == []
    with pytest.raises(Conflict):
        c.create("ns", "t", schema)
    t.append(make([(1, "a", "x"), (2, "b", "y"), (3, "c", None)]))
    first = t.snapshot()["snapshot-id"]
    t.create_ref("old", "tag")
    t.append(make([(4, "d", "z")]))
    p = t.plan("venue = 'x'")
    assert (len(p.files), p.skipped_files, p.skipped_manifests, p.residual) == (1, 3, 1, None)
    t.merge(make([(2, "B", "y"), (9, "n", "x")]), ["id"])
    assert sorted(tuple(r)[:2] for r in t.scan("id > 1").collect()) == [(2, "B"), (3, "c"), (4, "d"), (9, "n")]
    assert t.scan(ref=first).count() == t.scan(ref="old").count() == 3
    t.evolve(("rename", "symbol", "sym"), ("add", "px", "float64"))
    assert t.scan("sym = 'B'").columns == ["id", "sym", "venue", "px"] and t.scan("sym = 'B'").count() == 1
    with pytest.raises(ValueError):
        t.evolve(("type", "id", "utf8"))
    before = sorted(map(tuple, t.scan().collect()), key=str)
    t.compact()
    assert sorted(map(tuple, t.scan().collect()), key=str) == before
    t.overwrite(make([(7, "q", "y")]).withColumnRenamed("symbol", "sym"), "venue = 'y'")
    assert sorted(r["id"] for r in t.scan().collect()) == [1, 3, 4, 7, 9]
    assert t.history().count() == t.snapshots().count() == 5
    gone = t.expire_snapshots(1 << 60)
    assert gone == 3 and t.scan(ref="old").count() == 3
    base = t.metadata["current-snapshot-id"]
    t.append(make([(8, "w", "x")]).withColumnRenamed("symbol", "sym"))
    with pytest.raises(Conflict):
        t._swap("overwrite", set(), None, base)
    assert Table.open(spark, f"file://{tmp_path}/w/ns/t").scan().count() == 6
    assert isinstance(t.schema(), T.StructType)


def test_a_stream_runs_a_statement_and_takes_no_order(spark, tmp_path):
    from brindle import streaming

    spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string").write.parquet(str(tmp_path / "in"))
    stream = streaming.follow(spark, str(tmp_path / "in"), parse_schema("k int64, v utf8"), files_a_batch=1)
    streaming.keep(stream, "select k + 1 as n where v is not null", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 4]
    with pytest.raises(ValueError):
        streaming.keep(stream, "select k order by k limit 1", str(tmp_path / "x"), str(tmp_path / "y"))


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "brindle"), tmp_path / "brindle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_partition_transforms(spark):
    """Values of the published specification, nulls, times before 1970, and types that a transform does not take."""
    from brindle.functions.partitioning import ZERO_SEED, murmur3, partition_value

    assert murmur3(["iceberg".encode(), b"\x00\x01\x02\x03", None]).tolist() == [1210000089, -188683207, 0]
    first = spark.sql(f"select hash({ZERO_SEED}) as zero, hash({ZERO_SEED}, 34L) as l, hash({ZERO_SEED}, cast(unix_date(date '2017-11-16') as bigint)) as d").first()
    assert tuple(first) == (0, 2017239379, -653330422)
    df = spark.sql("select 34 as i, -7 as n, 'iceberg' as s, date '1969-12-31' as d, timestamp_ntz '1969-12-31 23:30:00' as t, cast(10.65 as decimal(9,2)) as c union all select null, null, null, null, null, null")
    told = {"i": ["bucket[100]", "identity", "void"], "n": ["truncate[10]"], "s": ["bucket[100]", "truncate[3]"], "d": ["year", "month", "day"], "t": ["year", "month", "day", "hour"], "c": ["truncate[50]"]}
    rows = df.select(*(partition_value(df, c, t).alias(f"{c} {t}") for c, ts in told.items() for t in ts)).collect()
    got = {k: str(v) for k, v in rows[0].asDict().items()}
    assert got == {"i bucket[100]": "79", "i identity": "34", "i void": "None", "n truncate[10]": "-10", "s bucket[100]": "89", "s truncate[3]": "ice", "d year": "-1", "d month": "-1", "d day": "-1", "t year": "-1", "t month": "-1", "t day": "-1", "t hour": "-1", "c truncate[50]": "10.50"}
    assert set(rows[1]) == {None}
    for c, t in (("c", "bucket[4]"), ("s", "day"), ("d", "hour"), ("t", "truncate[3]"), ("i", "bucket[0]"), ("i", "week")):
        with pytest.raises(ValueError):
            partition_value(df, c, t)


def test_listing_has_tables_that_are_folders(spark, tmp_path):
    import shutil

    from brindle import queries as Q
    from brindle.sources import files

    source = "/root/testdata/sf0.001"
    for n in sorted(os.listdir(source)):
        to = tmp_path / n
        if n in ("orders.parquet", "nation.parquet", "pages.parquet"):
            to.mkdir()
            to = to / "part-0000.parquet"
        shutil.copy(f"{source}/{n}", to)
    got = Q.s26_listing(spark, str(tmp_path)).collect()
    assert sorted((r["name"], r["stem"], r["extension"], r["some"]) for r in got) == [(n, n[:-8], "parquet", True) for n in sorted(os.listdir(source))]
    assert sorted(r["name"] for r in Q.s27_pruned_listing(spark, str(tmp_path)).collect()) == ["nation.parquet", "region.parquet"]
    (tmp_path / "empty.parquet").mkdir()
    flat = {r["name"]: (r["is_container"], r["size"]) for r in files.listing(spark, str(tmp_path), "*.parquet", recursive=False).collect()}
    assert flat["empty.parquet"] == (True, 0) and flat["region.parquet"] == (False, os.path.getsize(f"{source}/region.parquet"))
    assert flat["orders.parquet"] == (True, os.path.getsize(f"{source}/orders.parquet"))
    deep = {r["path"].split(tmp_path.name, 1)[1]: (r["is_container"], r["size"]) for r in files.listing(spark, str(tmp_path)).collect()}
    assert len(deep) == len(flat) + 3 and deep["/orders.parquet"] == flat["orders.parquet"] and deep["/orders.parquet/part-0000.parquet"] == (False, flat["orders.parquet"][1])
    assert [r["name"] for r in files.listing(spark, str(tmp_path), "orders.parquet/*").collect()] == ["part-0000.parquet"]
    assert files.listing(spark, str(tmp_path / "absent")).collect() == []


def test_measuring_data_files_sorts_nothing(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), parse_schema("id int64!, name utf8, x float64"))
    store = spark.sparkContext._jsc.sc().statusStore()
    empty = spark.sparkContext._jvm.java.util.ArrayList
    stages = lambda: {(s.stageId(), s.attemptId()): s.peakExecutionMemory() for s in (lambda q: (q.apply(i) for i in range(q.size())))(store.stageList(empty(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), empty()))}
    before = stages()
    t.append(spark.range(600_000).selectExpr("id", "case when id % 7 = 0 then null else concat('n', id % 1000) end as name", "case when id = 5 then double('nan') else id / 2 end as x").coalesce(1))
    assert max((v for k, v in stages().items() if k not in before), default=0) < 16 << 20
    (f,) = t.plan().files
    assert f["rows"] == 600_000 and [r["id"] for r in t.scan("name = 'n999' and id < 3000").collect()] == [999, 1999, 2999]
    assert t.plan("name = 'o'").files == [] and len(t.plan("name = 'n0'").files) == 1


def test_files_of_a_partition_grow_in_number(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), parse_schema("id int64!, name utf8, __bucket utf8, p utf8"), ["p"])
    rows = spark.range(0, 200_000, 1, 8).selectExpr("id", "sha2(string(id), 256) as name", "'b' as __bucket", "'p' as p")
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        t.append(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    files = t.plan().files
    assert len(files) > 8 and sum(f["rows"] for f in files) == 200_000 and max(f["rows"] for f in files) < 40_000
    assert t.scan().exceptAll(rows).isEmpty() and t.scan().count() == 200_000
