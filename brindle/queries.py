"""The queries of the engine's own operators, each over whole tables, with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle import streaming
from brindle.functions import instants, types, values
from brindle.functions.partitioning import partition_value
from brindle.functions.types import parse_schema, parse_type, type_text
from brindle.operators import union
from brindle.operators.cast import cast_to
from brindle.operators.merge import merged
from brindle.plans.compile import filter_rows, run
from brindle.sources import avro, files, ipc, records, textlines
from brindle.sources.table import Table

_KEY = "l_orderkey, l_linenumber"

#: name: (table, statement, SQL). Statements are written in the engine's own language.
STATEMENTS: dict[str, tuple[str, str, str]] = {
    "e01_literal": ("orders", "select o_orderkey, 7 as i, 1.5 as f, 'x' as s, decimal(9,2) '1.50' as d, date '2024-02-29' as day, true as b", "select o_orderkey, 7::bigint as i, 1.5::double as f, 'x' as s, 1.50::decimal(9,2) as d, date '2024-02-29' as day, true as b from orders"),
    "e02_column": ("customer", "select C_CUSTKEY, c_name", "select c_custkey as \"C_CUSTKEY\", c_name from customer"),
    "e06_and": ("lineitem", f"select {_KEY} where l_returnflag = 'R' and l_quantity > 30 and l_discount < 0.05", f"select {_KEY} from lineitem where l_returnflag = 'R' and l_quantity > 30 and l_discount < 0.05"),
    "e07_or": ("lineitem", f"select {_KEY} where l_quantity < 5 or l_tax = 0.08", f"select {_KEY} from lineitem where l_quantity < 5 or l_tax = 0.08"),
    "e08_not": ("lineitem", f"select {_KEY} where not l_linestatus = 'O'", f"select {_KEY} from lineitem where not l_linestatus = 'O'"),
    "e09_eq": ("lineitem", f"select {_KEY} where l_linenumber = 3", f"select {_KEY} from lineitem where l_linenumber = 3"),
    "e10_ne": ("lineitem", f"select {_KEY} where l_returnflag <> 'N'", f"select {_KEY} from lineitem where l_returnflag <> 'N'"),
    "e11_lt": ("lineitem", f"select {_KEY} where l_extendedprice < 5000", f"select {_KEY} from lineitem where l_extendedprice < 5000"),
    "e12_le": ("lineitem", f"select {_KEY} where l_quantity <= 10", f"select {_KEY} from lineitem where l_quantity <= 10"),
    "e13_gt": ("orders", "select o_orderkey where o_orderdate > timestamp_ntz '1997-06-01 00:00:00'", "select o_orderkey from orders where o_orderdate > timestamp '1997-06-01 00:00:00'"),
    "e14_ge": ("lineitem", f"select {_KEY} where l_quantity >= 45", f"select {_KEY} from lineitem where l_quantity >= 45"),
    "e15_distinct_from": ("orders", "select o_orderkey where case when o_orderstatus = 'O' then null else o_orderstatus end is distinct from 'F'", "select o_orderkey from orders where case when o_orderstatus = 'O' then null else o_orderstatus end is distinct from 'F'"),
    "e16_not_distinct_from": ("orders", "select o_orderkey where case when o_orderstatus = 'O' then null else o_orderstatus end is not distinct from null", "select o_orderkey from orders where case when o_orderstatus = 'O' then null else o_orderstatus end is not distinct from null"),
    "e17_in": ("lineitem", f"select {_KEY} where l_linenumber in (1, 4) and l_returnflag not in ('N')", f"select {_KEY} from lineitem where l_linenumber in (1, 4) and l_returnflag not in ('N')"),
    "e18_between": ("lineitem", f"select {_KEY} where l_quantity between 10 and 20 and l_discount not between 0.02 and 0.05", f"select {_KEY} from lineitem where l_quantity between 10 and 20 and l_discount not between 0.02 and 0.05"),
    "e19_is_null": ("orders", "select o_orderkey where case when o_orderkey % 3 = 0 then o_custkey end is null", "select o_orderkey from orders where case when o_orderkey % 3 = 0 then o_custkey end is null"),
    "e20_is_not_null": ("orders", "select o_orderkey where case when o_orderkey % 3 = 0 then o_custkey end is not null", "select o_orderkey from orders where case when o_orderkey % 3 = 0 then o_custkey end is not null"),
    "e21_like": ("part", "select p_partkey where p_name like '%a_e%' or p_type not like '%E%'", "select p_partkey from part where p_name like '%a_e%' or p_type not like '%E%'"),
    "e22_ilike": ("customer", "select c_custkey where c_mktsegment ilike 'b%'", "select c_custkey from customer where c_mktsegment ilike 'b%'"),
    "e23_glob": ("customer", "select c_custkey where concat('seg/', c_mktsegment) glob 'seg/[AB]*'", "select c_custkey from customer where regexp_matches(c_mktsegment, '^[AB][^/]*$')"),
    "e24_arithmetic": ("lineitem", f"select {_KEY}, l_linenumber + 10 as a, l_orderkey * 2 - 1 as b, l_orderkey / 7 as c, (3 - l_orderkey) % 5 as d, l_extendedprice * (1 - l_discount) as e, l_quantity / (l_linenumber - 1) as f", f"select {_KEY}, (l_linenumber + 10)::int as a, (l_orderkey * 2 - 1)::bigint as b, (l_orderkey // 7)::bigint as c, ((3 - l_orderkey) % 5)::bigint as d, l_extendedprice * (1 - l_discount) as e, case when l_linenumber = 1 then 'inf'::double else l_quantity / (l_linenumber - 1) end as f from lineitem"),
    "e24_decimal": ("lineitem", f"select {_KEY}, cast(l_extendedprice as decimal(12,2)) + cast(l_tax as decimal(4,2)) as s, cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2)) as m", f"select {_KEY}, (l_extendedprice::decimal(12,2) + l_tax::decimal(4,2))::decimal(13,2) as s, (l_extendedprice::decimal(12,2) * l_tax::decimal(4,2))::decimal(16,4) as m from lineitem"),
    "e24_decimal_div": ("lineitem", f"select {_KEY}, cast(l_extendedprice as decimal(12,2)) / cast(l_quantity as decimal(6,2)) as q", f"select {_KEY}, ((((l_extendedprice::decimal(12,2) * 100)::hugeint * 1000000) // (l_quantity::decimal(6,2) * 100)::hugeint)::decimal(38,0) * 0.000001::decimal(7,6))::decimal(18,6) as q from lineitem"),
    "e24_overflow": ("orders", "select o_orderkey, o_orderkey + 9223372036854775807 as a, o_orderkey / 0 as b, o_orderkey % 0 as c", "select o_orderkey, case when o_orderkey <= 0 then o_orderkey + 9223372036854775807 end as a, null::bigint as b, null::bigint as c from orders"),
    "e25_negate": ("lineitem", f"select {_KEY}, -l_orderkey as a, -(l_quantity) as b", f"select {_KEY}, -l_orderkey as a, -l_quantity as b from lineitem"),
    "e27_cast": ("orders", "select o_orderkey, cast(o_totalprice as bigint) as a, cast(o_custkey as utf8) as b, cast(o_orderdate as date) as c, cast(o_totalprice as decimal(14,1)) as d", "select o_orderkey, trunc(o_totalprice)::bigint as a, o_custkey::varchar as b, o_orderdate::date as c, o_totalprice::decimal(14,1) as d from orders"),
    "e28_try_cast": ("orders", "select o_orderkey, try_cast(o_orderpriority as bigint) as a, try_cast(substring(o_orderpriority, 1, 1) as int32) as b", "select o_orderkey, try_cast(o_orderpriority as bigint) as a, try_cast(substr(o_orderpriority, 1, 1) as int) as b from orders"),
    "e29_case": ("orders", "select o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 100000 then 'mid' end as c", "select o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 100000 then 'mid' end as c from orders"),
    "e30_struct": ("orders", "select o_orderkey, struct(o_custkey as c, o_orderstatus as s).c as c, struct(o_custkey as c, o_orderstatus as s).s as s", "select o_orderkey, o_custkey as c, o_orderstatus as s from orders"),
    "e31_list": ("lineitem", f"select {_KEY}, [l_orderkey, l_partkey, l_suppkey][-1] as z, [l_orderkey, l_partkey][0] as a, [l_orderkey][5] as n", f"select {_KEY}, l_suppkey as z, l_orderkey as a, null::bigint as n from lineitem"),
    "e32_map": ("orders", "select o_orderkey, {'F': 1, 'O': 2}['F'] as f, get({'F': 1, 'O': 2}, o_orderstatus) as g", "select o_orderkey, 1::bigint as f, case o_orderstatus when 'F' then 1 when 'O' then 2 end::bigint as g from orders"),
    "e33_star": ("nation", "select *, n_regionkey + 1 as next", "select *, (n_regionkey + 1)::int as next from nation"),
    "f01_lower": ("customer", "select c_custkey, lower(c_mktsegment) as x", "select c_custkey, lower(c_mktsegment) as x from customer"),
    "f02_upper": ("part", "select p_partkey, ucase(p_name) as x", "select p_partkey, upper(p_name) as x from part"),
    "f03_trim": ("part", "select p_partkey, trim(concat('  ', p_name, '   ')) as x", "select p_partkey, trim(p_name) as x from part"),
    "f04_length": ("documents", "select doc_id, length(text) as n", "select doc_id, length(text)::bigint as n from documents"),
    "f05_substring": ("part", "select p_partkey, substring(p_name, 2, 3) as a, substring(p_name, 0, 5) as b, substring(p_name, -3) as c, substring(p_name, 4) as d", "select p_partkey, substr(p_name, 2, 3) as a, substr(p_name, 1, 4) as b, right(p_name, 3) as c, substr(p_name, 4) as d from part"),
    "f06_starts_with": ("part", "select p_partkey where starts_with(p_brand, 'Brand#1')", "select p_partkey from part where starts_with(p_brand, 'Brand#1')"),
    "f07_ends_with": ("part", "select p_partkey where ends_with(p_brand, '3')", "select p_partkey from part where suffix(p_brand, '3')"),
    "f08_contains": ("documents", "select doc_id where contains(text, 'License')", "select doc_id from documents where contains(text, 'License')"),
    "f09_concat": ("nation", "select n_nationkey, concat(n_name, '-', cast(n_regionkey as utf8)) as x", "select n_nationkey, n_name || '-' || n_regionkey::varchar as x from nation"),
    "f10_year": ("orders", "select o_orderkey, year(o_orderdate) as y", "select o_orderkey, year(o_orderdate)::int as y from orders"),
    "f11_month": ("orders", "select o_orderkey, month(o_orderdate) as m", "select o_orderkey, month(o_orderdate)::int as m from orders"),
    "f12_day": ("orders", "select o_orderkey, dayofmonth(o_orderdate) as d", "select o_orderkey, day(o_orderdate)::int as d from orders"),
    "f13_hour": ("events", "select event_id, hour(ts) as h", "select event_id, hour(ts)::int as h from events"),
    "f14_truncate": ("events", "select event_id, truncate(ts, 'hour') as h, truncate(event_id, 10) as t, truncate(3 - event_id, 7) as n, truncate(event_id, 0) as z", "select event_id, date_trunc('hour', ts)::timestamp as h, (event_id // 10 * 10)::bigint as t, ((3 - event_id) - (((3 - event_id) % 7) + 7) % 7)::bigint as n, null::bigint as z from events"),
    "f15_coalesce": ("orders", "select o_orderkey, coalesce(case when o_orderkey % 2 = 0 then o_custkey end, o_orderkey, 0) as x", "select o_orderkey, coalesce(case when o_orderkey % 2 = 0 then o_custkey end, o_orderkey, 0)::bigint as x from orders"),
    "f16_if_null": ("orders", "select o_orderkey, nvl(case when o_orderstatus = 'F' then 'x' end, 'none') as x", "select o_orderkey, ifnull(case when o_orderstatus = 'F' then 'x' end, 'none') as x from orders"),
    "f17_size": ("embeddings", "select vec_id, size(embedding) as n", "select vec_id, len(embedding)::bigint as n from embeddings"),
    "f18_get": ("embeddings", "select vec_id, get(embedding, label) as v, embedding[-1] as l, get(embedding, 1000) as o", "select vec_id, embedding[label + 1] as v, embedding[-1] as l, null::float as o from embeddings"),
    "q02_filter": ("lineitem", "select * where l_shipdate >= timestamp_ntz '1998-01-01 00:00:00' and l_returnflag = 'N'", "select * from lineitem where l_shipdate >= timestamp '1998-01-01' and l_returnflag = 'N'"),
    "q03_project": ("lineitem", f"select {_KEY}, l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge", f"select {_KEY}, l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge from lineitem"),
    "q05_top_k": ("lineitem", f"select {_KEY}, l_extendedprice order by l_extendedprice desc, l_orderkey, l_linenumber limit 100", f"select {_KEY}, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 100"),
    "q05_null_order": ("orders", "select o_orderkey order by case when o_orderstatus = 'F' then o_custkey end desc, o_orderkey limit 50", "select o_orderkey from orders order by case when o_orderstatus = 'F' then o_custkey end desc nulls first, o_orderkey limit 50"),
    "q06_evaluate": ("lineitem", f"select {_KEY}, l_quantity > 25 and l_discount > 0.04 as hit", f"select {_KEY}, l_quantity > 25 and l_discount > 0.04 as hit from lineitem"),
}

FLAGSHIP = f"select {_KEY}, l_quantity * l_extendedprice as v where l_returnflag = 'R' and l_shipdate >= :since order by l_quantity * l_extendedprice desc, l_orderkey, l_linenumber limit 10"
FLAGSHIP_SQL = f"select {_KEY}, l_quantity * l_extendedprice as v from lineitem where l_returnflag = 'R' and l_shipdate >= timestamp '1995-01-01' order by v desc, l_orderkey, l_linenumber limit 10"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    return run(table(spark, sf_dir, "lineitem"), FLAGSHIP, {"since": datetime.datetime(1995, 1, 1)})


def _work(spark: SparkSession, what: str) -> str:
    """A folder of this query alone: under spark.checkpoint.dir, which executors share, else (tests) under the warehouse, which they share too."""
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/brindle-work"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def e04_attribute(spark, sf_dir):
    return run(table(spark, sf_dir, "nation"), "select n_nationkey, &holder.name as name, &holder.extension as ext where &holder.stem = 'nation'")


def e05_parameter(spark, sf_dir):
    return run(table(spark, sf_dir, "orders"), "select o_orderkey, :p + 1 as q where o_custkey = :c or o_orderstatus = :s", {"p": 41, "c": 7, "s": "P"})


def u1_union_by_name(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return union.combined(n.select(F.col("n_nationkey").alias("Key"), F.col("n_name").alias("name")), r.select(F.col("r_regionkey").alias("key"), F.lit("r").alias("kind")))


def u2_union_as(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return union.combined_as(n.selectExpr("n_nationkey as key", "n_name as name"), r.selectExpr("cast(r_regionkey as string) as key"), parse_schema("key int64, name utf8!"))


def u3_append_chain(spark, sf_dir):
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey as key", "n_name as name")
    return union.appended(n, table(spark, sf_dir, "region").selectExpr("cast(r_regionkey as bigint) as KEY", "r_name as name", "1 as extra"))


def c1_cast(spark, sf_dir):
    return cast_to(table(spark, sf_dir, "orders"), parse_schema("o_orderpriority int64!, O_ORDERKEY utf8, o_totalprice decimal(12,1), missing int32!, gone utf8"))


def c3_nested_cast(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b")).alias("s"), F.array("o_orderstatus", F.col("o_custkey").cast("string")).alias("l"))
    out = cast_to(rows, parse_schema("o_orderkey int64, s struct<b: utf8, a: utf8, c: int64!>, l list<int64!>"))
    return out.select("o_orderkey", F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.col("s.c").alias("c"), F.col("l")[0].alias("x"), F.col("l")[1].alias("y"))


def o2_shaped_read(spark, sf_dir):
    return records.read(spark, f"{sf_dir}/orders.parquet", options=records.Options(select_by_names=("O_TOTALPRICE", "o_orderkey"), filter_partitions=(("o_orderstatus", "F"),)))


def s04_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    news = orders.where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("U").alias("o_orderstatus"), F.lit(1).alias("o"))
    late = orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey"), F.lit(0).cast("bigint").alias("o_custkey"), F.lit("L").alias("o_orderstatus"), F.lit(2).alias("o"))
    fresh = orders.where("o_orderkey % 7 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), F.lit(3).alias("o"))
    return merged(orders, news.unionAll(late).unionAll(fresh), ["o_orderkey"], "o")


def s06_partitioned_folder(spark, sf_dir):
    path = _work(spark, "folder")
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderstatus", T.StringType(), True, {"partition": True})])
    records.write(table(spark, sf_dir, "orders"), path, options=records.Options(schema=schema))
    return records.read(spark, path, options=records.Options(schema=schema, filter_partitions=(("o_orderstatus", "O"),)))


def s14_ipc(spark, sf_dir):
    path = _work(spark, "ipc")
    ipc.write(table(spark, sf_dir, "customer"), path)
    return ipc.read(spark, path)


def s15_avro(spark, sf_dir):
    path = _work(spark, "avro")
    avro.write(table(spark, sf_dir, "supplier"), path)
    return avro.read(spark, path)


def s18_text_lines(spark, sf_dir):
    texts = table(spark, sf_dir, "events").select(F.col("event_id").alias("u"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" (WARN) user "), "user_id", F.lit("\n more")).alias("t"))
    return textlines.records_of(texts, "u", "t", textlines.LineOptions("timestamp", True, r"user (?P<user>\d+)")).select("url", "rownum", "date", "unix", "level", "user", "lines", F.col("offset").alias("at"))


def _snapshot_table(spark, sf_dir) -> Table:
    t = Table.create(spark, _work(spark, "table"), parse_schema("o_orderkey int64!, o_custkey int64, o_orderstatus utf8"), ["o_orderstatus"])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    t.append(orders.where("o_orderkey % 2 = 0"))
    t.append(orders.where("o_orderkey % 2 = 1"))
    return t


def i02_scan(spark, sf_dir):
    return _snapshot_table(spark, sf_dir).scan("o_orderstatus = 'F' and o_custkey > 20")


def i04_time_travel(spark, sf_dir):
    t = _snapshot_table(spark, sf_dir)
    return t.scan(ref=t.metadata["snapshots"][0]["snapshot-id"])


def i06_overwrite_where(spark, sf_dir):
    t = _snapshot_table(spark, sf_dir)
    t.overwrite(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("F").alias("o_orderstatus")), "o_orderstatus = 'F'")
    return t.scan()


def i07_table_merge(spark, sf_dir):
    t = _snapshot_table(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    news = orders.select("o_orderkey", (-F.col("o_custkey")).alias("o_custkey"), "o_orderstatus")
    t.merge(news.unionAll(orders.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), "o_custkey", "o_orderstatus")), ["o_orderkey"])
    return t.scan()


def i08_compact(spark, sf_dir):
    t = _snapshot_table(spark, sf_dir)
    t.compact()
    return t.scan("o_orderkey > 10")


def i09_evolve(spark, sf_dir):
    t = _snapshot_table(spark, sf_dir)
    t.evolve(("rename", "o_custkey", "cust"), ("add", "note", "utf8"), ("nullable", "o_orderkey"))
    return t.scan("cust > 10")


def e03_path(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("key"), F.struct(F.col("o_orderstatus").alias("code")).alias("status")).alias("Of"), F.array("o_totalprice").alias("l"))
    return run(rows, "select o_orderkey, of.key as k, of.status.code as c, l[0] as p where of.status.code <> 'P'")


def q08_text_round_trip(spark, sf_dir):
    from brindle.plans.parser import parse

    where = "not (l_quantity between 10 and 40) and (l_returnflag in ('R', 'A') or l_tax > 0.05) and l_discount is not null"
    return filter_rows(table(spark, sf_dir, "lineitem"), parse(str(parse(str(parse(where)))))).select("l_orderkey", "l_linenumber")


def s02_read_schema(spark, sf_dir):
    schema = records.read_schema(spark, f"{sf_dir}/nation.parquet")
    return spark.createDataFrame([(f.name, type_text(f.dataType)) for f in schema], "name string, type string")


def s05_append(spark, sf_dir):
    path, orders = _work(spark, "append"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    records.write(orders.where("o_orderstatus = 'F'"), path)
    records.append(orders.where("o_orderstatus <> 'F'").select(F.col("o_orderstatus").alias("O_ORDERSTATUS"), F.col("o_orderkey").cast("string"), "o_custkey"), path)
    return records.read(spark, path)


def s16_avro_blocks(spark, sf_dir):
    """Nation is a fixed table of a few rows, so one container on the driver holds it."""
    rows = [r.asDict() for r in table(spark, sf_dir, "nation").collect()]
    schema = {"type": "record", "name": "nation", "fields": [{"name": "n_nationkey", "type": "int"}, {"name": "n_name", "type": "string"}, {"name": "n_regionkey", "type": "int"}]}
    raw = avro.container(schema, rows, "zstandard", block=7)
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in avro.rows_of(raw)], "n_nationkey int, n_name string, n_regionkey int")


def s22_structured_text(spark, sf_dir):
    rows = [r.asDict() for r in table(spark, sf_dir, "region").collect()]
    back = values.load(values.dump(values.load(values.dump(rows, "jsonl"), "jsonl"), "json"), "json")
    return spark.createDataFrame([(r["r_regionkey"], r["r_name"]) for r in back], "r_regionkey int, r_name string")


def o04_row_limit(spark, sf_dir):
    return records.read(spark, f"{sf_dir}/orders.parquet", options=records.Options(max_row_size=100)).agg(F.count(F.lit(1)).alias("n"))


def o05_byte_limit(spark, sf_dir):
    few = [records.read(spark, f"{sf_dir}/orders.parquet", options=records.Options(max_byte_size=n)).agg(F.count(F.lit(1)).alias("n")) for n in (0, 1)]
    return few[0].unionAll(few[1])


def o07_merge_write(spark, sf_dir):
    path, orders = _work(spark, "merge"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    records.write(orders.where("o_orderstatus <> 'P'"), path)
    records.append(orders.select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("N").alias("o_orderstatus")), path, options=records.Options(merge_by_names=("o_orderkey",)))
    return records.read(spark, path)


def c4_strict_cast(spark, sf_dir):
    return cast_to(table(spark, sf_dir, "orders"), parse_schema("o_orderkey utf8, o_totalprice decimal(14,3), o_orderdate date"), safe=False)


def _texts(spark, texts):
    return spark.createDataFrame([(t, type_text(parse_type(t))) for t in texts], "given string, said string")


def t1_type_texts(spark, sf_dir):
    return _texts(spark, ["int64", "utf8", "decimal(9, 2)", "list<int32!>", "map<utf8, float64>", "struct<a: int8!, b: list<utf8>>"])


def t4_field_ids(spark, sf_dir):
    schema = types.assign_ids(table(spark, sf_dir, "nation").schema)
    return spark.createDataFrame([(n, types.field_by_id(schema, n).name) for n in range(1, len(schema) + 1)], "id int, name string")


def t6_marked_partitions(spark, sf_dir):
    schema = types.mark_partitions(table(spark, sf_dir, "orders").schema, ["O_ORDERSTATUS"])
    rest = types.without_fields(schema, ["o_orderdate", "O_orderpriority"])
    return spark.createDataFrame([(f.name, f.name in types.partition_names(schema)) for f in rest], "name string, is_partition boolean")


def t9_capture_schema(spark, sf_dir):
    found = textlines.capture_schema(r"(?P<user>\d+) took (?P<took>\d+\.\d+) in (?P<place>\w+)")
    return spark.createDataFrame([(f.name, type_text(f.dataType)) for f in found], "name string, type string")


def x7_hash_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", values.hash_text("p_name").alias("h"))


def st_stream_rows(spark, sf_dir):
    path = _work(spark, "stream")
    stream = streaming.follow(spark, sf_dir, table(spark, sf_dir, "orders").schema, names="orders.parquet")
    streaming.keep(stream, "select o_orderkey, o_totalprice * 2 as twice where o_orderstatus = 'F'", f"{path}/rows", f"{path}/state").awaitTermination()
    return spark.read.schema("o_orderkey bigint, twice double").parquet(f"{path}/rows")


def i03_plan(spark, sf_dir):
    plan = _snapshot_table(spark, sf_dir).plan("o_orderstatus = 'F' and o_custkey > 20")
    return spark.createDataFrame([(f["partition"]["o_orderstatus"], f["rows"]) for f in plan.files], "status string, n long").groupBy("status").agg(F.sum("n").alias("n"))


def i12_branch(spark, sf_dir):
    t = _snapshot_table(spark, sf_dir)
    t.create_ref("then")
    t.overwrite(table(spark, sf_dir, "orders").select("o_orderkey", F.lit(0).cast("bigint").alias("o_custkey"), "o_orderstatus"))
    before = t.scan(ref="then").withColumn("at", F.lit("branch"))
    t.create_ref("now", "tag")
    return before.unionByName(t.scan(ref="now").withColumn("at", F.lit("tag")))


def i13_expire(spark, sf_dir):
    t = _snapshot_table(spark, sf_dir)
    gone = t.expire_snapshots(1 << 60)
    return t.scan("o_orderstatus = 'O'").withColumn("expired", F.lit(gone))


def i14_history(spark, sf_dir):
    h = _snapshot_table(spark, sf_dir)
    return h.snapshots().join(h.history().select("snapshot_id", "is_current_ancestor"), "snapshot_id").groupBy("operation", "is_current_ancestor").agg(F.count(F.lit(1)).alias("n"))


def s20_raw_lines(spark, sf_dir):
    path = _work(spark, "lines")
    files.append_lines(table(spark, sf_dir, "documents").select("text"), path, "text")
    return files.read_lines(spark, path, "License").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def s23_codings(spark, sf_dir):
    names = files.codings("a.csv.gz.zz.zst")
    raw = table(spark, sf_dir, "part").select("p_partkey", files.coded(F.encode("p_name", "UTF-8"), names).alias("z"))
    return raw.select("p_partkey", F.decode(files.coded("z", names, back=True), "UTF-8").alias("name"))


def s25_media_types(spark, sf_dir):
    path = f"{sf_dir}/region.parquet"
    head = files.read_range(spark, path, 0, 4)
    told = [("a.csv.gz", files.media_type("a.csv.gz")), ("x", files.media_type("x", head)), ("y", files.media_type("y", b"??"))]
    return spark.createDataFrame(told, "name string, media string")


def s26_listing(spark, sf_dir):
    return files.listing(spark, sf_dir, "*.parquet", recursive=False).select("name", "stem", "extension", (F.col("size") > 0).alias("some"))


def s27_pruned_listing(spark, sf_dir):
    found = files.listing(spark, sf_dir, "*.parquet", recursive=False)
    return files.matching(found, "stem in ('nation', 'region') and size > 0 and n_nationkey = 3").select("name")


def t8_table_schema(spark, sf_dir):
    schema = table(spark, sf_dir, "embeddings").schema
    found = types.table_json(schema)
    back = types.from_table_json(found)
    return spark.createDataFrame([(f["id"], f["name"], f["type"] if isinstance(f["type"], str) else f["type"]["type"], type_text(b.dataType)) for f, b in zip(found["fields"], back, strict=True)], "id int, name string, kind string, type string")


def t14_zones(spark, sf_dir):
    ts = table(spark, sf_dir, "events").select("event_id", "ts")
    local = instants.to_local("ts", "Asia/Kolkata")
    return ts.select("event_id", local.alias("there"), instants.offset_at("ts", "Asia/Kolkata").alias("ahead"), instants.to_utc(local, "Asia/Kolkata").alias("back"))


def t15_iso(spark, sf_dir):
    ts = table(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("P1DT"), F.col("user_id"), F.lit("M2.5S")).alias("d"))
    return ts.select("event_id", instants.iso_timestamp("ts").alias("iso"), instants.parse_iso_timestamp(instants.iso_timestamp("ts")).alias("back"), instants.parse_iso_duration("d").alias("seconds"), instants.parse_iso_duration(F.lit("P")).alias("none"))


def t16_url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *(v.alias(k) for k, v in files.url_parts(F.concat(F.lit("https://h.example:8/a/"), F.col("page_id"), F.lit("/b.tar.GZ?q=1"))).items()))


def i11_transforms(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    told = {"b": ("o_orderkey", "bucket[16]"), "k": ("o_orderkey", "truncate[10]"), "s": ("c_name", "truncate[12]"), "y": ("o_orderdate", "year"), "m": ("o_orderdate", "month"), "d": ("o_orderdate", "day"), "v": ("c_name", "void")}
    return orders.select("o_orderkey", *(partition_value(orders, c, t).alias(name) for name, (c, t) in told.items()))


def i14_files(spark, sf_dir):
    return _snapshot_table(spark, sf_dir).files().groupBy(F.col("partition")["o_orderstatus"].alias("status")).agg(F.sum("record_count").alias("n"))


#: Published 32-bit Murmur3 of a key below 2^32 as 8 bytes, in steps.
_BUCKET_SQL = """with a as (select *, (o_orderkey::hugeint * 3432918353 % 4294967296)::bigint as x from orders join customer on o_custkey = c_custkey),
b as (select *, (((x << 15) | (x >> 17)) & 4294967295)::hugeint * 461845907 % 4294967296 as x2 from a),
c as (select *, ((((x2::bigint << 13) | (x2::bigint >> 19)) & 4294967295) * 5 + 3864292196) & 4294967295 as h from b),
d as (select *, xor(((((h << 13) | (h >> 19)) & 4294967295) * 5 + 3864292196) & 4294967295, 8) as g from c),
e as (select *, (xor(g, g >> 16)::hugeint * 2246822507 % 4294967296)::bigint as g2 from d),
f as (select *, (xor(g2, g2 >> 13)::hugeint * 3266489909 % 4294967296)::bigint as g3 from e)
select o_orderkey, ((xor(g3, g3 >> 16) & 2147483647) % 16)::int as b, o_orderkey - o_orderkey % 10 as k, substr(c_name, 1, 12) as s, (year(o_orderdate) - 1970)::int as y,
((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1)::int as m, (o_orderdate::date - date '1970-01-01')::int as d, null::varchar as v from f"""

_MERGE_SQL = """with inc as (select o_orderkey as k, o_custkey + 1 as c, 'U' as s, 1 as o from orders where o_orderkey % 5 = 0 union all select o_orderkey, 0, 'L', 2 from orders where o_orderkey % 10 = 0
union all select -o_orderkey, o_custkey, 'N', 3 from orders where o_orderkey % 7 = 0),
last as (select k, arg_max(c, o) as c, arg_max(s, o) as s from inc group by k)
select coalesce(a.o_orderkey, l.k) as o_orderkey, case when l.k is null then a.o_custkey else l.c end::bigint as o_custkey, case when l.k is null then a.o_orderstatus else l.s end as o_orderstatus from orders a full join last l on a.o_orderkey = l.k"""

_FNV_SQL = """with b as (select p_partkey, list_prepend(14695981039346656037::uhugeint, [ascii(x)::uhugeint for x in string_split(p_name, '')]) as l from part),
h as (select p_partkey, list_reduce(l, lambda h, x: (xor(h, x) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint) as h from b)
select p_partkey, (case when h >= 9223372036854775808::uhugeint then h::hugeint - 18446744073709551616::hugeint else h::hugeint end)::bigint as h from h"""

OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "q01_flagship": (flagship, FLAGSHIP_SQL),
    "e03_path": (e03_path, "select o_orderkey, o_custkey as k, o_orderstatus as c, o_totalprice as p from orders where o_orderstatus <> 'P'"),
    "q08_text_round_trip": (q08_text_round_trip, "select l_orderkey, l_linenumber from lineitem where not (l_quantity between 10 and 40) and (l_returnflag in ('R', 'A') or l_tax > 0.05) and l_discount is not null"),
    "s02_read_schema": (s02_read_schema, "select * from (values ('n_nationkey', 'int32'), ('n_name', 'utf8'), ('n_regionkey', 'int32')) as t(name, type)"),
    "s05_append": (s05_append, "select o_orderkey, o_custkey, o_orderstatus from orders"),
    "s16_avro_blocks": (s16_avro_blocks, "select n_nationkey, n_name, n_regionkey from nation"),
    "s22_structured_text": (s22_structured_text, "select r_regionkey, r_name from region"),
    "o04_row_limit": (o04_row_limit, "select count(*)::bigint as n from (select * from orders limit 100)"),
    "o05_byte_limit": (o05_byte_limit, "select * from (values (0::bigint), (1::bigint)) as t(n)"),
    "o07_merge_write": (o07_merge_write, "select o_orderkey, o_custkey + 1 as o_custkey, 'N' as o_orderstatus from orders"),
    "c4_strict_cast": (c4_strict_cast, "select o_orderkey::varchar as o_orderkey, o_totalprice::decimal(14,3) as o_totalprice, o_orderdate::date as o_orderdate from orders"),
    "t1_type_texts": (t1_type_texts, "select * from (values ('int64', 'int64'), ('utf8', 'utf8'), ('decimal(9, 2)', 'decimal(9, 2)'), ('list<int32!>', 'list<int32!>'), ('map<utf8, float64>', 'map<utf8, float64>'), ('struct<a: int8!, b: list<utf8>>', 'struct<a: int8!, b: list<utf8>>')) as t(given, said)"),
    "t4_field_ids": (t4_field_ids, "select * from (values (1, 'n_nationkey'), (2, 'n_name'), (3, 'n_regionkey')) as t(id, name)"),
    "t6_marked_partitions": (t6_marked_partitions, "select * from (values ('o_orderkey', false), ('o_custkey', false), ('o_orderstatus', true), ('o_totalprice', false)) as t(name, is_partition)"),
    "t9_capture_schema": (t9_capture_schema, "select * from (values ('user', 'int64'), ('took', 'float64'), ('place', 'utf8')) as t(name, type)"),
    "x7_hash_text": (x7_hash_text, _FNV_SQL),
    "s20_raw_lines": (s20_raw_lines, "select line as value, count(*)::bigint as n from (select unnest(string_split(text, chr(10))) as line from documents) where contains(line, 'License') group by 1"),
    "s23_codings": (s23_codings, "select p_partkey, p_name as name from part"),
    "s25_media_types": (s25_media_types, "select * from (values ('a.csv.gz', 'text/csv'), ('x', 'application/vnd.apache.parquet'), ('y', 'application/octet-stream')) as t(name, media)"),
    "s26_listing": (s26_listing, "select s || '.parquet' as name, s as stem, 'parquet' as extension, true as some from (select unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) as s)"),
    "s27_pruned_listing": (s27_pruned_listing, "select * from (values ('nation.parquet'), ('region.parquet')) as t(name)"),
    "t8_table_schema": (t8_table_schema, "select * from (values (1, 'vec_id', 'long', 'int64'), (2, 'embedding', 'list', 'list<float32>'), (3, 'label', 'int', 'int32')) as t(id, name, kind, type)"),
    "t14_zones": (t14_zones, "select event_id, ts + interval 330 minute as there, 19800::int as ahead, ts as back from events"),
    "t15_iso": (t15_iso, "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as iso, ts as back, (86400 + user_id * 60 + 2.5)::double as seconds, null::double as none from events"),
    "t16_url_parts": (t16_url_parts, "select page_id, 'https' as scheme, 'h.example:8' as authority, '/a/' || page_id || '/b.tar.GZ' as path, '/a/' || page_id as parent, 'b.tar.GZ' as name, 'b.tar' as stem, 'gz' as extension, 'q=1' as query from pages"),
    "st_stream_rows": (st_stream_rows, "select o_orderkey, o_totalprice * 2 as twice from orders where o_orderstatus = 'F'"),
    "i03_plan": (i03_plan, "select o_orderstatus as status, count(*)::bigint as n from orders where o_orderstatus = 'F' group by 1"),
    "i12_branch": (i12_branch, "select o_orderkey, o_custkey, o_orderstatus, 'branch' as \"at\" from orders union all select o_orderkey, 0, o_orderstatus, 'tag' from orders"),
    "i13_expire": (i13_expire, "select o_orderkey, o_custkey, o_orderstatus, 1::int as expired from orders where o_orderstatus = 'O'"),
    "i14_history": (i14_history, "select 'append' as operation, true as is_current_ancestor, 2::bigint as n"),
    "e04_attribute": (e04_attribute, "select n_nationkey, 'nation.parquet' as name, 'parquet' as ext from nation"),
    "e05_parameter": (e05_parameter, "select o_orderkey, 42::bigint as q from orders where o_custkey = 7 or o_orderstatus = 'P'"),
    "u1_union_by_name": (u1_union_by_name, "select n_nationkey as \"Key\", n_name as name, null::varchar as kind from nation union all select r_regionkey, null, 'r' from region"),
    "u2_union_as": (u2_union_as, "select n_nationkey::bigint as key, n_name as name from nation union all select r_regionkey::bigint, '' from region"),
    "u3_append_chain": (u3_append_chain, "select n_nationkey as key, n_name as name from nation union all select r_regionkey, r_name from region"),
    "c1_cast": (c1_cast, "select coalesce(try_cast(o_orderpriority as bigint), 0) as o_orderpriority, o_orderkey::varchar as \"O_ORDERKEY\", o_totalprice::decimal(12,1) as o_totalprice, 0::int as missing, null::varchar as gone from orders"),
    "c3_nested_cast": (c3_nested_cast, "select o_orderkey, o_custkey::varchar as a, o_orderstatus as b, 0::bigint as c, coalesce(try_cast(o_orderstatus as bigint), 0) as x, o_custkey as y from orders"),
    "o2_shaped_read": (o2_shaped_read, "select o_totalprice as \"o_totalprice\", o_orderkey from orders where o_orderstatus = 'F'"),
    "s04_merge": (s04_merge, _MERGE_SQL),
    "s06_partitioned_folder": (s06_partitioned_folder, "select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderstatus = 'O'"),
    "s14_ipc": (s14_ipc, "select * from customer"),
    "s15_avro": (s15_avro, "select * from supplier"),
    "s18_text_lines": (s18_text_lines, "select event_id::varchar as url, 1::bigint as rownum, ts::date as date, epoch(date_trunc('second', ts))::bigint * 1000000000 as unix, 'WARN' as level, user_id as \"user\", 2::int as lines, 0::bigint as \"at\" from events"),
    "i02_scan": (i02_scan, "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderstatus = 'F' and o_custkey > 20"),
    "i04_time_travel": (i04_time_travel, "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey % 2 = 0"),
    "i06_overwrite_where": (i06_overwrite_where, "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderstatus <> 'F' union all select o_orderkey, o_custkey + 1, 'F' from orders"),
    "i07_table_merge": (i07_table_merge, "select o_orderkey, -o_custkey as o_custkey, o_orderstatus from orders union all select -o_orderkey - 1, o_custkey, o_orderstatus from orders"),
    "i08_compact": (i08_compact, "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey > 10"),
    "i09_evolve": (i09_evolve, "select o_orderkey, o_custkey as cust, o_orderstatus, null::varchar as note from orders where o_custkey > 10"),
    "i11_transforms": (i11_transforms, _BUCKET_SQL),
    "i14_files": (i14_files, "select o_orderstatus as status, count(*)::bigint as n from orders group by 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = {name: (lambda spark, sf_dir, t=t, s=s: run(table(spark, sf_dir, t), s)) for name, (t, s, _) in STATEMENTS.items()}
    for name, q in made.items():
        q.__name__ = name
    return made | {name: q for name, (q, _) in OTHER.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in STATEMENTS.items()} | {name: sql for name, (_, sql) in OTHER.items() if sql}
