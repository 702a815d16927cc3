"""The registered queries of the engine's own operators, each with its SQL for DuckDB."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.json import json_value
from .operators.constraints import broken, duplicates, orphans, row_checks
from .session import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Name -> (statement, SQL). The statement runs over the tables as they are.
STATEMENTS: dict[str, tuple[str, str]] = {
    "scan_star": ("select * from nation", "SELECT * FROM nation"),
    "find_table": ("find region", "SELECT * FROM region"),
    "select_table": ("select supplier", "SELECT * FROM supplier"),
    "project_alias": ("select c_custkey as id, c_name as name from customer", "SELECT c_custkey AS id, c_name AS name FROM customer"),
    "project_literal": ("select r_name, 5, 'x' as tag, null as nothing from region", "SELECT r_name, CAST(5 AS INTEGER) AS col_1, 'x' AS tag, NULL AS nothing FROM region"),
    "point_lookup": ("find orders where o_orderkey = 1", "SELECT * FROM orders WHERE o_orderkey = 1"),
    "index_lookup": ("select * from customer where c_mktsegment = BUILDING", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_eq": ("select * from orders where o_orderstatus = 'F'", "SELECT * FROM orders WHERE o_orderstatus = 'F'"),
    "filter_ne": ("select * from part where p_size != 10", "SELECT * FROM part WHERE p_size <> 10"),
    "filter_gt": ("select * from orders where o_totalprice > 250000", "SELECT * FROM orders WHERE o_totalprice > 250000"),
    "filter_lt": ("select * from customer where c_acctbal < 0", "SELECT * FROM customer WHERE c_acctbal < 0"),
    "filter_ge": ("select * from part where p_size >= 45", "SELECT * FROM part WHERE p_size >= 45"),
    "filter_le": ("select * from customer where c_name <= 'Customer#000000500'", "SELECT * FROM customer WHERE c_name <= 'Customer#000000500'"),
    "filter_int_vs_double": ("select * from part where p_retailprice = 900", "SELECT * FROM part WHERE p_retailprice = 900"),
    "filter_number_vs_string": ("select event_id, event_type from events where event_type > 5", "SELECT event_id, event_type FROM events WHERE TRY_CAST(event_type AS DOUBLE) > 5"),
    "filter_string_vs_number": ("select * from part where p_size = '10'", "SELECT * FROM part WHERE p_size = 10"),
    "filter_timestamp": ("select o_orderkey, o_orderdate from orders where o_orderdate >= '1997-01-01'", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'"),
    "filter_and": ("select * from orders where o_totalprice > 250000 and o_orderstatus = 'O'", "SELECT * FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O'"),
    "filter_or": ("select * from orders where o_orderstatus = 'F' or o_orderpriority = '1-URGENT'", "SELECT * FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'"),
    "filter_dnf": ("select * from lineitem where l_quantity > 45 and l_returnflag = 'R' or l_discount = 0.1", "SELECT * FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' OR l_discount = 0.1"),
    "filter_like_prefix": ("select * from part where p_type like 'eco%'", "SELECT * FROM part WHERE p_type ILIKE 'eco%'"),
    "filter_like_any": ("select * from part where p_name LIKE '%_ing'", "SELECT * FROM part WHERE p_name ILIKE '%_ing'"),
    "topk_asc": ("select * from orders order by o_totalprice limit 10", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10"),
    "topk_desc": ("select * from orders order by o_totalprice desc limit 10", "SELECT * FROM orders ORDER BY o_totalprice DESC LIMIT 10"),
    "topk_offset": ("select * from orders order by o_totalprice desc limit 10 offset 20", "SELECT * FROM orders ORDER BY o_totalprice DESC LIMIT 10 OFFSET 20"),
    "topk_filtered": ("find orders where o_orderstatus = 'O' order by o_orderkey desc limit 25", "SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey DESC LIMIT 25"),
    "sort_full": ("select * from orders order by o_orderkey", "SELECT * FROM orders ORDER BY o_orderkey"),
    "sort_alias": ("select p_partkey, p_retailprice as price from part order by price desc offset 1900", "SELECT p_partkey, p_retailprice AS price FROM part ORDER BY price DESC, p_partkey OFFSET 1900"),
    "limit_zero": ("select * from orders limit 0", "SELECT * FROM orders LIMIT 0"),
    "join_inner": ("select * from orders join customer on orders.o_custkey = customer.c_custkey", "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_left": ("select * from part left join region on part.p_size = region.r_regionkey", "SELECT * FROM part LEFT JOIN region ON p_size = r_regionkey"),
    "join_right": ("select * from part right join region on part.p_size = region.r_regionkey", "SELECT * FROM part RIGHT JOIN region ON p_size = r_regionkey"),
    "join_full": ("select * from part full join region on part.p_size = region.r_regionkey", "SELECT * FROM part FULL JOIN region ON p_size = r_regionkey"),
    "join_cross": ("select * from nation cross join region", "SELECT * FROM nation CROSS JOIN region"),
    "join_cross_on": ("select * from nation cross join region on nation.n_regionkey < region.r_regionkey", "SELECT * FROM nation CROSS JOIN region WHERE n_regionkey < r_regionkey"),
    "join_multi": ("select c_name, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_acctbal > 5000", "SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000"),
    "join_filter_topk": ("select o_orderkey, o_totalprice, c_name from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' order by o_totalprice desc limit 10", "SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_totalprice DESC LIMIT 10"),
    "group_count": ("select o_orderstatus, count(o_orderkey) as n from orders group by o_orderstatus", "SELECT o_orderstatus, COUNT(o_orderkey) AS n FROM orders GROUP BY o_orderstatus"),
    "group_star": ("select event_type, COUNT(*) as n from events group by event_type", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type"),
    "group_min": ("select c_mktsegment, min(c_acctbal) as least from customer group by c_mktsegment", "SELECT c_mktsegment, MIN(c_acctbal) AS least FROM customer GROUP BY c_mktsegment"),
    "group_max": ("select c_mktsegment, max(c_acctbal) as most from customer group by c_mktsegment", "SELECT c_mktsegment, MAX(c_acctbal) AS most FROM customer GROUP BY c_mktsegment"),
    "group_keys_only": ("select p_brand from part group by p_brand", "SELECT p_brand FROM part GROUP BY p_brand"),
    "group_order": ("select l_suppkey, count(*) as n from lineitem group by l_suppkey order by l_suppkey limit 20", "SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY l_suppkey LIMIT 20"),
    "join_group": ("select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by n_name", "SELECT n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "join_self": ("select a.n_name as name, b.n_name as other, r_name from nation as a join nation as b on a.n_regionkey = b.n_regionkey join region as r on b.n_regionkey = r.r_regionkey where a.n_nationkey != 3", "SELECT a.n_name AS name, b.n_name AS other, r_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN region ON b.n_regionkey = r_regionkey WHERE a.n_nationkey <> 3"),
    "group_default_name": ("select o_orderstatus, count(o_orderkey), MAX(o_orderkey) from orders group by o_orderstatus", "SELECT o_orderstatus, COUNT(o_orderkey) AS \"count(o_orderkey)\", MAX(o_orderkey) AS \"MAX(o_orderkey)\" FROM orders GROUP BY o_orderstatus"),
    "call_without_from": ("select count(x) as n, 'y' as y", "SELECT CAST(0 AS BIGINT) AS n, 'y' AS y"),
    "select_constant": ("select 1 as a, 'x' as b", "SELECT CAST(1 AS INTEGER) AS a, 'x' AS b"),
}
_THETA = {"ne": ("!=", "<>"), "gt": (">", ">"), "lt": ("<", "<"), "ge": (">=", ">="), "le": ("<=", "<=")}
STATEMENTS |= {f"join_{n}": (f"select * from supplier join nation on supplier.s_suppkey {a} nation.n_nationkey", f"SELECT * FROM supplier JOIN nation ON s_suppkey {b} n_nationkey") for n, (a, b) in _THETA.items()}

#: The flagship: filter, conjunction, sort and limit in one.
FLAGSHIP = "select o_orderkey, o_totalprice from orders where o_totalprice > 250000 and o_orderstatus = 'O' order by o_totalprice desc limit 10"


def engine_at(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the tables of a folder; only those that a query names are opened."""
    engine = Engine(spark)
    engine.catalog.views = Lazy(spark, sf_dir)
    return engine


class Lazy(dict):
    """Read-only tables that are opened when they are first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __contains__(self, name: object) -> bool:
        return name in TABLES or super().__contains__(name)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in columns})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_at(spark, sf_dir).execute(FLAGSHIP)


def group_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(engine_at(spark, sf_dir).execute("select l_returnflag, sum(l_quantity) as s from lineitem group by l_returnflag"), "s")


def group_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(engine_at(spark, sf_dir).execute("select o_orderpriority, avg(o_totalprice) as a from orders group by o_orderpriority"), "a")


def group_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "select l_returnflag, l_linestatus, sum(l_quantity) as q, avg(l_extendedprice) as p, count(*) as n, max(l_tax) as t from lineitem group by l_returnflag, l_linestatus"
    return _rounded(engine_at(spark, sf_dir).execute(text), "q", "p")


def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "select count(*) as n, sum(l_quantity) as q, avg(l_discount) as d, min(l_orderkey) as lo, max(l_orderkey) as hi from lineitem"
    return _rounded(engine_at(spark, sf_dir).execute(text), "q", "d")


def _with_nulls(spark: SparkSession, sf_dir: str) -> Engine:
    engine = engine_at(spark, sf_dir)
    orders = engine.table("orders")
    engine.register("holes", orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price")))
    return engine


_HOLES = "(SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders)"


def _copy(engine: Engine, name: str, columns: str, source: DataFrame) -> None:
    engine.execute(f"create table {name} ({columns})")
    engine.load(name, source)


_PART = "p_partkey int primary key, p_name string, p_size int, p_retailprice double"


def insert_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows and rows of known keys into a copy of part: the last write wins."""
    engine = engine_at(spark, sf_dir)
    part = engine.table("part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    _copy(engine, "copy", _PART, part)
    engine.load("copy", part.where("p_partkey % 3 = 0").withColumn("p_size", F.lit(0).cast("long")).unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 10_000_000)))
    return engine.execute("select * from copy")


_ORDER = "o_orderkey int primary key, o_orderstatus string, o_totalprice double, o_note string"


def _orders(spark: SparkSession, sf_dir: str) -> Engine:
    engine = engine_at(spark, sf_dir)
    note = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))
    _copy(engine, "copy", _ORDER, engine.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", note.alias("o_note")))
    return engine


def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _orders(spark, sf_dir)
    engine.execute("update copy set o_orderstatus = 'X', o_totalprice = 1.5 where o_totalprice > 250000 and o_note != '1-URGENT'")
    return engine.execute("select * from copy")


def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _orders(spark, sf_dir)
    engine.execute("delete from copy where o_orderstatus = 'F' and o_note != '1-URGENT' or o_totalprice < 1000")
    return engine.execute("select * from copy")


def auto_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_at(spark, sf_dir)
    engine.execute("create table numbered (id int primary key auto_increment, name string)")
    engine.load("numbered", engine.table("region").orderBy("r_regionkey").coalesce(1).select(F.col("r_name").alias("name")))
    return engine.execute("select * from numbered")


def insert_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_at(spark, sf_dir)
    engine.execute("create table filled (k int, level enum('jr', 'sr') default 'jr', score double default 1.5, note string)")
    engine.load("filled", engine.table("nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") > 9, F.lit("x")).alias("note")))
    return engine.execute("select * from filled")


def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_at(spark, sf_dir)
    return orphans(engine.table("orders"), "o_custkey", engine.table("supplier"), "s_suppkey").select("o_orderkey", "o_custkey")


def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(engine_at(spark, sf_dir).table("customer"), "c_nationkey")


def _breaking(spark: SparkSession, sf_dir: str, columns: list[dict], check: str | None, name: str) -> DataFrame:
    from .dialect.parser import _Parser

    orders = engine_at(spark, sf_dir).table("orders")
    checks = row_checks(columns, orders.schema, [("c", _Parser(check).condition(checks=True))] if check else [])
    return orders.where(checks[name]).select("o_orderkey", "o_orderstatus", "o_totalprice")


def enum_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaking(spark, sf_dir, [{"name": "o_orderstatus", "enum": ["F", "O"]}], None, "enum o_orderstatus")


def check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaking(spark, sf_dir, [], "o_totalprice <= 200000", "check c")


def check_in_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaking(spark, sf_dir, [], "o_orderstatus in ('F', 'P')", "check c")


def check_like_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaking(spark, sf_dir, [], "o_orderpriority like '%URG%'", "check c")


def length_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaking(spark, sf_dir, [{"name": "o_orderpriority", "length": 7}], None, "length o_orderpriority")


def not_null_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = _with_nulls(spark, sf_dir).table("holes")
    found = broken(holes, row_checks([{"name": "status", "not_null": True}], holes.schema, []))
    return spark.createDataFrame([(k, v) for k, v in found.items()], "name string, n long")


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_at(spark, sf_dir).table("events").select("event_id", json_value(F.col("props"), "$.k", "long").alias("k"))


def index_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index made over rows that are there: their folders are written anew with Bloom filters and order."""
    engine = engine_at(spark, sf_dir)
    _copy(engine, "copy", "c_custkey int primary key, c_name string, c_mktsegment string", engine.table("customer").select("c_custkey", "c_name", "c_mktsegment"))
    engine.execute("create index by_segment on copy (c_mktsegment)")
    return engine.execute("select * from copy where c_mktsegment = BUILDING")


def insert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT as a statement, in both forms; a key that comes again takes the place of its row."""
    engine = engine_at(spark, sf_dir)
    engine.execute("create table noted { k: int primary key, word: string, share: double, done: bool }")
    engine.execute("insert into noted (k, word, share, done) values (1, 'oak', 0.5, true), (2, 'elm', null, false), (3, \"it's\", -2, null)")
    engine.execute("insert noted { k: 4, word: ash }")
    engine.execute("insert noted { k: 2, word: 'yew', done: true }")
    return engine.execute("select * from noted")


def filter_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_at(spark, sf_dir)
    large = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") > 250000)
    _copy(engine, "copy", "o_orderkey int primary key, large bool", engine.table("orders").select("o_orderkey", large.alias("large")))
    return engine.execute("select o_orderkey from copy where large != true")


def _lines(spark: SparkSession, engine: Engine, header: str | None, rows: DataFrame) -> str:
    """A CSV file of lines as they are given."""
    path = engine.catalog.store.path("lines")
    lines = rows if header is None else spark.createDataFrame([(header,)], "value string").union(rows)
    lines.coalesce(1).write.text(path)
    return path


def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a cell too many or too few are left out; a quoted delimiter makes no cell."""
    engine = engine_at(spark, sf_dir)
    size = F.col("p_size").cast("string")
    line = F.when(F.col("p_partkey") % 5 == 0, F.concat_ws(",", F.col("p_partkey"), F.lit("odd"))).when(F.col("p_partkey") % 5 == 1, F.concat_ws(",", F.col("p_partkey"), F.lit("x"), size, F.lit("more")))
    line = line.otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit(',"'), F.col("p_brand"), F.lit(', new",'), size))
    engine.import_csv(_lines(spark, engine, "Part Key,Brand (new),Size", engine.table("part").select(line.alias("value"))), "parts")
    return engine.execute("select * from parts")


def csv_headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first record with a number in it is data, and the columns are numbered."""
    engine = engine_at(spark, sf_dir)
    line = F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_orderpriority")
    engine.import_csv(_lines(spark, engine, None, engine.table("orders").select(line.alias("value"))), "plain")
    return engine.execute("select * from plain")


def csv_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem out to CSV and in again."""
    engine = engine_at(spark, sf_dir)
    path = engine.catalog.store.path("csv")
    engine.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus").write.option("header", True).csv(path)
    engine.import_csv(path, "lines")
    return engine.execute("select * from lines")


def _family(spark: SparkSession, sf_dir: str) -> Engine:
    """region, nation and customer as tables that refer to each other."""
    engine = engine_at(spark, sf_dir)
    rule = "on delete cascade on update cascade"
    _copy(engine, "r", "rk int primary key, name string", engine.table("region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("name")))
    _copy(engine, "n", f"nk int primary key, rk int references r(rk) {rule}", engine.table("nation").select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("rk")))
    _copy(engine, "c", f"ck int primary key, nk int references n(nk) {rule}", engine.table("customer").select(F.col("c_custkey").alias("ck"), F.col("c_nationkey").alias("nk")))
    return engine


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _family(spark, sf_dir)
    engine.execute("delete from r where name = 'ASIA' or rk = 0")
    return engine.execute("select * from c")


def update_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _family(spark, sf_dir)
    engine.execute("update r set rk = 100 where name = 'EUROPE'")
    engine.execute("update n set nk = 200 where nk = 3")
    return engine.execute("select c.ck, n.rk, n.nk as nation from c join n on c.nk = n.nk")


def drop_recreate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table dropped and made again under its name: no remembered result of the old one comes back."""
    engine = engine_at(spark, sf_dir)
    old = engine.table("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    new = engine.table("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    _copy(engine, "again", "k int primary key, name string", old)
    engine.to_json("select * from again")
    engine.execute("drop table again")
    _copy(engine, "again", "k int primary key, name string", new)
    rows = json.loads(engine.to_json("select * from again"))
    return spark.createDataFrame([(r["k"], r["name"]) for r in rows], "k long, name string")


def bulk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python rows by name, by position, as columns, and one by one through a buffer."""
    from .streaming.ingest import BufferedInserter

    engine = engine_at(spark, sf_dir)
    engine.execute("create table bulk (k int primary key, name string default 'none', part string)")
    rows = [tuple(r) for r in engine.table("nation").select("n_nationkey", "n_name").collect()]  # 25 rows
    engine.insert_rows("bulk", [{"k": k, "name": n, "part": "rows", "unknown": 1} for k, n in rows])
    engine.insert_values("bulk", [(100 + k, n, "values") for k, n in rows])
    engine.insert_columns("bulk", {"k": [200 + k for k, _ in rows], "part": ["columns"] * len(rows)})
    with BufferedInserter(engine, "bulk", size=10) as buffer:
        for k, n in rows:
            buffer.add({"k": 300 + k, "name": n, "part": "buffer"})
    return engine.execute("select * from bulk")


def http_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in and a query's rows out, over HTTP."""
    import threading
    import urllib.request

    from .server import serve

    engine = engine_at(spark, sf_dir)
    engine.execute("create table sent (k int primary key, name string)")
    server = serve(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(body: dict):
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}/query", json.dumps(body).encode())) as answer:
            return json.loads(json.loads(answer.read())["data"])

    try:
        ask({"table": "sent", "rows": [{"k": r.n_nationkey, "name": r.n_name} for r in engine.table("nation").collect()]})
        rows = ask({"query": "select k, name from sent where k > 4"})
    finally:
        server.shutdown()
    return spark.createDataFrame([(r["k"], r["name"]) for r in rows], "k long, name string")


def delete_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_at(spark, sf_dir)
    _copy(engine, "r", "rk int primary key, name string", engine.table("region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("name")))
    _copy(engine, "n", "nk int primary key, rk int references r(rk) on delete set null", engine.table("nation").select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("rk")))
    engine.execute("delete from r where name = 'ASIA'")
    return engine.execute("select * from n")


def memory_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is kept in the executors' memory, changed and read again."""
    engine = Engine(spark, memory=True)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size", "p_retailprice")
    _copy(engine, "copy", _PART, part)
    engine.execute("select count(*) as n from copy").collect()
    engine.execute("update copy set p_size = 0 where p_size > 25")
    return engine.execute("select * from copy")


def drop_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_at(spark, sf_dir)
    engine.execute("create table a (x int primary key, y varchar(5) not null)")
    engine.execute("create index i on a (y)")
    engine.execute("create index j on a (x)")
    engine.execute("drop index i")
    return engine.execute("describe a")


def csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation out to CSV and in again: names cleaned, all columns text."""
    engine = engine_at(spark, sf_dir)
    path = engine.catalog.store.path("csv")
    engine.table("nation").toDF("Nation Key", "Nation Name", "Region-Key").coalesce(1).write.option("header", True).csv(path)
    engine.import_csv(path, "nations")
    return engine.execute("select * from nations")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of files into a table."""
    from .streaming.ingest import stream_into

    engine = engine_at(spark, sf_dir)
    engine.execute("create table landed (event_id int primary key, user_id int, event_type string, value double)")
    rows = spark.readStream.schema(engine.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream_into(engine, "landed", rows, engine.catalog.store.path("checkpoint")).awaitTermination()
    return engine.execute("select * from landed")


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_at(spark, sf_dir)
    engine.execute("create table a (x int, y string)")
    engine.execute("create table b { z: json }")
    return engine.execute("show tables")


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_at(spark, sf_dir)
    engine.execute("create table a (x int primary key, y varchar(5) not null)")
    engine.execute("create index i on a (y)")
    return engine.execute("describe a")


def _sorted_holes(column: str, text: str, beyond: str) -> Callable[[SparkSession, str], DataFrame]:
    """A sort with a limit behind the boundary between values and nulls, wherever the table has it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _with_nulls(spark, sf_dir)
        first = engine.table("holes").where(f"{column} is {beyond}").count()
        return engine.execute(f"{text} limit {first + 500}")

    return run


def _holes(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _with_nulls(spark, sf_dir).execute(text)


def _plain(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine_at(spark, sf_dir).execute(text)


_COPY_SQL = "(SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_note FROM orders)"

#: Name -> (query, SQL) of those that are more than one statement over the tables.
BUILT: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "flagship": (flagship, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O' ORDER BY o_totalprice DESC LIMIT 10"),
    "group_sum": (group_sum, "SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS s FROM lineitem GROUP BY l_returnflag"),
    "group_avg": (group_avg, "SELECT o_orderpriority, ROUND(AVG(o_totalprice), 2) AS a FROM orders GROUP BY o_orderpriority"),
    "group_multi": (group_multi, "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS q, ROUND(AVG(l_extendedprice), 2) AS p, COUNT(*) AS n, MAX(l_tax) AS t FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "agg_global": (agg_global, "SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q, ROUND(AVG(l_discount), 2) AS d, MIN(l_orderkey) AS lo, MAX(l_orderkey) AS hi FROM lineitem"),
    "filter_null": (_holes("select * from holes where status = null"), f"SELECT * FROM {_HOLES} WHERE status IS NULL"),
    "filter_not_null": (_holes("select * from holes where status != null and price != null"), f"SELECT * FROM {_HOLES} WHERE status IS NOT NULL AND price IS NOT NULL"),
    "filter_three_valued": (_holes("select * from holes where status != 'F' or price > 400000"), f"SELECT * FROM {_HOLES} WHERE status <> 'F' OR price > 400000"),
    "sort_nulls_last": (_sorted_holes("status", "select status from holes order by status", "not null"), f"SELECT status FROM {_HOLES} ORDER BY status ASC NULLS LAST LIMIT (SELECT COUNT(status) + 500 FROM {_HOLES})"),
    "sort_nulls_first": (_sorted_holes("price", "select price from holes order by price desc", "null"), f"SELECT price FROM {_HOLES} ORDER BY price DESC NULLS FIRST LIMIT (SELECT COUNT(*) - COUNT(price) + 500 FROM {_HOLES})"),
    "count_nulls": (_holes("select status, count(price) as n, count(*) as rows from holes group by status"), f"SELECT status, COUNT(price) AS n, COUNT(*) AS rows FROM {_HOLES} GROUP BY status"),
    "insert_upsert": (insert_upsert, "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS BIGINT) AS p_size, p_retailprice FROM part UNION ALL SELECT CAST(p_partkey + 10000000 AS BIGINT), p_name, CAST(p_size AS BIGINT), p_retailprice FROM part"),
    "update_where": (update_where, f"SELECT o_orderkey, CASE WHEN o_totalprice > 250000 AND o_note <> '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 250000 AND o_note <> '1-URGENT' THEN 1.5 ELSE o_totalprice END AS o_totalprice, o_note FROM {_COPY_SQL}"),
    "delete_where": (delete_where, f"SELECT * FROM {_COPY_SQL} WHERE NOT COALESCE(o_orderstatus = 'F' AND o_note <> '1-URGENT' OR o_totalprice < 1000, FALSE)"),
    "auto_increment": (auto_increment, "SELECT ROW_NUMBER() OVER (ORDER BY r_regionkey) AS id, r_name AS name FROM region"),
    "insert_default": (insert_default, "SELECT CAST(n_nationkey AS BIGINT) AS k, 'jr' AS level, CAST(1.5 AS DOUBLE) AS score, CASE WHEN n_nationkey > 9 THEN 'x' END AS note FROM nation"),
    "fk_violations": (fk_violations, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)"),
    "unique_violations": (unique_violations, "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 1"),
    "enum_violations": (enum_violations, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"),
    "check_violations": (check_violations, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT o_totalprice <= 200000"),
    "check_in_violations": (check_in_violations, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus NOT IN ('F', 'P')"),
    "check_like_violations": (check_like_violations, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority NOT LIKE '%URG%'"),
    "length_violations": (length_violations, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE STRLEN(o_orderpriority) > 7"),
    "not_null_violations": (not_null_violations, f"SELECT 'not null status' AS name, COUNT(*) AS n FROM {_HOLES} WHERE status IS NULL"),
    "json_value": (json_values, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "csv_import": (csv_import, "SELECT CAST(n_nationkey AS VARCHAR) AS nation_key, n_name AS nation_name, CAST(n_regionkey AS VARCHAR) AS region_key FROM nation"),
    "csv_ragged": (csv_ragged, "SELECT CAST(p_partkey AS VARCHAR) AS part_key, p_brand || ', new' AS brand__new, CAST(p_size AS VARCHAR) AS size FROM part WHERE p_partkey % 5 NOT IN (0, 1)"),
    "csv_headerless": (csv_headerless, "SELECT CAST(o_orderkey AS VARCHAR) AS col_1, o_orderstatus AS col_2, o_orderpriority AS col_3 FROM orders"),
    "csv_lineitem": (csv_lineitem, "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(l_quantity AS VARCHAR) AS l_quantity, l_returnflag, l_linestatus FROM lineitem"),
    "index_backfill": (index_backfill, "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "insert_text": (insert_text, "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'oak', CAST(0.5 AS DOUBLE), TRUE), (2, 'yew', NULL, TRUE), (3, 'it''s', -2, NULL), (4, 'ash', NULL, NULL)) t(k, word, share, done)"),
    "filter_bool": (filter_bool, "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 AND o_totalprice <= 250000"),
    "delete_cascade": (delete_cascade, "SELECT CAST(c_custkey AS BIGINT) AS ck, CAST(c_nationkey AS BIGINT) AS nk FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' AND r_regionkey <> 0"),
    "update_cascade": (update_cascade, "SELECT CAST(c_custkey AS BIGINT) AS ck, CAST(CASE WHEN r_name = 'EUROPE' THEN 100 ELSE r_regionkey END AS BIGINT) AS rk, CAST(CASE WHEN n_nationkey = 3 THEN 200 ELSE n_nationkey END AS BIGINT) AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "bulk_rows": (bulk_rows, "SELECT CAST(n_nationkey + beyond AS BIGINT) AS k, CASE WHEN part = 'columns' THEN 'none' ELSE n_name END AS name, part FROM nation, (VALUES (0, 'rows'), (100, 'values'), (200, 'columns'), (300, 'buffer')) p(beyond, part)"),
    "http_query": (http_query, "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation WHERE n_nationkey > 4"),
    "delete_set_null": (delete_set_null, "SELECT CAST(n_nationkey AS BIGINT) AS nk, CAST(CASE WHEN r_name <> 'ASIA' THEN n_regionkey END AS BIGINT) AS rk FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "memory_mode": (memory_mode, "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, CAST(CASE WHEN p_size > 25 THEN 0 ELSE p_size END AS BIGINT) AS p_size, p_retailprice FROM part"),
    "drop_index": (drop_index, "SELECT * FROM (VALUES ('x', 'int', TRUE, '', 'j'), ('y', 'varchar', FALSE, 'not null; length <= 5', '')) t(\"column\", \"type\", primary_key, constraints, indexes)"),
    "drop_recreate": (drop_recreate, "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation"),
    "stream_ingest": (stream_ingest, "SELECT event_id, user_id, event_type, value FROM events"),
    "show_tables": (show_tables, "SELECT * FROM (VALUES ('a', CAST(2 AS INTEGER)), ('b', CAST(1 AS INTEGER))) t(\"table\", columns)"),
    "describe": (describe, "SELECT * FROM (VALUES ('x', 'int', TRUE, '', ''), ('y', 'varchar', FALSE, 'not null; length <= 5', 'i')) t(\"column\", \"type\", primary_key, constraints, indexes)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _plain(text) for name, (text, _) in STATEMENTS.items()} | {name: q for name, (q, _) in BUILT.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in STATEMENTS.items()} | {name: sql for name, (_, sql) in BUILT.items()}
