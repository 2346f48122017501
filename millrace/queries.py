"""Queries over the test tables, one or more for each operator, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import dialect as d
from . import functions, sources
from .catalog import Catalog
from .engine import Engine
from .errors import NoTableScanError, ShardKeyUpdateError, ShardLockedError
from .functions import shard_of
from .operators import append, merge_counts
from .storage import shared_folder
from .streaming import journal

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Indexes that the idx_ queries may use.
INDEXES = {
    "orders": {"orders_key": ["o_orderkey"], "orders_cust_key": ["o_custkey", "o_orderkey"]},
    "customer": {"customer_upper": [d.Call("upper", (d.Column("c_mktsegment"),))]},
    "lineitem": {"line_part": ["l_partkey"]},
}



def hashed(sql: str, key: str = "o_orderkey") -> str:
    """SQL in which {} stands for the CRC-32 of a key's text, with its table of 256 values as crc."""
    value = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({key} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
    one = "list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"WITH crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, {one} AS v FROM range(256) r(i))) " + sql.replace("{}", value)


FLAGSHIP = "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey > 10 GROUP BY o_orderstatus ORDER BY n DESC LIMIT 3"
#: Name to a query of the dialect and its SQL; None where the query itself is its SQL.
PLAIN: dict[str, tuple[str, str | None]] = {
    "flagship": (FLAGSHIP, None),
    "scan_all": ("SELECT * FROM nation", None),
    "select_star": ("SELECT * FROM region", None),
    "select_star_override": ("SELECT *, r_regionkey > 2 AS r_name FROM region", "SELECT r_regionkey, r_regionkey > 2 AS r_name FROM region"),
    "project_alias": ("SELECT o_orderkey AS k, o_custkey FROM orders", None),
    "project_dup_alias": ("SELECT o_orderkey AS k, o_custkey AS k FROM orders", "SELECT o_custkey AS k FROM orders"),
    "project_bool": ("SELECT p_partkey, p_size > 10 AS big FROM part", None),
    "anon_alias": ("SELECT p_partkey, p_size > 10, 'x' FROM part", "SELECT p_partkey, p_size > 10 AS _0, 'x' AS _1 FROM part"),
    "select_no_from": ("SELECT 1, 'x', true", "SELECT CAST(1 AS INTEGER) AS _0, 'x' AS _1, true AS _2"),
    "missing_column": ("SELECT r_name, nope FROM region", "SELECT r_name, NULL AS nope FROM region"),
    "filter_eq": ("SELECT n_name FROM nation WHERE n_regionkey = 1", None),
    "filter_eq_kinds": ("SELECT n_name FROM nation WHERE n_regionkey = '1'", "SELECT n_name FROM nation WHERE false"),
    "filter_neq": ("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'"),
    "filter_lt": ("SELECT o_orderkey FROM orders WHERE o_custkey < 100", None),
    "filter_lte": ("SELECT o_orderkey FROM orders WHERE o_custkey <= 100", None),
    "filter_gt": ("SELECT o_orderkey FROM orders WHERE o_custkey > 1000", None),
    "filter_gte": ("SELECT o_orderkey FROM orders WHERE o_custkey >= 1000", None),
    "filter_between": ("SELECT o_orderkey FROM orders WHERE o_custkey >= 100 AND o_custkey < 200", None),
    "filter_string_range": ("SELECT c_custkey FROM customer WHERE c_mktsegment > 'C'", None),
    "filter_in": ("SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)", None),
    "filter_or": ("SELECT n_name FROM nation WHERE n_regionkey = 1 OR n_nationkey = 3", None),
    "filter_and_or": ("SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2 OR n_nationkey = 3", None),
    "filter_col_col": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey", None),
    "filter_truthy": ("SELECT p_partkey FROM part WHERE p_name", "SELECT p_partkey FROM part WHERE p_name IS NOT NULL"),
    "filter_missing_col": ("SELECT p_partkey FROM part WHERE nope = 1", "SELECT p_partkey FROM part WHERE false"),
    "filter_is_null": ("SELECT p_partkey FROM part WHERE nope = null", "SELECT p_partkey FROM part"),
    "filter_function": ("SELECT c_custkey FROM customer WHERE upper(c_mktsegment) = 'BUILDING'", None),
    "sort_asc": ("SELECT n_nationkey, n_name FROM nation ORDER BY n_name", None),
    "sort_desc": ("SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC", None),
    "sort_multi": ("SELECT n_nationkey FROM nation ORDER BY n_regionkey DESC, n_nationkey", None),
    "limit": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 17", None),
    "limit_zero": ("SELECT o_orderkey FROM orders LIMIT 0", None),
    "topk": ("SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_custkey DESC, o_orderkey LIMIT 20", None),
    "agg_count": ("SELECT count(*) AS n FROM lineitem", None),
    "agg_count_col": ("SELECT count(nope) AS n FROM lineitem", "SELECT count(*) AS n FROM lineitem"),
    "agg_sum": ("SELECT sum(l_linenumber) AS s FROM lineitem", "SELECT CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS s FROM lineitem"),
    "agg_max": ("SELECT max(o_custkey) AS m FROM orders", "SELECT greatest(0, max(o_custkey)) AS m FROM orders"),
    "agg_avg_int": ("SELECT avg(p_size) AS a FROM part", "SELECT CAST(floor(sum(p_size) / count(p_size)) AS BIGINT) AS a FROM part"),
    "agg_avg_double": ("SELECT avg(l_quantity) AS a FROM lineitem", "SELECT avg(l_quantity) AS a FROM lineitem"),
    "agg_several": ("SELECT count(*) AS n, sum(p_size) AS s, max(p_size) AS m FROM part", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, CAST(max(p_size) AS BIGINT) AS m FROM part"),
    "agg_empty": ("SELECT count(*) AS n, sum(o_custkey) AS s, max(o_custkey) AS m, avg(o_custkey) AS a FROM orders WHERE o_custkey < 0", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS a"),
    "agg_max_negative": ("SELECT max(c_acctbal) AS m FROM customer WHERE c_acctbal < 0", "SELECT greatest(0.0, max(c_acctbal)) AS m FROM customer WHERE c_acctbal < 0"),
    "agg_no_from": ("SELECT count(1) AS n", "SELECT CAST(1 AS BIGINT) AS n"),
    "group_1key": ("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", None),
    "group_2key": ("SELECT l_returnflag, l_linestatus, sum(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY ALL"),
    "group_hidden_key": ("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "group_no_agg": ("SELECT event_type FROM events GROUP BY event_type", None),
    "group_sort_limit": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10", None),
    "group_sort_hidden": ("SELECT count(*) AS n FROM orders GROUP BY o_custkey ORDER BY o_custkey LIMIT 10", None),
    "group_expr": ("SELECT o_custkey > 500 AS late, count(*) AS n FROM orders GROUP BY o_custkey > 500", None),
    "upper": ("SELECT c_custkey, upper(c_mktsegment) AS u FROM customer", None),
    "group_upper": ("SELECT upper(event_type) AS u, count(*) AS n FROM events GROUP BY upper(event_type)", None),
    "hashmod": ("SELECT o_orderkey, hashmod(o_orderkey, 8) AS h FROM orders", hashed("SELECT o_orderkey, {} % 8 AS h FROM orders, crc")),
    "idx_eq": ("SELECT * FROM orders WHERE o_orderkey = 7", None),
    "idx_range": ("SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 200", None),
    "idx_prefix_range": ("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderkey < 9000", None),
    "idx_prefix_orderby": ("SELECT o_orderkey FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey", None),
    "idx_in": ("SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 2, 3, 99999999)", None),
    "idx_orderby": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5", None),
    "idx_orderby_range": ("SELECT o_orderkey FROM orders WHERE o_orderkey > 10 ORDER BY o_orderkey LIMIT 5", None),
    "idx_count_only": ("SELECT count(*) AS n FROM lineitem WHERE l_partkey > 100", None),
    "idx_residual": ("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'F'", None),
    "idx_residual_or": ("SELECT o_orderkey FROM orders WHERE o_orderkey > 50 AND o_custkey = 3 OR o_orderkey = 1", None),
    "idx_contradiction": ("SELECT o_orderkey FROM orders WHERE o_orderkey = 1 AND o_orderkey = 2", None),
    "idx_expression": ("SELECT c_custkey FROM customer WHERE upper(c_mktsegment) = 'MACHINERY'", None),
}


def engine(spark: SparkSession, sf_dir: str, root: bool = False) -> Engine:
    """All tables, with their indexes as metadata; root: statements may change private copies."""
    catalog = Catalog(spark, shared_folder(spark) if root else None)
    for name in TABLES:
        catalog.import_parquet(name, f"{sf_dir}/{name}.parquet")
    for table, indexes in INDEXES.items():
        for name, keys in indexes.items():
            catalog.create_index(table, name, keys)
    return Engine(spark, catalog)


def plain(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).query(sql)


def after(*statements: str, table: str, stdin: list[str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """What a table holds after statements on a private copy."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, root=True)
        for s in statements:
            e.query(s, stdin=stdin)
        return e.query(f"SELECT * FROM {table}")

    return run


def sharded(sql: str, *before: str, sets: int = 2) -> Callable[[SparkSession, str], DataFrame]:
    """A query on orders in 8 shards by key, laid out in folders."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, root=True)
        e.catalog.shard("orders", "o_orderkey", 8, sets)
        for s in before:
            e.query(s)
        return e.query(sql)

    return run


def index_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine(spark, sf_dir).catalog.index_only_scan("lineitem", "line_part", {"gt": [100], "lte": [300]})
    return out.select(F.col("_key")[0].cast("long").alias("l_partkey"), F.col("_count").alias("n"), F.size("_tids").cast("long").alias("n_tids"))


def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).catalog.index_scan("orders", "orders_cust_key", {"eq": [7], "gte": [7, 100]}, descending=True).select("o_orderkey", "o_custkey")


def both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return append(e.query("SELECT o_orderkey FROM orders WHERE o_custkey < 50"), e.query("SELECT o_orderkey FROM orders WHERE o_custkey > 1400"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return merge_counts(*[e.query(f"SELECT count(*) AS count FROM orders WHERE hashmod(o_orderkey, 4) = {k}") for k in range(4)])


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log made of events: a user's events are changes of the user's row, some of them deletions."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_id") % 7 == 0, "delete").when(F.col("event_id") % 3 == 0, "insert").otherwise("update")
    return e.select(F.col("event_id").alias("lsn"), F.lit("users").alias("tbl"), F.col("user_id").alias("tid"), op.alias("op"), F.to_json(F.struct("event_type", "event_id")).alias("row"))


def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.replay(_log(spark, sf_dir), "users", "event_type string, event_id long")


def journal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through files and a stream, in two runs from one checkpoint."""
    root, log = shared_folder(spark), _log(spark, sf_dir)
    live = journal.LiveTable(spark, f"{root}/live")
    for half in (F.col("lsn") % 2 == 0, F.col("lsn") % 2 == 1):
        journal.append_log(log.filter(half), f"{root}/log")
        live.follow(f"{root}/log", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return live.table("users", "event_type string, event_id long")


def journal_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a journal of several files, in order of their names."""
    path, log = f"{shared_folder(spark)}/journal", _log(spark, sf_dir)
    payload = F.when(F.col("op") == "update", F.concat(F.lit("{},"), "row")).otherwise(F.col("row"))
    line = F.concat(F.lit('{"op":"'), "op", F.lit('","payload":["users",'), F.col("tid").cast("string"), F.lit(","), payload, F.lit("]}"))
    log.repartitionByRange(3, "lsn").sortWithinPartitions("lsn").select(line.alias("value")).write.text(path)
    catalog = Catalog(spark)
    catalog.recover(path, {"users": "event_type string, event_id long"})
    return Engine(spark, catalog).query("SELECT event_type, event_id FROM users")


def resharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each row is after a shard has moved."""
    e = engine(spark, sf_dir, root=True)
    e.catalog.shard("orders", "o_orderkey", 8, 2)
    e.query("RESHARD orders MOVE 3 TO 1")
    return e.catalog.placement("orders").select("o_orderkey", F.col("_shard").alias("shard"), F.col("_set").alias("replica_set"))


def imported(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """A table written as CSV or JSON lines and imported from there."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, e = f"{shared_folder(spark)}/nation", engine(spark, sf_dir)
        if kind == "csv":
            e.catalog.table("nation").write.option("header", True).csv(path)
            e.catalog.import_csv("again", path)
        else:
            sources.write_json(e.catalog.table("nation"), path)
            e.catalog.import_json("again", path)
        return e.query("SELECT n_nationkey, n_name FROM again WHERE n_regionkey > 1")

    return run


def json_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.json_lines(engine(spark, sf_dir).query("SELECT r_regionkey, r_name FROM region"))


def copy_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, path = engine(spark, sf_dir, root=True), f"{shared_folder(spark)}/region"
    sources.write_json(e.catalog.table("region"), path)
    e.query(f"COPY region FROM '{path}'")
    return e.query("SELECT * FROM region")


#: Statements that are refused while the shard of key 7 is locked, and by what.
REFUSED = {
    "SELECT o_orderkey FROM orders WHERE o_orderkey = 7": "ShardLockedError", "DELETE FROM orders WHERE o_orderkey = 7": "ShardLockedError",
    "UPDATE nation SET n_regionkey = 1": "NoTableScanError", "UPDATE orders SET o_orderkey = 1 WHERE o_orderkey = 2": "ShardKeyUpdateError",
}


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What refuses statements: a lock on a shard, a full scan, the shard key."""
    e = engine(spark, sf_dir)
    shards, found = e.catalog.shard("orders", "o_orderkey", 8, 2), []
    shards.locked.add(shard_of(7, 8))
    for sql in REFUSED:
        try:
            e.query(sql, notablescan="nation" in sql)
        except (NoTableScanError, ShardKeyUpdateError, ShardLockedError) as x:
            found.append((sql, type(x).__name__))
    return spark.createDataFrame(found, "statement string, error string")


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan and an index path read."""
    e, out = engine(spark, sf_dir), []
    for name, sql in (("scan", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"), ("index", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'")):
        seen = Observation(name)
        e.query(sql, observe=seen).write.format("noop").mode("overwrite").save()
        out.append((name, seen.get["table_tuples_scanned"], seen.get["index_tuples_fetched"]))
    return spark.createDataFrame(out, "query string, table_tuples_scanned long, index_tuples_fetched long")


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row by its tid, as one version of the table numbers its rows."""
    c = engine(spark, sf_dir).catalog
    return c.fetch("nation", c.with_tids("nation").filter("n_nationkey = 3").first()["_tid"])


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates that a caller adds: one of built-in ones, and one of steps."""
    functions.register_aggregate("lowest", lambda x, kind, strict: F.min(x))
    functions.register_aggregate("spread", functions.folded(0, lambda s, x: s * 2 + x.cast("long") % 2, lambda s: s % 97, "long"))
    try:
        return engine(spark, sf_dir).query("SELECT n_regionkey, lowest(n_nationkey) AS low, spread(n_nationkey) AS s FROM nation GROUP BY n_regionkey")
    finally:
        del functions.AGGREGATES["lowest"], functions.AGGREGATES["spread"]


_REPLAYED = """
WITH x AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id)
SELECT user_id AS tid, event_type, event_id FROM x WHERE event_id % 7 <> 0
"""
_ORDERS = "o_orderkey, o_custkey, o_orderstatus"
#: Name to a function and its SQL; None where SQL can't express it.
OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "index_scan_desc": (index_scan, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 AND o_orderkey >= 100 ORDER BY o_orderkey DESC"),
    "index_only_scan": (index_only, "SELECT l_partkey, count(*) AS n, count(*) AS n_tids FROM lineitem WHERE l_partkey > 100 AND l_partkey <= 300 GROUP BY l_partkey"),
    "append": (both_ends, "SELECT o_orderkey FROM orders WHERE o_custkey < 50 UNION ALL SELECT o_orderkey FROM orders WHERE o_custkey > 1400"),
    "merge_counts": (counts, 'SELECT count(*) AS "count" FROM orders'),
    "insert_values": (after("INSERT INTO region (r_regionkey, r_name) VALUES (90, 'NORTH'), (91)", table="region"), "SELECT * FROM region UNION ALL SELECT 90, 'NORTH' UNION ALL SELECT 91, NULL"),
    "insert_new_key": (after("INSERT INTO region (r_regionkey, extra) VALUES (90, 'x')", table="region"), "SELECT r_regionkey, r_name, NULL AS extra FROM region UNION ALL SELECT 90, NULL, 'x'"),
    "copy_json": (after("COPY region FROM STDIN", table="region", stdin=['{"r_regionkey": 90, "r_name": "N"}', '{"r_name": "only"}']), "SELECT * FROM region UNION ALL SELECT 90, 'N' UNION ALL SELECT NULL, 'only'"),
    "update_where": (after("UPDATE nation SET n_regionkey = 9 WHERE n_nationkey > 20 OR n_name = 'nope'", table="nation"), "SELECT n_nationkey, n_name, CAST(CASE WHEN n_nationkey > 20 THEN 9 ELSE n_regionkey END AS INTEGER) AS n_regionkey FROM nation"),
    "update_sequential": (after("UPDATE nation SET n_nationkey = n_regionkey, n_regionkey = n_nationkey WHERE n_nationkey < 10", table="nation"), "SELECT CASE WHEN n_nationkey < 10 THEN n_regionkey ELSE n_nationkey END AS n_nationkey, n_name, n_regionkey FROM nation"),
    "delete_where": (after("DELETE FROM nation WHERE n_regionkey = 1", "DELETE FROM nation WHERE n_nationkey > 20", table="nation"), "SELECT * FROM nation WHERE n_regionkey <> 1 AND n_nationkey <= 20"),
    "shard_point": (sharded(f"SELECT {_ORDERS} FROM orders WHERE o_orderkey = 7"), f"SELECT {_ORDERS} FROM orders WHERE o_orderkey = 7"),
    "shard_in": (sharded(f"SELECT {_ORDERS} FROM orders WHERE o_orderkey IN (1, 2, 5)"), f"SELECT {_ORDERS} FROM orders WHERE o_orderkey IN (1, 2, 5)"),
    "shard_partial_avg": (sharded("SELECT avg(o_custkey) AS a FROM orders"), "SELECT CAST(floor(sum(o_custkey) / count(*)) AS BIGINT) AS a FROM orders"),
    "shard_topk": (sharded("SELECT o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 10"), "SELECT o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 10"),
    "shard_group": (sharded("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"),
    "shard_update": (sharded("SELECT o_orderkey, o_custkey FROM orders", "UPDATE orders SET o_custkey = 1 WHERE o_orderkey = 7"), "SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 1 ELSE o_custkey END AS o_custkey FROM orders"),
    "reshard_move": (resharded, hashed("SELECT o_orderkey, CAST(h AS INTEGER) AS shard, CASE WHEN h >= 3 THEN 1 ELSE 0 END AS replica_set FROM (SELECT o_orderkey, {} % 8 AS h FROM orders, crc)")),
    "shard_insert": (sharded("SELECT o_orderkey, o_custkey FROM orders", "INSERT INTO orders (o_orderkey, o_custkey) VALUES (70001, 5), (70002, 6)"), "SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT 70001, 5 UNION ALL SELECT 70002, 6"),
    "shard_delete": (sharded("SELECT o_orderkey FROM orders", "DELETE FROM orders WHERE o_orderkey IN (1, 2, 7) AND o_custkey > 0", "DELETE FROM orders WHERE o_custkey < 100"), "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (1, 2, 7) AND o_custkey >= 100"),
    "csv_import": (imported("csv"), "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 1"),
    "json_import": (imported("json"), "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 1"),
    "json_encode": (json_encode, """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS "value" FROM region"""),
    "copy_file": (copy_file, "SELECT * FROM region UNION ALL SELECT * FROM region"),
    "guards": (guarded, " UNION ALL ".join(f"SELECT '{x}' AS statement, '{e}' AS error" for x, e in REFUSED.items())),
    "statistics": (statistics, "SELECT 'scan' AS query, count(*) AS table_tuples_scanned, 0 AS index_tuples_fetched FROM orders UNION ALL SELECT 'index', 0, count(*) FROM orders WHERE o_custkey = 7"),
    "fetch": (fetched, "SELECT * FROM nation WHERE n_nationkey = 3"),
    "registered_aggregate": (registered, "SELECT n_regionkey, min(n_nationkey) AS low, list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey)), lambda s, x: s * 2 + x % 2) % 97 AS s FROM nation GROUP BY n_regionkey"),
    "scalar_beside_aggregate": (plain("SELECT r_name, count(*) AS n FROM region LIMIT 0"), "SELECT count(*) AS n FROM region"),
    "explain": (lambda spark, sf_dir: engine(spark, sf_dir).query("EXPLAIN SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'"), """SELECT '["Project", ["Filter", ["IndexScan", "orders_cust_key", {"eq": [7]}]]]' AS explain"""),
    "journal_replay": (journal_replay, _REPLAYED),
    "journal_stream": (journal_stream, _REPLAYED),
    "journal_recover": (journal_recover, _REPLAYED.replace("SELECT user_id AS tid, ", "SELECT ")),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: plain(q) for k, (q, _) in PLAIN.items()} | {k: f for k, (f, _) in OTHER.items()}
ORACLE_SQL: dict[str, str] = {k: (q if s is None else s) for k, (q, s) in PLAIN.items() if s != ""} | {k: s for k, (_, s) in OTHER.items() if s}
