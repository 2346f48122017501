import io
import json
from zlib import crc32

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace import cli, functions, sources
from millrace import dialect as d
from millrace.catalog import Catalog
from millrace.engine import Engine
from millrace.errors import NoTableScanError, ShardKeyUpdateError, ShardLockedError, UnsupportedQueryError
from millrace.operators import append, key_condition, without_tid

USERS = [(1, "Ann", "a", False), (2, "Bob", "a", True), (3, "Cid", "b", True), (4, None, "b", True), (5, "Eve", None, None)]


@pytest.fixture
def engine(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/tables")
    c.create_table("users", spark.createDataFrame(USERS, "id long, name string, team string, active boolean"))
    c.create_table("empty", spark.createDataFrame([], "v long, w double"))
    return Engine(spark, c)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_conditions(engine):
    ids = lambda where: sorted(r[0] for r in rows(engine.query(f"select id from users where {where}")))
    assert ids("name = null") == [4]
    assert ids("name <> 'Ann'") == [2, 3, 4, 5]
    assert ids("name") == [1, 2, 3, 5]
    assert ids("active") == [2, 3, 4]
    assert ids("id = '1'") == []
    assert ids("id < 'x'") == []
    assert ids("team in ('a', null)") == [1, 2, 5]
    assert ids("name > 'B' and id < 5 or id = 1") == [1, 2, 3]
    assert ids("nope = nope") == [1, 2, 3, 4, 5]


def test_order_nulls_last_and_scope(engine):
    assert [r[0] for r in rows(engine.query("select id as name from users order by name desc"))] == [5, 3, 2, 1, 4]
    assert rows(engine.query("select team, count(*) as n from users group by team order by n desc, team limit 2")) == [("a", 2), ("b", 2)]


def test_aggregates(engine, spark):
    assert rows(engine.query("select count(name) as c, sum(v) as s, max(v) as m, avg(v) as a, avg(w) as b from empty")) == [(0, 0, 0, 0, 0.0)]
    engine.catalog.create_table("neg", spark.createDataFrame([(-1,), (-2,), (None,)], "v int"))
    assert rows(engine.query("select count(v) as c, sum(v) as s, max(v) as m, avg(v) as a from neg")) == [(3, -3, 0, -2)]
    with pytest.raises(UnsupportedQueryError):
        engine.query("select sum(name) from users")
    with pytest.raises(Exception, match="sum of null"):
        Engine(spark, engine.catalog, strict=True).query("select sum(v) from neg").collect()
    assert rows(engine.query("select count(1) as n")) == [(1,)]


def test_hidden_keys(engine):
    assert sorted(rows(engine.query("select count(*) as n from users group by team, active"))) == [(1,), (1,), (1,), (2,)]


def test_changes(engine):
    assert rows(engine.query("insert into users (id, extra) values (6, 'x'), (7)")) == [(2,)]
    assert rows(engine.query("update users set name = extra, extra = 'y' where id = 6")) == [(1,)]
    assert rows(engine.query("select name, extra from users where id = 6")) == [("x", "y")]
    assert rows(engine.query("delete from users where name = null")) == [(2,)]
    assert sorted(r[0] for r in rows(engine.query("select id from users"))) == [1, 2, 3, 5, 6]
    assert rows(engine.query("copy users from stdin", stdin=['{"id": 9}', '{"id": 10, "tag": "t"}'])) == [(2,)]
    with pytest.raises(UnsupportedQueryError):
        engine.query("update users set id = 'x'")
    assert rows(engine.query("delete from users")) == [(7,)]
    assert rows(engine.query("select count(*) as n from users")) == [(0,)]
    assert rows(engine.query("insert into empty (v) values (1)")) == [(1,)]


def test_failed_change_leaves_table(engine):
    with pytest.raises(UnsupportedQueryError):
        engine.query("update users set id = nope(1)")
    assert engine.catalog.table("users").count() == 5


def test_copy_file(engine, tmp_path):
    (tmp_path / "x.json").write_text('{"id": 8, "name": "H"}\n{"id": 9}\n')
    assert rows(engine.query(f"copy users from '{tmp_path}/x.json'")) == [(2,)]


@pytest.mark.parametrize(
    ("sql", "plan"),
    [
        ("select id from users where id = 1", ["Project", ["IndexScan", "i_id", {"eq": [1]}]]),
        ("select id from users where id > 1 and id <= 4", ["Project", ["IndexScan", "i_id", {"gt": [1], "lte": [4]}]]),
        ("select id from users order by id", ["Project", ["IndexScan", "i_id", {}]]),
        ("select id from users where id > 1 order by id", ["Project", ["IndexScan", "i_id", {"gt": [1]}]]),
        ("select id from users where team = 'a' order by name", ["Project", ["IndexScan", "i_team_name", {"eq": ["a"]}]]),
        ("select id from users where team = 'a' and name > 'A'", ["Project", ["IndexScan", "i_team_name", {"eq": ["a"], "gt": ["a", "A"]}]]),
        ("select id from users where upper(name) = 'X'", ["Project", ["IndexScan", "i_upper", {"eq": ["X"]}]]),
        ("select id from users where id = 1 and name <> 'x'", ["Project", ["Filter", ["IndexScan", "i_id", {"eq": [1]}]]]),
        ("select count(*) from users where id > 2", ["Aggregate", ["IndexOnlyScan", "i_id", {"gt": [2]}]]),
        ("select id from users order by active limit 1", ["Project", ["Limit", ["Sort", "TableScan"]]]),
        ("select team, count(*) as n from users group by team", ["HashAggregate", "TableScan"]),
        ("select 1", ["Project", "EmptyScan"]),
        ("delete from users where id = 1", ["Delete", ["IndexScan", "i_id", {"eq": [1]}]]),
    ],
)
def test_explain_and_index_equivalence(engine, sql, plan):
    before = rows(engine.query(sql)) if sql.startswith("select") else None
    for name, keys in (("i_id", ["id"]), ("i_team_name", ["team", "name"]), ("i_upper", [d.Call("upper", (d.Column("name"),))])):
        engine.catalog.create_index("users", name, keys)
    assert engine.explain(sql) == plan
    assert json.loads(engine.query(f"explain {sql}").first()[0]) == plan
    if before is not None:
        assert rows(engine.query(sql)) == before


def test_notablescan(engine):
    with pytest.raises(NoTableScanError):
        engine.query("select id from users where id = 1", notablescan=True)
    engine.catalog.create_index("users", "i", ["id"])
    assert rows(engine.query("select id from users where id = 1", notablescan=True)) == [(1,)]


def test_index_api(engine):
    c = engine.catalog
    c.create_index("users", "i", ["team", "id"])
    assert [r["id"] for r in c.index_scan("users", "i", {"in": [["a", 2], ["b", 3]]}).collect()] == [2, 3]
    assert [r["id"] for r in c.index_scan("users", "i", {"eq": ["b"]}, descending=True).collect()] == [4, 3]
    assert [r["id"] for r in c.index_scan("users", "i", {"eq": ["b"], "gt": ["b", 3]}).collect()] == [4]
    assert sorted(r["_count"] for r in c.index_only_scan("users", "i").collect()) == [1] * 5
    tid = c.with_tids("users").filter("id = 3").first()["_tid"]
    assert [r["id"] for r in c.fetch("users", tid).collect()] == [3]
    assert "_tid" not in without_tid(c.with_tids("users")).columns
    assert key_condition([F.col("id")], {}) is None


def test_shards(engine):
    shards = engine.catalog.shard("users", "id", 8, 2)
    df = engine.catalog.table("users")
    assert all(r["_shard"] == crc32(str(r["id"]).encode()) % 8 == functions.shard_of(r["id"], 8) for r in df.collect())
    plan = engine.query("select name from users where id in (1, 3)")._jdf.queryExecution().executedPlan().toString()
    assert "_shard" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert sorted(rows(engine.query("select name from users where id in (1, 3)"))) == [("Ann",), ("Cid",)]
    with pytest.raises(ShardKeyUpdateError):
        engine.query("update users set id = 1")
    target = 1 - shards.assignment[3]
    engine.query(f"reshard users move 3 to {target}")
    assert shards.assignment[3] == target and not shards.locked and 3 in shards.sets()[target]
    shards.locked.add(functions.shard_of(1, 8))
    for sql in ("select id from users where id = 1", "select id from users", "delete from users where id = 1"):
        with pytest.raises(ShardLockedError):
            engine.query(sql)
    with pytest.raises(RuntimeError, match="broke"):
        shards.locked.clear() or shards.move(3, 1 - target, lambda: (_ for _ in ()).throw(RuntimeError("broke")))
    assert shards.assignment[3] == target and not shards.locked
    with pytest.raises(UnsupportedQueryError):
        engine.query("reshard empty move 1 to 0")


def test_plans(engine, spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS k", "'x' AS wide").write.parquet(f"{tmp_path}/t")
    engine.catalog.import_parquet("wide", f"{tmp_path}/t")
    plan = lambda q: engine.query(q)._jdf.queryExecution().executedPlan().toString()
    p = plan("select id from wide where k = 3 and id > 10")
    assert "ReadSchema: struct<id:bigint,k:bigint>" in p and "GreaterThan(id,10)" in p and "EqualNullSafe(k,3)" in p
    assert "TakeOrderedAndProject" in plan("select id from wide order by k, id limit 3")
    assert "partial_count" in plan("select k, count(*) as n from wide group by k")


def test_sources(spark, tmp_path):
    (tmp_path / "u.csv").write_text("id,name,active\r\n1,Al,TRUE\r\n2,Bo,FALSE")
    df = sources.read_csv(spark, str(tmp_path / "u.csv"))
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("active", "string")]
    assert [json.loads(r[0]) for r in sources.json_lines(df).collect()][0] == {"id": 1, "name": "Al", "active": "TRUE"}
    sources.write_json(df, str(tmp_path / "out"))
    assert sources.read_json(spark, str(tmp_path / "out")).count() == 2
    assert list(sources.show([{"a": 1}], "json")) == ['{"a": 1}']
    with pytest.raises(ValueError):
        sources.show([], "xml")
    assert append(df, spark.range(1)).columns == ["id", "name", "active"]


def test_functions_and_stats(engine, spark):
    functions.register("twice", lambda x: x * 2)
    try:
        assert rows(engine.query("select twice(id) as doubled from users where id = 2")) == [(4,)]
    finally:
        del functions.SCALARS["twice"]
    with pytest.raises(UnsupportedQueryError):
        engine.query("select nope(id) from users")
    seen = Observation("scan")
    engine.query("select id from users where id > 3", observe=seen).collect()
    assert seen.get["table_tuples_scanned"] == 5


def test_cli(spark, tmp_path):
    (tmp_path / "u.csv").write_text("id,name\n1,Al\n2,Bo\n")
    out = io.StringIO()
    assert cli.main(["select name from u where id = 2", "--csv", f"u={tmp_path}/u.csv", "--format", "json"], spark, out) == 0
    assert json.loads(out.getvalue()) == {"name": "Bo"}
    assert cli.main(["select name from u", "--csv", f"u={tmp_path}/u.csv", "--notablescan"], spark, io.StringIO()) == 1


def test_insert_appends(engine, tmp_path):
    spark = engine.spark
    engine.catalog.replace("users", engine.catalog.table("users"))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "tables").rglob("*.parquet")}
    for k in range(3):
        engine.query(f"insert into users (id) values ({10 + k})")
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert sorted(r[0] for r in rows(engine.query("select id from users"))) == [1, 2, 3, 4, 5, 10, 11, 12]
    assert engine.catalog.insert("users", spark.createDataFrame([], "id long")) == 0


def test_many_inserts_are_written_together(engine, monkeypatch):
    from millrace import catalog

    monkeypatch.setattr(catalog, "MOST_FOLDERS", 3)
    for k in range(4):
        engine.query(f"insert into users (id) values ({10 + k})")
    assert engine.catalog.appended["users"] == 1
    assert engine.catalog.table("users").count() == 9


def test_changes_of_shards(engine, tmp_path):
    c = engine.catalog
    shards = c.shard("users", "id", 8, 2)
    files = lambda: set((tmp_path / "tables" / "users").rglob("*.parquet"))
    first = files()
    assert rows(engine.query("update users set name = 'Z' where id = 1")) == [(1,)]
    assert {p.parent.name for p in files() - first} == {f"_shard={functions.shard_of(1, 8)}"}
    assert rows(engine.query("delete from users where id in (1, 2)")) == [(2,)]
    assert rows(engine.query("insert into users (id, name) values (9, 'I')")) == [(1,)]
    assert sorted(rows(engine.query("select id, name from users"))) == [(3, "Cid"), (4, None), (5, "Eve"), (9, "I")]
    shard = functions.shard_of(9, 8)
    target = 1 - shards.assignment[shard]
    n = c.table("users").filter(F.col("_shard") == shard).count()
    assert rows(engine.query(f"reshard users move {shard} to {target}")) == [(n,)]
    where = {r["id"]: (r["_shard"], r["_set"]) for r in c.placement("users").collect()}
    assert where[9] == (shard, target) and all(s == shards.assignment[k] for k, s in where.values())
    assert f"_set={target}/_shard={shard}" in " ".join(c.table("users").inputFiles())
    assert rows(engine.query("delete from users")) == [(4,)]
    assert rows(engine.query("select count(*) as n from users")) == [(0,)]
    assert rows(engine.query("insert into users (id, name) values (1, 'A')")) == [(1,)]
    assert rows(engine.query("select id, name from users where id = 1")) == [(1, "A")]


def test_failed_move_leaves_rows(engine, monkeypatch):
    c = engine.catalog
    shards = c.shard("users", "id", 8, 2)
    shard = functions.shard_of(1, 8)
    home = shards.assignment[shard]
    monkeypatch.setattr("millrace.catalog.written", lambda *_: (_ for _ in ()).throw(RuntimeError("broke")))
    with pytest.raises(RuntimeError):
        c.reshard("users", shard, 1 - home)
    assert shards.assignment[shard] == home and not shards.locked
    assert {r["_set"] for r in c.placement("users").filter(F.col("_shard") == shard).collect()} == {home}


def test_recover_and_apply(spark, tmp_path):
    lines = [{"op": "insert", "payload": ["u", 0, {"a": 1}]}, {"op": "insert", "payload": ["w", 0, {"b": "x"}]}, {"op": "update", "payload": ["u", 0, {"a": 1}, {"a": 5}]}]
    (tmp_path / "log").write_text("".join(json.dumps(x) + "\n" for x in lines))
    c = Catalog(spark)
    c.recover(str(tmp_path / "log"), {"u": "a long", "w": "b string"})
    assert rows(c.table("u")) == [(5,)] and rows(c.table("w")) == [("x",)]


def test_statistics_of_shards(engine):
    engine.catalog.shard("users", "id", 8, 2)
    for sql, asked in (("select name from users where id = 3", 1), ("select name from users", 2)):
        seen = Observation("asked")
        engine.query(sql, observe=seen).collect()
        assert seen.get["backend_requests"] == asked
