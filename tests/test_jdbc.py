"""What is asked of the database; no database is started for it."""

import dataclasses
import re
from unittest.mock import MagicMock

import duckdb
import pytest
from pyspark.sql import functions as F

from goldseam.schemas import TABLES
from goldseam.sinks.warehouse import JdbcSink, LoadFailed
from goldseam.sources.jdbc import JdbcSource


class Answers:
    """A reader that records its calls and answers counts from a list of keys."""

    def __init__(self, keys, result=None, spark=None):
        self.calls, self.keys, self.result, self.spark = [], keys, result, spark

    def jdbc(self, url, table, predicates=None, properties=None):
        self.calls.append((table, predicates, properties))
        keys = [k for k in self.keys if k is not None]
        if width := re.search(r"MOD\(\w+, (\d+)\)", table):
            between = re.search(r"BETWEEN (-?\d+) AND (-?\d+)", table)
            held = {}
            for k in keys if between else self.keys:
                if not between or int(between[1]) <= k <= int(between[2]):
                    held.setdefault(None if k is None else k - k % int(width[1]), []).append(k)
            rows = [
                (first, len(ks), *((None, None) if first is None else (min(ks), max(ks))))
                for first, ks in held.items()
            ]
            return self.spark.createDataFrame(rows, "first_key long, n long, least long, most long")
        frame = MagicMock()
        frame.first.return_value = self.result
        return frame


def session(answers):
    spark = MagicMock()
    spark.read = answers
    return spark


@pytest.fixture
def predicates(spark):
    def read(keys, table="orders"):
        answers = Answers(keys, spark=spark)
        JdbcSource(session(answers), "jdbc:x").read(table)
        return answers.calls[-1][1]

    return read


@pytest.fixture
def chunk_rows(monkeypatch):
    def set_rows(table, rows):
        monkeypatch.setitem(TABLES, table, dataclasses.replace(TABLES[table], chunk_size=rows))

    return set_rows


def test_small_tables_are_read_whole():
    answers = Answers([])
    JdbcSource(session(answers), "jdbc:x", {"user": "u"}, prefix="s.").read("supplier")
    assert answers.calls == [("s.supplier", None, {"fetchsize": "10000", "user": "u"})]


def test_large_tables_are_read_as_key_ranges(predicates, chunk_rows):
    chunk_rows("orders", 300)
    assert predicates(range(1000)) == [
        "o_orderkey < 256",
        "o_orderkey >= 256 AND o_orderkey < 512",
        "o_orderkey >= 512 AND o_orderkey < 768",
        "o_orderkey >= 768",
        "o_orderkey IS NULL",
    ]


def test_an_outlier_key_leaves_the_chunks_even(spark, predicates, chunk_rows):
    chunk_rows("orders", 100)
    keys = [*range(1, 1001), 10**12, -(10**9), None]
    found = predicates(keys)
    df = spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint")
    sizes = [df.filter(F.expr(p)).count() for p in found]
    assert sum(sizes) == len(keys) and max(sizes) <= 100 and len(sizes) < 40


def test_a_hot_key_and_hot_nulls_are_cut_by_the_second_key(predicates, chunk_rows):
    chunk_rows("lineitem", 100)
    found = predicates([7] * 350 + list(range(20)) + [None] * 250, "lineitem")
    assert sum("MOD(ABS(l_linenumber), 4)" in p for p in found) == 4
    assert sum("l_orderkey IS NULL) AND" in p and "MOD(ABS(l_linenumber), 3)" in p for p in found) == 3


def test_an_empty_table_is_read(predicates):
    assert predicates([]) == ["o_orderkey IS NOT NULL", "o_orderkey IS NULL"]


def test_sink_counts_in_the_database():
    answers = Answers([], result=(12,))
    sink = JdbcSink(session(answers), "jdbc:x", {})
    assert sink.row_count("dim_part") == 12
    assert answers.calls[0][0] == "(SELECT COUNT(*) AS n FROM marts.dim_part) q"


class Database:
    """A database in this process, behind the calls of a JDBC connection; records its statements."""

    def __init__(self, stop_at=None):
        self.said, self.stop_at = [], stop_at
        self.held = duckdb.connect()
        self.held.execute("CREATE SCHEMA marts")

    def __call__(self):
        return self

    def setAutoCommit(self, on):  # noqa: N802
        self.said.append(f"autocommit {on}")
        self.held.execute("BEGIN")

    def createStatement(self):  # noqa: N802
        return self

    def executeUpdate(self, sql):  # noqa: N802
        verb = sql.split()[0]
        self.said.append(verb)
        if verb == self.stop_at:
            raise OSError("connection lost")
        rows = self.held.execute(sql).fetchall()
        return rows[0][0] if verb in ("INSERT", "DELETE") else 0

    def commit(self):
        self.said.append("commit")
        if self.stop_at == "commit":
            raise OSError("connection lost")
        self.held.execute("COMMIT")

    def rollback(self):
        self.said.append("rollback")
        self.held.execute("ROLLBACK")

    def close(self):
        self.said.append("close")

    def rows(self, table="marts.dim_part"):
        return sorted(self.held.execute(f"SELECT id FROM {table}").fetchall())


class Staged(JdbcSink):
    """Writes what Spark would into the database, some tasks more than once."""

    again = ()

    def _jdbc(self, df, table, mode):
        rows, database = df.collect(), self.connect
        if mode == "append":
            database.held.execute(f"CREATE TABLE IF NOT EXISTS {table} (id BIGINT)")
            return
        database.held.execute(f"CREATE TABLE {table} (id BIGINT, load_task BIGINT, load_attempt BIGINT)")
        tasks = {r.load_task for r in rows}
        assert len({(r.load_task, r.load_attempt) for r in rows}) == len(tasks) > 1
        for r in rows:
            for more in range(2 if r.load_task in self.again else 1):
                database.held.execute(
                    f"INSERT INTO {table} VALUES (?, ?, ?)", [r.id, r.load_task, r.load_attempt + 1000 * more]
                )


def frame(spark, first, last):
    return spark.range(first, last, numPartitions=4)


@pytest.mark.parametrize("again", [(), (1,), (0, 2, 3)])
def test_tasks_that_ran_twice_are_loaded_once(spark, again):
    database = Database()
    sink = Staged(spark, "jdbc:x", {}, connect=database)
    object.__setattr__(sink, "again", again)
    for first, last in ((0, 40), (10, 30)):
        database.said.clear()
        assert sink.write(frame(spark, first, last), "dim_part") == last - first
        assert database.rows() == [(i,) for i in range(first, last)]
        assert database.said == ["autocommit False", "DELETE", "INSERT", "commit", "close", "DROP", "close"]
    left = database.held.execute("SELECT table_name FROM information_schema.tables").fetchall()
    assert left == [("dim_part",)]


@pytest.mark.parametrize("stop_at", ["DELETE", "INSERT", "commit"])
def test_a_load_that_is_stopped_leaves_the_old_rows(spark, stop_at):
    database = Database()
    sink = Staged(spark, "jdbc:x", {}, connect=database)
    sink.write(frame(spark, 0, 9), "dim_part")
    database.stop_at = stop_at
    with pytest.raises(OSError, match="lost"):
        sink.write(frame(spark, 50, 99), "dim_part")
    assert "rollback" in database.said
    database.stop_at = None
    assert database.rows() == [(i,) for i in range(9)]
    assert sink.write(frame(spark, 50, 99), "dim_part") == 49
    assert database.rows() == [(i,) for i in range(50, 99)]


def test_rows_that_do_not_arrive_fail_the_load(spark):
    class Lossy(Staged):
        def _jdbc(self, df, table, mode):
            super()._jdbc(df.where("id != 3") if mode == "error" else df, table, mode)

    database = Database()
    with pytest.raises(LoadFailed, match="wrote 20 rows, 19 arrived"):
        Lossy(spark, "jdbc:x", {}, connect=database).write(frame(spark, 0, 20), "dim_part")
    assert database.rows() == []


@pytest.mark.parametrize("connections", [None, 5])
def test_connections_are_bounded_only_on_demand(connections):
    df, writer = MagicMock(), MagicMock()
    df.write.option.return_value = writer
    writer.option.return_value = writer
    JdbcSink(MagicMock(), "jdbc:x", {}, connections=connections)._jdbc(df, "t", "append")
    asked = [c.args for c in writer.option.call_args_list if c.args[0] == "numPartitions"]
    assert asked == ([("numPartitions", 5)] if connections else [])
