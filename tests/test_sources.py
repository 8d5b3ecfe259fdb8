import dataclasses
import time

import pytest
from pyspark.sql import functions as F

from goldseam.schemas import TABLES
from goldseam.sinks.files import write_all_snapshots, write_batches, write_parquet, write_snapshot
from goldseam.sources import chunks, files
from goldseam.session import shuffle_partitions_for, sized


def test_listing_and_reading_one_file(spark, tmp_path):
    root = str(tmp_path / "d")
    write_batches(spark.range(10), root, 4)
    listed = files.list_files(spark, root)
    assert listed.columns == ["path", "length", "modified"]
    first = listed.orderBy("path").first()
    assert files.read_parquet(spark, first.path).count() in (1, 2, 3, 4)
    assert files.ParquetSource(spark, root).input_bytes() == sum(
        r.length for r in listed.collect()
    )


def test_path_scanned_as_table(spark, tmp_path):
    write_parquet(spark.range(3).withColumn("x", F.lit(1)), f"{tmp_path}/t")
    assert files.scan_as_table(spark, f"{tmp_path}/t", "id").columns == ["id"]


def test_catalog_table(spark, tmp_path):
    from goldseam.sinks.files import write_table

    spark.sql("CREATE DATABASE IF NOT EXISTS gold")
    assert write_table(spark.range(4), "gold.four", path=f"{tmp_path}/four") == 4
    assert write_table(spark.range(3), "gold.four", path=f"{tmp_path}/four") == 3
    assert files.read_table(spark, "gold.four").count() == 3


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    write_snapshot(spark.range(1), root, "orders", "20250102_000000")
    write_snapshot(spark.range(2), root, "orders", "20250101_000000")
    assert files.read_snapshot(spark, root, "orders").count() == 2
    assert files.read_snapshot(spark, root, "orders", "20250102_000000").count() == 1
    write_snapshot(spark.range(5), root, "orders", "20250101_000000")
    assert files.read_snapshot(spark, root, "orders").count() == 5
    listed = {r.snapshot: r for r in files.list_snapshots(spark, root, "orders").collect()}
    assert {name: r.row_count for name, r in listed.items()} == {"20250101_000000": 5, "20250102_000000": 1}
    held = files.list_files(spark, f"{root}/orders/snapshot=20250101_000000").collect()
    one = listed["20250101_000000"]
    assert (one.files, one.bytes) == (len(held), sum(f.length for f in held))


def test_the_latest_snapshot_is_found_without_listing_files(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for n in (1, 2, 3):
        write_snapshot(spark.range(n), root, "orders", f"2025010{4 - n}_000000")
    monkeypatch.setattr(files, "list_files", None)
    assert files.read_snapshot(spark, root, "orders").count() == 3
    assert files.list_snapshots(spark, root, "orders").count() == 3


def test_snapshots_from_before_the_index(spark, tmp_path):
    for n, name in ((4, "20240101"), (6, "20240102")):
        spark.range(n).write.parquet(f"{tmp_path}/orders/snapshot={name}")
        time.sleep(1.1)
    with pytest.raises(FileNotFoundError):
        files.read_snapshot(spark, str(tmp_path), "orders")
    assert files.index_snapshots(spark, str(tmp_path), "orders") == ["20240101", "20240102"]
    assert files.index_snapshots(spark, str(tmp_path), "orders") == []
    assert files.read_snapshot(spark, str(tmp_path), "orders").count() == 6
    counts = {r.snapshot: r.row_count for r in files.list_snapshots(spark, str(tmp_path), "orders").collect()}
    assert counts == {"20240101": 4, "20240102": 6}


def test_one_name_for_all_snapshots(spark, tmp_path):
    names = write_all_snapshots({"a": spark.range(1), "b": spark.range(2)}, str(tmp_path))
    assert names["a"] == names["b"]
    assert files.read_snapshot(spark, str(tmp_path), "b").count() == 2


def test_no_snapshot(spark, tmp_path):
    (tmp_path / "orders").mkdir()
    with pytest.raises(FileNotFoundError):
        files.read_snapshot(spark, str(tmp_path), "orders")


ORDERS = TABLES["orders"]


def halved(keys, size):
    """Chunks by halving ranges one by one."""
    found = []

    def halve(number, level, held):
        if held and (len(held) <= size or not level):
            found.append((number << level, (number + 1) << level, len(held)))
        elif held:
            for half in (2 * number, 2 * number + 1):
                halve(half, level - 1, [k for k in held if k >> (level - 1) == half])

    known = [k for k in keys if k is not None]
    for sign in (-1, 0):
        halve(sign, 62, [k for k in known if k >> 62 == sign])
    nulls = len(keys) - len(known)
    return sorted(found) + ([(None, None, nulls)] if nulls else [])


def keys_of(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint")


CLUSTERS = [10**15 + k for k in range(200)] + [-(2**61) + 3 * k for k in range(90)] + [5] * 30 + [2**61]


@pytest.mark.parametrize("size", [1, 3, 25, 100, 1000])
@pytest.mark.parametrize("keys", [list(range(300)), CLUSTERS, [-1, 0], [None] * 4 + [7] * 9, [2**62 - 1]])
def test_chunks_are_halves_of_halves(spark, keys, size):
    rows = chunks.chunk_manifest(keys_of(spark, keys), ORDERS, size).orderBy("chunk_id").collect()
    assert [tuple(r)[2:] for r in rows] == halved(keys, size)
    assert [r.chunk_id for r in rows] == list(range(len(rows)))


def test_keys_at_the_ends_of_their_type(spark):
    keys = [-(2**63), 0, 2**62, 2**63 - 1]
    for size, ends in ((4, None), (1, None)):
        rows = chunks.chunk_manifest(keys_of(spark, keys), ORDERS, size).orderBy("chunk_id").collect()
        assert sum(r.row_count for r in rows) == 4 and rows[-1].high_key is ends
        assert all(a.high_key <= b.low_key for a, b in zip(rows, rows[1:]))


def test_ranges_stay_in_spark(spark, monkeypatch):
    """The driver learns one row per table, and a key is counted again only where keys repeat."""
    asked, learned = [], []
    collect = type(spark.range(1)).collect

    def recorded(frame):
        rows = collect(frame)
        learned.append(len(rows))
        return rows

    monkeypatch.setattr(type(spark.range(1)), "collect", recorded)
    hot = [5_000] * 40 + [5_001] * 90
    df = keys_of(spark, [*range(3_000), *(10**12 + k for k in range(2_000)), *hot])
    (table,) = chunks.keyed([(df, ORDERS)], 64)
    count = table.count

    def counted(*bounds):
        asked.append(bounds)
        return count(*bounds)

    found = chunks.cut([dataclasses.replace(table, count=counted)])
    assert asked == [(2, None, None), (0, 5_000, 5_001)] and learned == [1]
    assert found.count() > 70


def test_several_tables_are_cut_together(spark):
    frames = [
        (keys_of(spark, range(100)), ORDERS),
        (spark.range(0).selectExpr("id AS c_custkey"), TABLES["customer"]),
        (spark.createDataFrame([(None,)], "p_partkey bigint"), TABLES["part"]),
    ]
    rows = chunks.manifest(chunks.keyed(frames, 30)).orderBy("table_name", "chunk_id").collect()
    expected = [("orders", *r) for r in halved(list(range(100)), 30)] + [("part", None, None, 1)]
    assert [(r.table_name, r.low_key, r.high_key, r.row_count) for r in rows] == expected


def test_cover_tells_what_chunks_lack(spark):
    df = keys_of(spark, [*range(50), None])
    counts = spark.createDataFrame([("orders", 51)], "table_name string, row_count long")
    found = chunks.chunk_manifest(df, ORDERS, 10)
    assert tuple(chunks.cover(found, counts).first())[3:] == (51, 0, 0)
    lacking = chunks.cover(found.where("chunk_id != 1"), counts).first()
    assert lacking.missing == 51 - lacking.row_count > 0
    shifted = found.selectExpr("table_name", "chunk_id", "low_key", "high_key + 1 AS high_key", "row_count")
    assert chunks.cover(shifted, counts).first().overlaps > 0


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_predicates_and_scans_take_every_row_once(spark, size):
    rows = [(i, i % 5) for i in range(60)] + [(7, n) for n in range(-90, 90)]
    rows += [(None, 1), (7, None), (None, None), (10**12, 1), (-(2**40), 0)]
    df = spark.createDataFrame(rows, "o_orderkey bigint, n bigint")
    manifest = chunks.chunk_manifest(df, ORDERS, size)
    found = manifest.orderBy("chunk_id").collect()
    predicates = chunks.predicates(found, ("o_orderkey", "n"), size)
    hits = [F.coalesce(F.expr(p).cast("int"), F.lit(0)) for p in predicates]
    assert df.filter(sum(hits[1:], hits[0]) != 1).count() == 0
    for most in (1, 3, 100):
        frames = chunks.scans(df, "o_orderkey", manifest, most)
        assert len(frames) <= most + 1
        assert sum(f.count() for f in frames) == len(rows)


def test_scans_are_even_and_pruned(spark, tmp_path):
    spark.range(10_000).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    frames = chunks.scans(df, "o_orderkey", chunks.chunk_manifest(df, ORDERS, 100), 4)
    sizes = [f.count() for f in frames]
    assert sum(sizes) == 10_000 and len(sizes) == 5 and sizes[-1] == 0 and min(sizes[:4]) > 2_000
    for frame in frames[1:3]:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(o_orderkey," in plan and "LessThan(o_orderkey," in plan


def test_listing_of_all_files_or_of_a_suffix(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/a")
    spark.range(3).coalesce(1).write.json(f"{tmp_path}/b")
    assert files.list_files(spark, str(tmp_path)).count() == 2
    assert files.list_files(spark, str(tmp_path), ".parquet").count() == 1


def test_a_stage_is_sized_by_its_input(spark):
    assert shuffle_partitions_for(0, at_least=8) == 8
    assert shuffle_partitions_for(10 * 2**30) == 160
    assert shuffle_partitions_for(100 * 2**40) == 100 * 2**14
    partitions = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(partitions, None)
    for size in (2**40, 2**45, 0):
        with sized(spark, size):
            at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
            assert spark.conf.get(partitions) == str(shuffle_partitions_for(size, at_least))
    assert spark.conf.get(partitions, None) == before
