from collections import Counter

from goldseam.operators import quality as q


def table(df):
    return {(r.table_name, r.rule): (r.checked, r.failed) for r in df.collect()}


def test_row_rules(spark):
    df = spark.createDataFrame([(1, "A"), (None, "B"), (-1, None)], "v int, s string")
    rules = [
        *q.not_null_rules(["v"]),
        q.Rule("range:v > 0", "v > 0"),
        *q.accepted_value_rules({"s": ("A",)}),
    ]
    assert table(q.check_rows(df, "t", rules)) == {
        ("t", "not_null:v"): (3, 1),
        ("t", "range:v > 0"): (3, 2),
        ("t", "accepted_values:s"): (3, 2),
    }


def test_unique_against_brute_force(spark):
    pairs = [(i % 7, i % 3) for i in range(50)] + [(None, 1), (1, None)] + [(5, 5)] * 40
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    counts = Counter(p for p in pairs if None not in p)
    single = Counter(p[0] for p in pairs if p[0] is not None)
    assert table(q.check_unique({"two": (df, ("a", "b")), "one": (df, ("a",))})) == {
        ("two", "unique:a,b"): (sum(counts.values()), sum(counts.values()) - len(counts)),
        ("one", "unique:a"): (sum(single.values()), sum(single.values()) - len(single)),
    }


def test_references_against_brute_force(spark):
    child_rows = [(i % 10, i % 4) for i in range(60)] + [(None, 0), (99, None)] + [(77, 1)] * 30
    child = spark.createDataFrame(child_rows, "p bigint, o bigint")
    parent = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 3, None)], "k bigint")
    other = spark.createDataFrame([], "k bigint")
    found = q.check_references(
        {"child": child, "parent": parent, "other": other},
        [q.Reference("child", "p", "parent", "k"), q.Reference("child", "o", "other", "k")],
    )
    p = [r[0] for r in child_rows if r[0] is not None]
    o = [r[1] for r in child_rows if r[1] is not None]
    assert table(found) == {
        ("child", "relationship:p->parent.k"): (len(p), sum(v > 3 for v in p)),
        ("child", "relationship:o->other.k"): (len(o), len(o)),
    }


def test_score_and_reconcile(spark):
    checks = spark.createDataFrame(
        [("a", "r1", 90, 1), ("b", "r2", 10, 4)],
        "table_name string, rule string, checked bigint, failed bigint",
    )
    assert tuple(q.score(checks).first()) == (2, 100, 5, 0.95)
    counts = q.reconcile(
        {"bronze": {"a": spark.range(5), "b": spark.range(2)}, "gold": {"a": spark.range(4)}}
    )
    assert {tuple(r) for r in counts.collect()} == {("a", 5, 4), ("b", 2, None)}


def test_keys_of_any_width(spark):
    rows = [(1, 1, 1), (1, 1, 2), (1, 1, 3), (1, 1, None)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint")
    assert table(q.check_unique({"t": (df, ("a", "b", "c"))})) == {("t", "unique:a,b,c"): (3, 0)}


def test_rules_of_empty_tables_are_reported(spark):
    none, some = (spark.createDataFrame(rows, "k bigint") for rows in ([], [(1,), (1,)]))
    found = q.check_keys(
        {"none": none, "some": some},
        {"none": ("k",), "some": ("k",)},
        [q.Reference("none", "k", "none", "k"), q.Reference("some", "k", "none", "k")],
    )
    assert table(found) == {
        ("none", "unique:k"): (0, 0),
        ("some", "unique:k"): (2, 1),
        ("none", "relationship:k->none.k"): (0, 0),
        ("some", "relationship:k->none.k"): (2, 2),
    }
