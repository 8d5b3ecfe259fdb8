"""DuckDB SQL for every registered query, written independently of the Spark code.

A statement is a final SELECT plus the common table expressions it names, each of which lists
the ones it needs.  ``b_`` is Bronze, ``s_`` Silver, ``g_`` Gold.
"""

from __future__ import annotations

import re

# Python str.isspace-like whitespace for trim(text, characters).
_BLANKS = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(32)||chr(133)||chr(160)||chr(5760)||"
    + "||".join(f"chr({code})" for code in range(8192, 8203))
    + "||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
)

CTES: dict[str, str] = {
    # ---- Bronze -------------------------------------------------------------------------
    "b_region": """
        SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name,
               CAST(NULL AS VARCHAR) AS r_comment
        FROM region""",
    "b_nation": """
        SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name,
               CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(NULL AS VARCHAR) AS n_comment
        FROM nation""",
    "b_supplier": """
        SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name,
               CAST(NULL AS VARCHAR) AS s_address, CAST(s_nationkey AS BIGINT) AS s_nationkey,
               CAST(NULL AS VARCHAR) AS s_phone, CAST(s_acctbal AS DECIMAL(15,2)) AS s_acctbal,
               CAST(NULL AS VARCHAR) AS s_comment
        FROM supplier""",
    "b_customer": """
        SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name,
               CAST(NULL AS VARCHAR) AS c_address, CAST(c_nationkey AS BIGINT) AS c_nationkey,
               CAST(NULL AS VARCHAR) AS c_phone, CAST(c_acctbal AS DECIMAL(15,2)) AS c_acctbal,
               c_mktsegment, CAST(NULL AS VARCHAR) AS c_comment
        FROM customer""",
    "b_part": """
        SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, CAST(NULL AS VARCHAR) AS p_mfgr,
               p_brand, p_type, CAST(p_size AS INTEGER) AS p_size,
               CAST(NULL AS VARCHAR) AS p_container,
               CAST(p_retailprice AS DECIMAL(15,2)) AS p_retailprice,
               CAST(NULL AS VARCHAR) AS p_comment
        FROM part""",
    "b_partsupp": """
        SELECT p AS ps_partkey, s AS ps_suppkey,
               CAST(CASE WHEN (31*p + 17*s) % 10 = 0 THEN (p + s) % 101
                         WHEN (31*p + 17*s) % 10 < 4 THEN 101 + (7*p + s) % 900
                         ELSE 1001 + (13*p + 29*s) % 8999 END AS DECIMAL(15,2)) AS ps_availqty,
               CAST((100 + (53*p + 97*s) % 99900) * CAST(0.01 AS DECIMAL(3,2))
                    AS DECIMAL(15,2)) AS ps_supplycost,
               CAST(NULL AS VARCHAR) AS ps_comment
        FROM (SELECT DISTINCT CAST(l_partkey AS BIGINT) AS p, CAST(l_suppkey AS BIGINT) AS s
              FROM lineitem) pairs""",
    "b_orders": """
        SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey,
               o_orderstatus, CAST(o_totalprice AS DECIMAL(15,2)) AS o_totalprice,
               CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority,
               CAST(NULL AS VARCHAR) AS o_clerk, CAST(NULL AS INTEGER) AS o_shippriority,
               CAST(NULL AS VARCHAR) AS o_comment
        FROM orders""",
    "b_lineitem": """
        SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_partkey AS BIGINT) AS l_partkey,
               CAST(l_suppkey AS BIGINT) AS l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
               CAST(l_quantity AS DECIMAL(15,2)) AS l_quantity,
               CAST(l_extendedprice AS DECIMAL(15,2)) AS l_extendedprice,
               CAST(l_discount AS DECIMAL(15,2)) AS l_discount,
               CAST(l_tax AS DECIMAL(15,2)) AS l_tax, l_returnflag, l_linestatus,
               CAST(l_shipdate AS DATE) AS l_shipdate, CAST(NULL AS DATE) AS l_commitdate,
               CAST(NULL AS DATE) AS l_receiptdate, CAST(NULL AS VARCHAR) AS l_shipinstruct,
               CAST(NULL AS VARCHAR) AS l_shipmode, CAST(NULL AS VARCHAR) AS l_comment
        FROM lineitem""",
    # ---- Silver -------------------------------------------------------------------------
    "s_region": f"""
        SELECT r_regionkey, trim(r_name, ' ') AS r_name, r_comment,
               trim(r_name, {_BLANKS}) AS r_name_clean
        FROM b_region""",
    "s_nation": """
        SELECT * REPLACE (trim(n_name, ' ') AS n_name, trim(n_comment, ' ') AS n_comment)
        FROM b_nation""",
    "s_supplier": """
        SELECT * REPLACE (trim(s_name, ' ') AS s_name, trim(s_address, ' ') AS s_address,
                          trim(s_phone, ' ') AS s_phone, trim(s_comment, ' ') AS s_comment),
               CASE WHEN s_acctbal < 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END AS s_acctbal_status
        FROM b_supplier""",
    "s_customer": """
        SELECT * REPLACE (trim(c_name, ' ') AS c_name, trim(c_address, ' ') AS c_address,
                          trim(c_phone, ' ') AS c_phone, trim(c_mktsegment, ' ') AS c_mktsegment,
                          trim(c_comment, ' ') AS c_comment),
               CASE WHEN c_acctbal < 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END AS c_acctbal_status
        FROM b_customer""",
    "s_part": """
        SELECT * REPLACE (trim(p_name, ' ') AS p_name, trim(p_mfgr, ' ') AS p_mfgr,
                          trim(p_brand, ' ') AS p_brand, trim(p_type, ' ') AS p_type,
                          trim(p_container, ' ') AS p_container, trim(p_comment, ' ') AS p_comment),
               CASE WHEN p_size < 10 THEN 'SMALL' WHEN p_size < 30 THEN 'MEDIUM'
                    ELSE 'LARGE' END AS p_size_category
        FROM b_part""",
    "s_partsupp": "SELECT * REPLACE (trim(ps_comment, ' ') AS ps_comment) FROM b_partsupp",
    "s_orders": """
        SELECT * REPLACE (trim(o_orderstatus, ' ') AS o_orderstatus,
                          trim(o_orderpriority, ' ') AS o_orderpriority,
                          trim(o_clerk, ' ') AS o_clerk,
                          trim(o_comment, ' ') AS o_comment),
               CAST(year(o_orderdate) AS INTEGER) AS o_year,
               CAST(quarter(o_orderdate) AS INTEGER) AS o_quarter
        FROM b_orders WHERE o_totalprice > 0""",
    "s_lineitem": """
        SELECT * REPLACE (trim(l_returnflag, ' ') AS l_returnflag,
                          trim(l_linestatus, ' ') AS l_linestatus,
                          trim(l_shipinstruct, ' ') AS l_shipinstruct,
                          trim(l_shipmode, ' ') AS l_shipmode,
                          trim(l_comment, ' ') AS l_comment),
               l_discount * 100 AS l_discount_percentage,
               l_extendedprice * (1 - l_discount) AS l_net_price,
               CAST(year(l_shipdate) AS INTEGER) AS l_ship_year
        FROM b_lineitem""",
    # ---- Gold ---------------------------------------------------------------------------
    "g_dim_customer": """
        SELECT c_custkey AS customer_key, c_name AS customer_name, c_address AS customer_address,
               c_mktsegment AS market_segment, c_nationkey AS nation_key, n_name AS nation_name,
               n_regionkey AS region_key, r_name AS region_name, c_phone AS customer_phone,
               c_acctbal AS account_balance, c_acctbal_status AS account_balance_status,
               c_comment AS customer_comment
        FROM s_customer LEFT JOIN s_nation ON c_nationkey = n_nationkey
        LEFT JOIN s_region ON n_regionkey = r_regionkey""",
    "g_dim_supplier": """
        SELECT s_suppkey AS supplier_key, s_name AS supplier_name, s_address AS supplier_address,
               s_nationkey AS nation_key, n_name AS nation_name, n_regionkey AS region_key,
               r_name AS region_name, s_phone AS supplier_phone, s_acctbal AS account_balance,
               s_comment AS supplier_comment
        FROM s_supplier LEFT JOIN s_nation ON s_nationkey = n_nationkey
        LEFT JOIN s_region ON n_regionkey = r_regionkey""",
    "g_dim_part": """
        SELECT p_partkey AS part_key, p_name AS name, p_mfgr AS mfgr, p_brand AS brand,
               p_type AS type, p_size AS size, p_container AS container,
               p_retailprice AS retail_price, p_comment AS part_comment
        FROM s_part""",
    "g_dim_date": """
        SELECT date_key, CAST(year(date_key) AS INTEGER) AS year,
               CAST(month(date_key) AS INTEGER) AS month, CAST(day(date_key) AS INTEGER) AS day,
               CAST(quarter(date_key) AS INTEGER) AS quarter,
               CAST(weekofyear(date_key) AS INTEGER) AS week_of_year,
               CAST(dayofweek(date_key) + 1 AS INTEGER) AS day_of_week,
               dayofweek(date_key) IN (0, 6) AS is_weekend
        FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate),
                                                 INTERVAL 1 DAY)) AS DATE) AS date_key
              FROM s_orders) days""",
    "g_fct_sales": """
        SELECT l_orderkey AS order_key, l_linenumber AS line_number, o_custkey AS customer_key,
               l_partkey AS part_key, l_suppkey AS supplier_key, o_orderdate AS order_date,
               l_shipdate AS ship_date, l_quantity AS quantity,
               l_extendedprice AS extended_price, l_discount AS discount, l_tax AS tax,
               l_extendedprice * (1 - l_discount) AS net_price,
               l_extendedprice * (1 - l_discount) * (1 + l_tax) AS total_price,
               l_extendedprice * l_discount AS discount_amount,
               o_orderstatus AS order_status, o_orderpriority AS order_priority,
               o_totalprice AS order_total_price, l_returnflag AS return_flag,
               l_linestatus AS line_status, l_shipmode AS ship_mode,
               l_commitdate AS commit_date, l_receiptdate AS receipt_date
        FROM s_lineitem JOIN s_orders ON l_orderkey = o_orderkey""",
    "g_revenue": """
        SELECT supplier_key, order_date AS date_key,
               count(DISTINCT order_key) AS total_orders, count(*) AS total_line_items,
               sum(quantity) AS total_quantity, sum(net_price) AS revenue,
               sum(extended_price) AS gross_revenue, sum(total_price) AS total_revenue,
               sum(discount_amount) AS total_discount, count(extended_price) AS priced,
               max(extended_price) AS max_line_value, min(extended_price) AS min_line_value,
               CASE WHEN sum(net_price) > 50000 THEN 'High Performer'
                    WHEN sum(net_price) > 10000 THEN 'Medium Performer'
                    ELSE 'Low Performer' END AS performance_tier
        FROM g_fct_sales GROUP BY supplier_key, order_date""",
    "g_inventory": """
        SELECT ps_partkey AS part_key, ps_suppkey AS supplier_key,
               ps_availqty AS available_qty, ps_supplycost AS supply_cost,
               ps_availqty * ps_supplycost AS total_inventory_value, name AS part_name,
               mfgr AS part_mfgr, brand AS part_brand, type AS part_type, retail_price,
               supplier_name, nation_name AS supplier_nation, region_name AS supplier_region,
               CASE WHEN ps_availqty > 1000 THEN 'High Stock'
                    WHEN ps_availqty > 100 THEN 'Medium Stock'
                    ELSE 'Low Stock' END AS stock_level,
               CASE WHEN ps_supplycost < retail_price * 0.5 THEN 'Low Cost'
                    WHEN ps_supplycost < retail_price * 0.7 THEN 'Medium Cost'
                    ELSE 'High Cost' END AS cost_category
        FROM s_partsupp LEFT JOIN g_dim_part ON ps_partkey = part_key
        LEFT JOIN g_dim_supplier ON ps_suppkey = supplier_key""",
}

TABLES = ("region", "nation", "supplier", "customer", "part", "partsupp", "orders", "lineitem")

# Columns and Bronze types of each table, in order.
COLUMNS: dict[str, str] = {
    "region": "r_regionkey bigint, r_name string, r_comment string",
    "nation": "n_nationkey bigint, n_name string, n_regionkey bigint, n_comment string",
    "supplier": "s_suppkey bigint, s_name string, s_address string, s_nationkey bigint, "
    "s_phone string, s_acctbal decimal(15,2), s_comment string",
    "customer": "c_custkey bigint, c_name string, c_address string, c_nationkey bigint, "
    "c_phone string, c_acctbal decimal(15,2), c_mktsegment string, c_comment string",
    "part": "p_partkey bigint, p_name string, p_mfgr string, p_brand string, p_type string, "
    "p_size int, p_container string, p_retailprice decimal(15,2), p_comment string",
    "partsupp": "ps_partkey bigint, ps_suppkey bigint, ps_availqty decimal(15,2), "
    "ps_supplycost decimal(15,2), ps_comment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice decimal(15,2), o_orderdate date, o_orderpriority string, o_clerk string, "
    "o_shippriority int, o_comment string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, "
    "l_quantity decimal(15,2), l_extendedprice decimal(15,2), l_discount decimal(15,2), "
    "l_tax decimal(15,2), l_returnflag string, l_linestatus string, l_shipdate date, "
    "l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, "
    "l_comment string",
}

KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "supplier": ("s_suppkey",),
    "customer": ("c_custkey",),
    "part": ("p_partkey",),
    "partsupp": ("ps_partkey", "ps_suppkey"),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"),
}

CHUNK_ROWS = 1000
STRATA = {"customer": "c_mktsegment", "orders": "o_orderstatus", "lineitem": "l_returnflag"}
STRATUM_ROWS = 4

FACT_KEYS = {
    "fct_sales": ("g_fct_sales", "order_key", "line_number"),
    "fct_inventory": ("g_inventory", "part_key", "supplier_key"),
    "fct_revenue_by_supplier": ("g_revenue", "supplier_key", "date_key"),
}

RANGES = (
    ("part", "p_retailprice", "> 0"),
    ("partsupp", "ps_availqty", ">= 0"),
    ("partsupp", "ps_supplycost", "> 0"),
    ("orders", "o_totalprice", "> 0"),
    ("lineitem", "l_quantity", "> 0"),
)

ACCEPTED = (
    ("supplier", "s_supplier", "s_acctbal_status", "'NEGATIVE', 'POSITIVE'"),
    ("customer", "s_customer", "c_acctbal_status", "'NEGATIVE', 'POSITIVE'"),
    ("part", "s_part", "p_size_category", "'SMALL', 'MEDIUM', 'LARGE'"),
    (
        "fct_revenue_by_supplier",
        "g_revenue",
        "performance_tier",
        "'High Performer', 'Medium Performer', 'Low Performer'",
    ),
    ("fct_inventory", "g_inventory", "stock_level", "'High Stock', 'Medium Stock', 'Low Stock'"),
    ("fct_inventory", "g_inventory", "cost_category", "'Low Cost', 'Medium Cost', 'High Cost'"),
)

# child, its relation, column, parent, its relation, parent column
REFERENCES = (
    ("nation", "s_nation", "n_regionkey", "region", "s_region", "r_regionkey"),
    ("supplier", "s_supplier", "s_nationkey", "nation", "s_nation", "n_nationkey"),
    ("customer", "s_customer", "c_nationkey", "nation", "s_nation", "n_nationkey"),
    ("partsupp", "s_partsupp", "ps_partkey", "part", "s_part", "p_partkey"),
    ("partsupp", "s_partsupp", "ps_suppkey", "supplier", "s_supplier", "s_suppkey"),
    ("orders", "s_orders", "o_custkey", "customer", "s_customer", "c_custkey"),
    ("lineitem", "s_lineitem", "l_orderkey", "orders", "s_orders", "o_orderkey"),
    ("lineitem", "s_lineitem", "l_partkey", "part", "s_part", "p_partkey"),
    ("lineitem", "s_lineitem", "l_suppkey", "supplier", "s_supplier", "s_suppkey"),
    ("fct_sales", "g_fct_sales", "order_date", "dim_date", "g_dim_date", "date_key"),
    ("fct_sales", "g_fct_sales", "ship_date", "dim_date", "g_dim_date", "date_key"),
)

_CTE_NAME = re.compile(r"\b[bsg]_[a-z_]+\b")


def statements() -> dict[str, str]:
    finals = {
        **_sources(),
        **_layers(),
        **_marts(),
        **_profiles(),
        **_quality(),
        **_dashboards(),
    }
    return {name: _with_ctes(final) for name, final in finals.items()}


def _with_ctes(final: str) -> str:
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in dict.fromkeys(_CTE_NAME.findall(sql)):
            if name in CTES and name not in needed:
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(final)
    ctes = ",\n".join(f"{name} AS ({CTES[name]})" for name in needed)
    return f"WITH {ctes}\n{final}" if needed else final


def _double(expression: str) -> str:
    """Decimal to the nearest double; through text, because a direct cast may be one off."""
    return f"CAST(CAST({expression} AS VARCHAR) AS DOUBLE)"


def _unscaled(decimal: str) -> str:
    return f"CAST(replace(CAST({decimal} AS VARCHAR), '.', '') AS HUGEINT)"


def _ratio(numerator: str, denominator: str, factor: int) -> str:
    """Quotient of whole numbers times ``factor``, rounded half up to six decimals."""
    n, d = f"({numerator})", f"NULLIF(CAST({denominator} AS HUGEINT), 0)"
    micro = f"((2 * abs({n}) * {factor} + abs({d})) // (2 * abs({d})))"
    return f"(sign({n}) * sign({d}) * CAST({micro} AS DOUBLE) / 1000000.0)"


def _doubles(columns: str) -> str:
    return ", ".join(f"{_double(c)} AS {c}" for c in columns.split())


def _union(selects) -> str:
    return "\nUNION ALL\n".join(selects)


def _manifest(table: str) -> str:
    """The largest power-of-two range around each key that has at most CHUNK_ROWS rows."""
    key = KEYS[table][0]
    return f"""
        SELECT '{table}' AS table_name,
               CAST(row_number() OVER (ORDER BY low_key NULLS LAST) - 1 AS INTEGER) AS chunk_id,
               low_key, high_key, row_count
        FROM (WITH k AS (SELECT {key} AS k, count(*) AS n FROM b_{table}
                         WHERE {key} IS NOT NULL GROUP BY 1),
                   r AS (SELECT l, CAST(floor(k / pow(2, l)) AS BIGINT) AS b, k, n
                         FROM k, (SELECT unnest(range(0, 63)) AS l)),
                   c AS (SELECT l, b, sum(n) AS n FROM r GROUP BY l, b),
                   best AS (SELECT r.k, r.n,
                                   coalesce(max(r.l) FILTER (c.n <= {CHUNK_ROWS}), 0) AS l
                            FROM r JOIN c USING (l, b) GROUP BY r.k, r.n)
              SELECT CAST(floor(k / pow(2, l)) * pow(2, l) AS BIGINT) AS low_key,
                     CAST((floor(k / pow(2, l)) + 1) * pow(2, l) AS BIGINT) AS high_key,
                     CAST(sum(n) AS BIGINT) AS row_count
              FROM best GROUP BY 1, 2
              UNION ALL
              SELECT NULL, NULL, count(*) FROM b_{table} WHERE {key} IS NULL
              HAVING count(*) > 0) m"""


def _sources() -> dict[str, str]:
    counts = _union(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM b_{t}" for t in TABLES)
    manifest = _union(_manifest(t) for t in TABLES)
    cover = f"""SELECT table_name, count(*) AS chunk_count, max(row_count) AS largest,
                       CAST(sum(row_count) AS BIGINT) AS row_count,
                       any_value(c.n) - CAST(sum(row_count) AS BIGINT) AS missing,
                       count(*) FILTER (next_low < high_key) AS overlaps
                FROM (SELECT *, lead(low_key) OVER (PARTITION BY table_name ORDER BY chunk_id) AS next_low
                      FROM ({manifest}) m) m
                JOIN (SELECT table_name, row_count AS n FROM ({counts}) c) c USING (table_name)
                GROUP BY table_name"""
    info = _union(
        f"""SELECT '{t}' AS table_name, (SELECT count(*) FROM b_{t}) AS row_count,
            position, column_name, column_type
            FROM (VALUES {", ".join(_column_rows(t))}) c(position, column_name, column_type)"""
        for t in TABLES
    )
    return {
        "src_bronze_scan": counts,
        "src_chunk_manifest": manifest,
        "src_chunk_cover": cover,
        "src_ingest_report": f"SELECT *, 'loaded' AS status FROM ({counts}) c",
        "src_table_info": info,
        "bronze_concat_chunks": _layer("b_lineitem"),
    }


def _columns(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ", 1)) for c in re.split(r", (?=[a-z])", COLUMNS[table])]


def _column_rows(table: str) -> list[str]:
    return [f"({i}, '{c}', '{kind}')" for i, (c, kind) in enumerate(_columns(table), start=1)]


# Decimal columns of each layer.
MONEY = {
    "supplier": "s_acctbal",
    "customer": "c_acctbal",
    "part": "p_retailprice",
    "partsupp": "ps_availqty ps_supplycost",
    "orders": "o_totalprice",
    "lineitem": "l_quantity l_extendedprice l_discount l_tax",
}
SILVER_MONEY = MONEY | {
    "lineitem": MONEY["lineitem"] + " l_discount_percentage l_net_price",
}


def _layer(relation: str, where: str = "") -> str:
    layer, table = relation.split("_", 1)
    money = (MONEY if layer == "b" else SILVER_MONEY).get(table)
    replaced = f" REPLACE ({_doubles(money)})" if money else ""
    return f"SELECT *{replaced} FROM {relation} {where}".strip()


def _layers() -> dict[str, str]:
    finals = {}
    for t in TABLES:
        finals[f"bronze_conform_{t}"] = _layer(f"b_{t}")
        finals[f"silver_{t}"] = _layer(f"s_{t}")
    finals["silver_strict_lineitem"] = _layer("s_lineitem", "WHERE s_lineitem.l_quantity > 0")
    finals["silver_strict_part"] = _layer("s_part", "WHERE s_part.p_retailprice > 0")
    finals["silver_strict_partsupp"] = _layer(
        "s_partsupp", "WHERE s_partsupp.ps_availqty >= 0 AND s_partsupp.ps_supplycost > 0"
    )
    strict = {
        "part": "p_retailprice > 0",
        "partsupp": "ps_availqty >= 0 AND ps_supplycost > 0",
        "orders": "o_totalprice > 0",
        "lineitem": "l_quantity > 0",
    }
    finals["silver_row_delta"] = _union(
        f"""SELECT '{t}' AS table_name, (SELECT count(*) FROM b_{t}) AS bronze_rows,
            (SELECT count(*) FROM s_{t}) AS standard_rows,
            (SELECT count(*) FROM s_{t} WHERE {strict.get(t, "TRUE")}) AS strict_rows"""
        for t in TABLES
    )
    finals["stg_customer"] = f"""
        SELECT c_custkey AS customer_key, c_name AS customer_name, c_address AS customer_address,
               c_nationkey AS nation_key, c_phone AS customer_phone,
               {_double("c_acctbal")} AS account_balance, c_mktsegment AS market_segment,
               c_comment AS customer_comment, c_acctbal_status AS account_balance_status
        FROM s_customer"""
    finals["stg_lineitem"] = f"""
        SELECT l_orderkey AS order_key, l_partkey AS part_key, l_suppkey AS supplier_key,
               l_linenumber AS line_number, {_double("l_quantity")} AS quantity,
               {_double("l_extendedprice")} AS extended_price, {_double("l_discount")} AS discount,
               {_double("l_tax")} AS tax, l_returnflag AS return_flag,
               l_linestatus AS line_status, l_shipdate AS ship_date, l_commitdate AS commit_date,
               l_receiptdate AS receipt_date, l_shipinstruct AS ship_instruct,
               l_shipmode AS ship_mode, l_comment AS lineitem_comment,
               {_double("l_discount_percentage")} AS discount_percentage
        FROM s_lineitem"""
    finals["stg_nation"] = """
        SELECT n_nationkey AS nation_key, n_name AS nation_name, n_regionkey AS region_key,
               n_comment AS nation_comment
        FROM s_nation"""
    finals["stg_orders"] = f"""
        SELECT o_orderkey AS order_key, o_custkey AS customer_key, o_orderstatus AS order_status,
               {_double("o_totalprice")} AS total_price, o_orderdate AS order_date,
               o_orderpriority AS order_priority, o_clerk AS clerk,
               o_shippriority AS ship_priority, o_comment AS order_comment,
               o_year AS order_year, o_quarter AS order_quarter
        FROM s_orders"""
    finals["stg_part"] = f"""
        SELECT p_partkey AS part_key, p_name AS part_name, p_mfgr AS manufacturer,
               p_brand AS brand, p_type AS part_type, p_size AS part_size,
               p_container AS container, {_double("p_retailprice")} AS retail_price,
               p_comment AS part_comment
        FROM s_part"""
    finals["stg_partsupp"] = f"""
        SELECT ps_partkey AS part_key, ps_suppkey AS supplier_key,
               {_double("ps_availqty")} AS available_qty,
               {_double("ps_supplycost")} AS supply_cost, ps_comment AS partsupp_comment
        FROM s_partsupp"""
    finals["stg_region"] = """
        SELECT r_regionkey AS region_key, r_name AS region_name, r_comment AS region_comment
        FROM s_region"""
    finals["stg_supplier"] = f"""
        SELECT s_suppkey AS supplier_key, s_name AS supplier_name, s_address AS supplier_address,
               s_nationkey AS nation_key, s_phone AS supplier_phone,
               {_double("s_acctbal")} AS account_balance, s_comment AS supplier_comment
        FROM s_supplier"""
    return finals


def _marts() -> dict[str, str]:
    sales_money = (
        "quantity extended_price discount tax net_price total_price discount_amount "
        "order_total_price"
    )
    revenue_money = (
        "total_quantity revenue gross_revenue total_revenue total_discount "
        "max_line_value min_line_value"
    )
    return {
        "dim_customer": f"SELECT * REPLACE ({_doubles('account_balance')}) FROM g_dim_customer",
        "dim_supplier": f"SELECT * REPLACE ({_doubles('account_balance')}) FROM g_dim_supplier",
        "dim_part": f"SELECT * REPLACE ({_doubles('retail_price')}) FROM g_dim_part",
        "dim_date": "SELECT * FROM g_dim_date",
        "fct_sales": f"SELECT * REPLACE ({_doubles(sales_money)}) FROM g_fct_sales",
        "fct_revenue_by_supplier": f"""
            SELECT supplier_key, date_key, total_orders, total_line_items,
                   {_doubles(revenue_money)}, performance_tier,
                   {_ratio(_unscaled("gross_revenue"), "priced", 10**4)} AS avg_line_value,
                   {_ratio(_unscaled("revenue"), "total_orders", 10**2)} AS revenue_per_order,
                   {_ratio(_unscaled("revenue"), "total_line_items", 10**2)} AS revenue_per_line,
                   {_ratio(_unscaled("total_discount"), _unscaled("gross_revenue"), 10**4)}
                       AS discount_rate
            FROM g_revenue""",
        "fct_inventory": "SELECT * REPLACE ("
        + _doubles("available_qty supply_cost total_inventory_value retail_price")
        + ") FROM g_inventory",
    }


def _profiles() -> dict[str, str]:
    def each_column(select) -> str:
        return _union(select(t, c, kind) for t in TABLES for c, kind in _columns(t))

    def stats(t: str, c: str, kind: str) -> str:
        number = f"TRY_CAST({c} AS DOUBLE)"
        total = _double(f"sum({c})") if kind != "string" else f"sum({number})"
        present = c if kind != "string" else number
        return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS value_count,
            {total} / NULLIF(count({present}), 0) AS mean,
            CAST(format('{{:.8e}}', stddev_samp({number})) AS DOUBLE) AS stddev,
            CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value
            FROM b_{t}"""

    def sample(t: str) -> str:
        columns = [c for c, _ in _columns(t)]
        order = [*KEYS[t], *(c for c in columns if c not in KEYS[t])]
        key = " || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in KEYS[t])
        ordering = ", ".join(f"{c} ASC NULLS FIRST" for c in order)
        chosen = f"(SELECT * FROM b_{t} ORDER BY {ordering} LIMIT 5) s"
        return _union(
            f"""SELECT '{t}' AS table_name, {key} AS row_key, '{c}' AS column_name,
                CAST({c} AS VARCHAR) AS value FROM {chosen}"""
            for c in columns
        )

    def strata(t: str, stratum: str, n: int) -> str:
        columns = [c for c, _ in _columns(t)]
        key = " || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in KEYS[t])
        order = [*KEYS[t], *(c for c in columns if c not in KEYS[t])]
        ordering = ", ".join(f"{c} ASC NULLS FIRST" for c in order)
        chosen = f"""(SELECT *, row_number() OVER (PARTITION BY {stratum}
                                                   ORDER BY md5({key}), {ordering}) AS place
                      FROM b_{t}) s WHERE place <= {n}"""
        return _union(
            f"""SELECT '{t}' AS table_name, CAST({stratum} AS VARCHAR) AS stratum,
                {key} AS row_key, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {chosen}"""
            for c in columns
        )

    return {
        "profile_strata_sample": _union(strata(t, s, STRATUM_ROWS) for t, s in STRATA.items()),
        "profile_row_counts": _union(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM s_{t}" for t in TABLES
        ),
        "profile_cardinality": each_column(
            lambda t, c, kind: f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
                count(*) AS distinct_values FROM (SELECT DISTINCT {c} FROM b_{t}) d"""
        ),
        "profile_distinct_sketch": each_column(
            lambda t, c, kind: f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
                count(*) AS distinct_values, TRUE AS near FROM (SELECT DISTINCT {c} FROM b_{t}) d"""
        ),
        "profile_quantile_sketch": _union(
            f"""SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(p AS DOUBLE) AS probability,
                count({c}) AS value_count, TRUE AS near
                FROM b_{t}, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS p) q
                GROUP BY p HAVING count({c}) > 0"""
            for t in TABLES
            for c, kind in _columns(t)
            if kind != "string"
        ),
        "profile_numeric_stats": _union(
            stats(t, c, kind) for t in TABLES for c, kind in _columns(t) if kind != "date"
        ),
        "profile_null_counts": each_column(
            lambda t, c, kind: f"""SELECT '{t}' AS table_name, count(*) AS row_count,
                '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count
                FROM b_{t}"""
        ),
        "profile_sample": _union(sample(t) for t in TABLES),
    }


def _row_check(table: str, relation: str, rule: str, holds: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) AS checked,
        count(*) - count(*) FILTER (WHERE {holds}) AS failed FROM {relation}"""


def _quality() -> dict[str, str]:
    not_null = _union(
        _row_check(t, f"b_{t}", f"not_null:{c}", f"{c} IS NOT NULL")
        for t, key in KEYS.items()
        for c in key
    )
    ranges = _union(
        _row_check(t, f"b_{t}", f"range:{c} {bound}", f"{c} {bound}") for t, c, bound in RANGES
    )
    accepted = _union(
        _row_check(t, relation, f"accepted_values:{c}", f"{c} IN ({values})")
        for t, relation, c, values in ACCEPTED
    )
    keys = {t: (f"s_{t}", *key) for t, key in KEYS.items()} | FACT_KEYS
    unique = _union(
        f"""SELECT '{t}' AS table_name, 'unique:{",".join(key)}' AS rule,
            CAST(coalesce(sum(n), 0) AS BIGINT) AS checked,
            CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS failed
            FROM (SELECT count(*) AS n FROM {relation}
                  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in key)}
                  GROUP BY {", ".join(key)}) k"""
        for t, (relation, *key) in keys.items()
    )
    relationships = _union(
        f"""SELECT '{child}' AS table_name, 'relationship:{c}->{parent}.{pc}' AS rule,
            count(*) AS checked,
            count(*) FILTER (WHERE NOT EXISTS
                (SELECT 1 FROM {parent_relation} p WHERE p.{pc} = c.{c})) AS failed
            FROM {child_relation} c WHERE c.{c} IS NOT NULL"""
        for child, child_relation, c, parent, parent_relation, pc in REFERENCES
    )
    gold = {
        "customer": "g_dim_customer",
        "supplier": "g_dim_supplier",
        "part": "g_dim_part",
        "lineitem": "g_fct_sales",
        "partsupp": "g_inventory",
    }

    def gold_rows(t: str) -> str:
        return f"(SELECT count(*) FROM {gold[t]})" if t in gold else "CAST(NULL AS BIGINT)"

    return {
        "dq_not_null": not_null,
        "dq_ranges": ranges,
        "dq_accepted_values": accepted,
        "dq_unique": unique,
        "dq_relationships": relationships,
        "dq_reconcile": _union(
            f"""SELECT '{t}' AS table_name, (SELECT count(*) FROM b_{t}) AS bronze_rows,
                (SELECT count(*) FROM s_{t}) AS silver_rows, {gold_rows(t)} AS gold_rows"""
            for t in TABLES
        ),
        "dq_score": f"""
            SELECT count(*) AS rules, CAST(sum(checked) AS BIGINT) AS checked,
                   CAST(sum(failed) AS BIGINT) AS failed,
                   1 - CAST(sum(failed) AS DOUBLE) / NULLIF(CAST(sum(checked) AS DOUBLE), 0)
                       AS score
            FROM ({_union([not_null, ranges, accepted, unique, relationships])}) r""",
    }


def _dashboards() -> dict[str, str]:
    return {
        "dash_executive": f"""
            SELECT total_orders, total_customers, total_line_items,
                   {_doubles("net_revenue gross_revenue total_discount")},
                   {_ratio(_unscaled("net_revenue"), "total_orders", 10**2)} AS avg_order_value,
                   {_ratio(_unscaled("total_discount"), _unscaled("gross_revenue"), 10**4)}
                       AS discount_rate
            FROM (SELECT count(DISTINCT order_key) AS total_orders,
                         count(DISTINCT customer_key) AS total_customers,
                         count(*) AS total_line_items, sum(net_price) AS net_revenue,
                         sum(extended_price) AS gross_revenue,
                         sum(discount_amount) AS total_discount
                  FROM g_fct_sales) t""",
        "dash_revenue_by_product": f"""
            SELECT brand, type, count(*) AS total_line_items,
                   {_double("sum(quantity)")} AS total_quantity,
                   {_double("sum(net_price)")} AS net_revenue
            FROM g_fct_sales f LEFT JOIN g_dim_part p ON f.part_key = p.part_key
            GROUP BY brand, type""",
        "dash_top_customers": f"""
            SELECT t.customer_key, {_double("net_revenue")} AS net_revenue, total_line_items,
                   customer_name, market_segment, nation_name, region_name
            FROM (SELECT customer_key, sum(net_price) AS net_revenue,
                         count(*) AS total_line_items
                  FROM g_fct_sales GROUP BY customer_key
                  ORDER BY net_revenue DESC, customer_key LIMIT 20) t
            LEFT JOIN g_dim_customer c ON t.customer_key = c.customer_key""",
        "dash_revenue_trend": f"""
            SELECT year, month, count(*) AS total_line_items,
                   {_double("sum(net_price)")} AS net_revenue
            FROM g_fct_sales LEFT JOIN g_dim_date ON order_date = date_key
            GROUP BY year, month""",
        "dash_inventory": f"""
            SELECT stock_level, cost_category, count(*) AS items,
                   {_double("sum(available_qty)")} AS total_quantity,
                   {_double("sum(total_inventory_value)")} AS total_inventory_value
            FROM g_inventory GROUP BY stock_level, cost_category""",
        "dash_supplier_performance": f"""
            SELECT performance_tier, region_name, count(*) AS supplier_days,
                   CAST(sum(total_orders) AS BIGINT) AS total_orders,
                   {_double("sum(revenue)")} AS net_revenue
            FROM g_revenue r LEFT JOIN g_dim_supplier s ON r.supplier_key = s.supplier_key
            GROUP BY performance_tier, region_name""",
        "dash_delivery_times": """
            SELECT ship_mode, count(*) AS total_line_items,
                   CAST(sum(date_diff('day', ship_date, receipt_date)) AS DOUBLE)
                     / NULLIF(count(date_diff('day', ship_date, receipt_date)), 0)
                     AS avg_delivery_days,
                   CAST(count(*) FILTER (WHERE receipt_date > commit_date) AS DOUBLE)
                     / NULLIF(count(receipt_date > commit_date), 0) AS late_share
            FROM g_fct_sales GROUP BY ship_mode""",
        "dash_ship_lag": """
            SELECT order_priority, count(*) AS total_line_items,
                   CAST(sum(date_diff('day', order_date, ship_date)) AS DOUBLE)
                     / NULLIF(count(date_diff('day', order_date, ship_date)), 0) AS avg_ship_days,
                   CAST(min(date_diff('day', order_date, ship_date)) AS INTEGER) AS min_ship_days,
                   CAST(max(date_diff('day', order_date, ship_date)) AS INTEGER) AS max_ship_days
            FROM g_fct_sales GROUP BY order_priority""",
    }
