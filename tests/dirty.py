"""The given tables made dirty: NULLs, blanks, orphans, duplicates, bad values, hot keys; or empty."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from checks.compare import RAW_TABLES

BLANKS = ("  {} ", "\t{}\n", "　{}", " {}\x0b", "{}")


def write(source, target, seed=1):
    rng = np.random.default_rng(seed)
    for table in RAW_TABLES:
        original = pq.read_table(f"{source}/{table}.parquet")
        spoiled = _spoil(original.to_pandas(), table, rng)
        pq.write_table(
            pa.Table.from_pandas(spoiled, schema=original.schema, preserve_index=False),
            f"{target}/{table}.parquet",
        )


def write_empty(source, target):
    for table in RAW_TABLES:
        schema = pq.read_schema(f"{source}/{table}.parquet")
        pq.write_table(schema.empty_table(), f"{target}/{table}.parquet")


def _spoil(df, table, rng):
    df = df.astype({c: object for c in df.columns})

    def some(share):
        return rng.random(len(df)) < share

    for c in df.columns:
        if isinstance(df[c].iloc[0], str):
            df[c] = [BLANKS[i].format(v) for v, i in zip(df[c], rng.integers(0, 5, len(df)))]
            df.loc[some(0.05), c] = ""
        if c not in ("r_regionkey", "n_nationkey"):
            df.loc[some(0.05), c] = None
    if table in ("customer", "supplier"):
        p = table[0]
        df.loc[1, f"{p}_nationkey"] = 99
        df.loc[2, f"{p}_acctbal"] = -0.01
        df.loc[3, f"{p}_acctbal"] = 0.0
    if table == "nation":
        df.loc[3, "n_regionkey"] = 77
    if table == "part":
        df.loc[5, "p_retailprice"] = 0.0
        df.loc[6, "p_retailprice"] = -5.0
    if table == "orders":
        df.loc[7, "o_totalprice"] = 0.0
        df.loc[8, "o_totalprice"] = -3.0
        df.loc[9, "o_custkey"] = 10**9
        df = pd.concat([df, df.iloc[20:40]])
    if table == "lineitem":
        df.loc[some(0.33), "l_orderkey"] = 21
        df.loc[some(0.33), "l_partkey"] = 3
        df.loc[some(0.20), "l_extendedprice"] = 0.0
        df.loc[some(0.05), "l_extendedprice"] = -123.45
        df.loc[some(0.02), "l_orderkey"] = 10**10
        df.loc[some(0.01), "l_orderkey"] = -5
        df.loc[3, "l_quantity"] = 0.0
        df.loc[4, "l_quantity"] = -2.0
    return df
