"""Modularity equals its SQL where few or no edges stay inside a community."""

import os

import duckdb
import pandas as pd
import pytest

from auditlake.plans.queries import ORACLES, QUERIES

#: Customer and supplier nation of each line item, and the nations with their regions.
CASES = {
    "no edge": ([(n, n) for n in range(25)], {n: n % 5 for n in range(25)}),
    "none inside": ([(0, 1)] * 9 + [(2, 3)] * 9, {0: 0, 1: 1, 2: 0, 3: 1}),
    "unnamed nations": ([(0, 1)] * 9 + [(1, 2)] * 9 + [(0, 7)] * 9 + [(7, 8)] * 9 + [(3, 0)] * 9, {0: 0, 1: 0, 2: 1, 3: 1}),
}


def tables(items, regions):
    nations = sorted({n for pair in items for n in pair})
    return {
        "nation": pd.DataFrame({"n_nationkey": list(regions), "n_regionkey": list(regions.values())}),
        "customer": pd.DataFrame({"c_custkey": nations, "c_nationkey": nations}),
        "supplier": pd.DataFrame({"s_suppkey": nations, "s_nationkey": nations}),
        "orders": pd.DataFrame({"o_orderkey": range(len(items)), "o_custkey": [c for c, _ in items]}),
        "lineitem": pd.DataFrame({"l_orderkey": range(len(items)), "l_suppkey": [s for _, s in items]}),
    }


@pytest.mark.parametrize("case", CASES)
def test_modularity_equals_sql(spark, tmp_path, case):
    con = duckdb.connect()
    for name, frame in tables(*CASES[case]).items():
        frame.to_parquet(os.path.join(tmp_path, f"{name}.parquet"))
        con.register(name, frame)
    got = [tuple(r) for r in QUERIES["modularity"](spark, str(tmp_path)).select("q_adjacent", "q").collect()]
    assert got == con.execute(ORACLES["modularity"]).fetchall()
