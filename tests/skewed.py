"""Writes a copy of the test tables in which one key holds a third of the rows.

Usage: python -m tests.skewed source_folder target_folder
Then:  python -m tests.oracle --dir target_folder
"""

from __future__ import annotations

import os
import sys

import duckdb

from tallyworks.sources.schemas import STAR_TABLES

# One customer, order, part, supplier, user and event type take a third of their tables.
HOT = {
    "orders": "* REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey, "
              "CASE WHEN o_orderkey % 6 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority)",
    "lineitem": "* REPLACE (CASE WHEN l_partkey % 3 = 0 THEN 5 ELSE l_orderkey END AS l_orderkey, "
                "CASE WHEN l_linenumber % 3 = 0 THEN 11 ELSE l_suppkey END AS l_suppkey, "
                "CASE WHEN l_linenumber % 3 = 1 THEN 13 ELSE l_partkey END AS l_partkey)",
    "events": "* REPLACE (CASE WHEN event_id % 3 = 0 THEN 3 ELSE user_id END AS user_id, "
              "CASE WHEN event_id % 3 = 1 THEN 'click' ELSE event_type END AS event_type)",
}


def write(source: str, target: str) -> None:
    os.makedirs(target, exist_ok=True)
    con = duckdb.connect()
    for name in STAR_TABLES:
        columns = HOT.get(name, "*")
        con.execute(f"COPY (SELECT {columns} FROM read_parquet('{source}/{name}.parquet')) TO '{target}/{name}.parquet' (FORMAT parquet)")


if __name__ == "__main__":
    write(sys.argv[1], sys.argv[2])
