"""The operators that order or collect within a key, on tables where one key holds a third of the rows."""

import pytest

from tallyworks.catalog import registered

from .oracle import compare, connect
from .skewed import write

QUERIES, SQL = registered()
NAMES = ("R1_review_latest", "R2_order_items_agg", "R6_customer_orders", "R7_first_orders", "R10_cohort", "R14_repeat_by_first",
         "R17_rfm_customers", "D_register", "D10_dev_kpis", "D15_repeat_pairs", "P9_rule_subset", "P13_signal_log",
         "L7_result_fact", "L15_lots_enriched", "L23_dictionary_encode", "E8_consecutive_runs", "Q3_repeat_excursions",
         "W2_sequence", "W4_global_ntile", "W5_percent_rank")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("skew"))
    write("/root/testdata/sf0.001", path)
    return path


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys(spark, folder, name):
    problem, _ = compare(QUERIES[name](spark, folder), connect(folder), SQL[name])
    assert problem is None, problem
