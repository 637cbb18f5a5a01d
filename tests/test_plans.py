"""What the plans of queries must and must not have."""

import re

import pytest

from parallax.operators import model
from parallax.plans.queries import STATS, crossings
from parallax.plans.source_queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
#: Queries that put a result of one row beside all rows.
ONE_ROW = {"screen_counts", "historical_profile", "predict", "holdout_scorecard", "bootstrap_refits", "wls_fit", "screen_missed", "link_checks", "fit_summary", "prediction_intervals", "projection", "resampled_counts", "resampled_refits", "deficient_fit", "holdout_intervals", "season_roster"}
#: Queries that parse pages, make keys of names, solve fits or draw players.
PYTHON = {"wls_fit", "predict", "fit_summary", "holdout_scorecard", "bootstrap_refits", "prediction_intervals", "projection", "resampled_counts", "resampled_refits", "deficient_fit", "holdout_intervals", "cached_pages", "team_pages", "typed_players", "page_player_ids", "crawl_players", "crawl_roster", "crawl_totals", "player_pages", "page_failures", "page_totals"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["scan_project_filter"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(l_quantity", text) and "l_shipdate" in text.split("PushedFilters")[1]
    read = re.search(r"FileScan parquet \[([^\]]*)\]", text)[1]
    assert {c.split("#")[0] for c in read.split(",")} == {"l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"}


@pytest.mark.parametrize("name", [*QUERIES])
def test_no_product_of_tables(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text or name in ONE_ROW


@pytest.mark.parametrize("name", ["relative_rates", "league_rates", "weighted_score"])
def test_one_scan_with_partial_aggregation(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert text.count("lineitem.parquet") <= 2 and "partial_sum" in text


def test_fits_sum_with_partial_aggregation(spark):
    text = plan(model.fit_sums(model.design(crossings(lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")), STATS)))
    assert text.count("orders.parquet") <= 2 and "partial_sum" in text and "Python" not in text


def test_only_names_and_pages_run_python(spark):
    found = {name for name, query in QUERIES.items() if any(node in plan(query(spark, FOLDER)) for node in ("Python", "MapInPandas", "MapInArrow", "page_cache"))}
    assert found == PYTHON


def test_audit_makes_one_pass_over_each_table(spark):
    text = plan(QUERIES["audit_summary"](spark, FOLDER))
    assert {t: len(re.findall(rf"FileScan parquet [^\n]*{t}.parquet", text)) for t in ("lineitem", "customer", "documents", "labels")} == dict.fromkeys(("lineitem", "customer", "documents", "labels"), 1)
