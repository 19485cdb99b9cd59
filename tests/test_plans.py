"""The physical plans that keep the work spread out."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyloom.operators import offers as M
from tallyloom.operators import ranking as R
from tallyloom.plans import domain as D

QUERIES = entry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["assign_sequence", "match_offers", "candidate_titles", "refine_clean_products", "sliding_error_count", "sliding_error_count_global"])
def test_no_single_partition_and_no_cross_product(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "SinglePartition" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["rank_offers", "match_offers", "best_detection", "latest_per_container"])
def test_groups_are_limited_before_the_exchange(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(QUERIES["log_lookback"](spark, small))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in text
    assert "value" not in text.split("ReadSchema")[1]
    offers = plan(D.offers(spark, small))
    assert "l_shipdate" not in offers


def test_newest_takes_the_top_without_a_global_sort(spark, small):
    assert "TakeOrderedAndProject" in plan(R.newest(D.logs(spark, small), "timestamp", 10, "event_id"))


def test_similarity_stays_in_the_jvm(spark, small):
    text = plan(M.acceptable_offers(D.products(spark, small), D.staged_offers(spark, small)))
    assert "Python" not in text and "levenshtein" in text


def test_refined_parts_come_from_one_join(spark, small):
    text = plan(QUERIES["refine_prices"](spark, small))
    assert len(re.findall(r"(?:SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin) ", text)) == 1
    assert text.count("lineitem.parquet") == 1


def test_a_read_is_not_dealt_out(spark, small):
    assert "RoundRobinPartitioning" not in plan(D.offers(spark, small))


def test_a_search_is_planned_once(spark, small):
    """Hits are stored where they are read more than once, so what is left to run searches for text queries only."""
    text = plan(QUERIES["search"](spark, small))
    assert text.count("FlatMapCoGroupsInPandas") == 1
    shown = plan(QUERIES["search_and_hydrate"](spark, small))
    assert shown.count("FlatMapCoGroupsInPandas") == 0 and shown.count("FileScan") <= 8


def test_a_pair_of_name_and_title_is_met_once(spark, small):
    """The join itself takes a pair at its rarest shared word, and nothing is gathered after it."""
    text = plan(M.candidate_titles(D.products(spark, small), D.staged_offers(spark, small)))
    top = text.split("Join", 1)
    assert "Aggregate" not in top[0] and "array_intersect" in top[1].split("\n", 1)[0]


def test_titles_are_told_apart_before_they_are_split(spark, small):
    """What is gathered are titles, once each; their words are only passed on."""
    text = plan(M.candidate_codes(D.products(spark, small), D.staged_offers(spark, small)))
    assert "Generate" in text and "Aggregate" not in text.split("Generate", 1)[0]


def test_titles_are_split_once(spark, small):
    """Titles are stored with their words: what counts words and what pairs them reads no offers again."""
    assert "lineitem" not in plan(M.candidate_titles(D.products(spark, small), D.staged_offers(spark, small)))


def test_numbers_meet_a_stored_side(spark, small):
    """What each range adds is small and known to be, so the numbered rows are not shuffled again."""
    text = plan(QUERIES["load_catalog"](spark, small))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
