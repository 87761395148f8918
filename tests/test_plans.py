"""What the physical plans must and must not contain, and the registered names."""

import __spark_entry__ as entry
from tonearm.plans import recommend as R
from tonearm.plans.queries import QUERIES
from tonearm.sources import testbed as tb


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products(spark, sf):
    ratings, tracks = tb.ratings(spark, sf), tb.tracks(spark, sf)
    for df in (R.content_based(ratings, tracks), R.collaborative(ratings, tracks),
               QUERIES["catalogue_search"](spark, sf), QUERIES["proxy_features"](spark, sf)):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_ranks_are_limited_before_the_shuffle(spark, sf):
    text = plan(R.collaborative(tb.ratings(spark, sf), tb.tracks(spark, sf)))
    assert "WindowGroupLimit" in text


def test_scans_read_few_columns(spark, sf):
    text = plan(QUERIES["click_through"](spark, sf))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
