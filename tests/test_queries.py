"""A spread of registered queries against their SQL twins on the smallest data."""

import pytest

from compare import check
from conftest import SF
from pitlens.plans import QUERIES
from pitlens.plans.registry import runner

CHECKED = [
    "restatements_resolved", "year_apart_instants", "aligned_periods", "price_on_or_before", "total_return_between_dates",
    "evidence_baseline", "restated_findings", "incidence_excess", "mean_t_tests", "binomial_two_sided", "mean_abs_gap",
    "prior_filing", "peers_by_size", "placebo_rotation", "one_call_per_entity_day", "max_drawdown", "insider_clusters",
    "finding_clusters", "earnings_outlook", "split_paragraphs", "text_search", "quotes_in_source", "score_events",
    "exposure_nodes", "decomposed_effects", "parsed_decisions", "flattened_companyfacts", "insider_transactions",
]


@pytest.mark.parametrize("name", CHECKED)
def test_matches_twin(spark, con, name):
    q = QUERIES[name]
    assert check(con, runner(q)(spark, SF), q.sql) is None


def test_every_query_names_what_it_covers():
    assert all(q.covers for q in QUERIES.values())
    assert len(QUERIES) >= 200


def test_entry_runs(spark):
    import __spark_entry__ as entry
    assert "percentile" in entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
