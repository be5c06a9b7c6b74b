import os

import pytest

from factloom.plans import registry

from .duck import DATA, compare, connect

Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, con, name):
    df = Q[name](spark, DATA)
    if name in SQL:
        compare(df, con, SQL[name])
    else:
        assert df.count() > 0


def test_queries_without_sql_have_a_test_of_their_own():
    """tests/test_policies.py, tests/test_functions.py, tests/test_iterations.py, tests/test_brute.py, tests/test_adaptation.py and tests/test_mixed.py."""
    assert set(Q) - set(SQL) == {
        "c7_gate", "fit_policy", "mean_ci", "paired_t", "bootstrap_ci", "hash_embed", "mention_distance", "scenario_replay", "bounded_update", "aggregate_methods", "significance_table",
        "policy_fit_across_seeds", "align_values", "injected_cascade", "cluster_bootstrap", "mixed_logit", "mixed_gaussian", "cumulative_logit", "participant_accuracy", "policy_versions", "policy_registry",
    }
