"""Filters on errors must stay above the steps that make them: pushed below, each step is written out at each of its uses."""

import pytest

from calltide.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["e18_validation_stats", "e23_extract_contacts"])
def test_no_filter_repeats_the_steps(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert all(len(line) < 500 for line in plan.splitlines() if "Filter" in line)
