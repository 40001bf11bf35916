"""Rules are evaluated once a claim."""

import __spark_entry__ as entry
from claimscope.operators import rules as R
from claimscope.sources.tables import claims


def test_no_filter_evaluates_the_rules_again(spark, sf_dir):
    plan = entry.queries()["scored_rule_results"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Excessive claim amount") == 1
    assert not any("Filter" in line and "rule_name" in line for line in plan.splitlines())


def test_scores_alone_need_no_evidence(spark, sf_dir):
    scores = R.rule_scores(claims(spark, sf_dir, *R.RULE_COLUMNS)).select("claim_id", "rule_score")
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "Excessive claim amount" not in plan and "Doctor shopping" not in plan
