"""Plan of the product comparison."""

import re

from floeframe.plans import forecast


def test_products_are_dealt_out_before_they_are_reduced(spark):
    plan = forecast.product_agreement(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in re.findall(r"Exchange (\w+)\(([^)]*)", plan) if x[0] == "hashpartitioning"]
    assert len(dealt) == 1 and dealt[0][1].startswith("day")
    after = plan[plan.index("Exchange hashpartitioning"):]
    assert "HashAggregate" not in after
