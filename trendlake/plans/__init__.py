"""Plan-shaping helpers shared by the operators.

* ``ordering`` – total orders, top-k per group (window + WindowGroupLimit) and
  arg-min per group as a partially aggregated struct minimum.
* ``inspect``  – physical-plan text for plan tests.
"""

from trendlake.plans.inspect import physical_plan, plan_nodes
from trendlake.plans.ordering import ArgMin, Order, asc, desc, first_per_group, top_k_per_group

__all__ = [
    "ArgMin",
    "Order",
    "asc",
    "desc",
    "first_per_group",
    "top_k_per_group",
    "physical_plan",
    "plan_nodes",
]
