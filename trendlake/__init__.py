"""trendlake: trending-snapshot analytics as lazy Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame without
triggering an action.  Sub-packages:

* ``sources``   – snapshot / result readers and the Parquet / CSV sinks
* ``functions`` – Column -> Column helpers (built-in Spark expressions only)
* ``operators`` – cleaning, rankings, trends, lookups, exploration, display,
                  dimension joins and table-constraint checks
* ``plans``     – ordering keys and plan inspection helpers
* ``llm``       – training-data operators (optional; nothing else imports it)
"""

from trendlake.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
