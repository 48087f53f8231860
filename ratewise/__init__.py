"""ratewise: dynamic rental-pricing analytics as Spark DataFrame plans.

Every capability is a function ``DataFrame(s) -> DataFrame`` built from
Spark SQL expressions, joins, aggregations and window frames.  Clock,
cutoffs and scope are parameters; nothing reads the wall clock.
"""

from ratewise.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
