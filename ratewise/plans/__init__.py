"""Registered queries (one per operator of the inventory) and their
SQL oracles.  Importing this package registers every query."""

# Order matters: later modules reuse SQL views registered by earlier ones.
from ratewise.plans import demand_plans  # noqa: F401
from ratewise.plans import feature_plans  # noqa: F401
from ratewise.plans import rate_plans  # noqa: F401
from ratewise.plans import calendar_plans  # noqa: F401
from ratewise.plans import forecast_plans  # noqa: F401
from ratewise.plans import competitor_plans  # noqa: F401
from ratewise.plans import recommend_plans  # noqa: F401
from ratewise.plans import workflow_plans  # noqa: F401
from ratewise.plans import profile_plans  # noqa: F401
from ratewise.plans import misc_plans  # noqa: F401
from ratewise.plans import tenant_plans  # noqa: F401
from ratewise.plans import stream_plans  # noqa: F401
from ratewise.plans.registry import ORACLE, QUERIES  # noqa: F401
