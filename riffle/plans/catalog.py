"""All registered queries."""

from riffle.plans import chain, domain, fitted, relational, spatial  # noqa: F401
from riffle.plans.registry import ORACLES, QUERIES  # noqa: F401
