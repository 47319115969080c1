"""All registered queries."""

from packwright.plans import combining, evaluating, files, ordering, packing, scoring, tokens  # noqa: F401
from packwright.plans.registry import ORACLES, QUERIES  # noqa: F401
