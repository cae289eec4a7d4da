"""Named queries over the driver's tables, each with the same in SQL where SQL can express it."""

from spectraloom.plans import attention, evidence, flags, inference, live, observation, planted, receivers, recorded, reports, service, signals, surveys, tiles  # noqa: F401
from spectraloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
