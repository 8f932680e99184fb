"""All registered queries."""

from timbrel.plans import evaluation, models, patients, rules, series, sources, streams, vectors  # noqa: F401
from timbrel.plans.registry import QUERIES, SQL  # noqa: F401
