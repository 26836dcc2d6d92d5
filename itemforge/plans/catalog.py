"""All registered queries."""

from itemforge.plans import documents, evals, flows, records, scalars, schemas, scores  # noqa: F401
from itemforge.plans.registry import CATALOG

__all__ = ["CATALOG"]
