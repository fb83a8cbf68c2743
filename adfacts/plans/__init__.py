"""The registered queries and, next to each, the SQL that checks them."""

from adfacts.plans import (  # noqa: F401
    augmenting,
    chats,
    cleaning,
    evaluating,
    examples,
    files,
    ordered,
    rules,
    scoring,
    verifying,
    voting,
)
from adfacts.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
