"""Operators of a training-data pipeline, their queries and the SQL that checks them."""

from adfacts.llm import (
    chat,
    contamination,
    ctw,
    divergence,
    html_text,
    imatch,
    languages,
    licenses,
    merkle,
    mixing,
    near_copies,
    quality,
    secret_scan,
)

MODULES = [
    contamination, mixing, near_copies, imatch, quality, secret_scan, ctw, languages, licenses,
    html_text, merkle, divergence, chat,
]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
CHECKS = {name: sql for module in MODULES for name, sql in module.CHECKS.items()}

__all__ = ["CHECKS", "QUERIES"]
