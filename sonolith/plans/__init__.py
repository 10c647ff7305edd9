"""Registered queries of the annotation pipeline, with the SQL that checks them."""

from . import basic_queries, interval_queries, metric_queries, profile_queries, review_queries  # noqa: F401
from .views import ORACLE, QUERIES  # noqa: F401
