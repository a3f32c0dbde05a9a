"""Importing this module registers every query."""

from workload import file_queries, job_queries, label_queries, pages_queries, store_queries  # noqa: F401
from workload.base import ORACLE, QUERIES  # noqa: F401
