"""Registered queries: both modules add to the tables in `queries`."""

from . import queries, requests  # noqa: F401
