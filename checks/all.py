"""Importing this module registers every query."""
from checks import (  # noqa: F401
    q_activity, q_categories, q_functions, q_matching, q_serving, q_sources, q_state, q_streams,
)
from checks.registry import QUERIES, SQL  # noqa: F401
