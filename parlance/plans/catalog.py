"""The registered queries and their SQL oracles."""

from . import condition_queries, conversation_queries, graph_queries, label_queries, report_queries, study_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
