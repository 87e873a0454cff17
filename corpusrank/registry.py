"""All registered queries of the operators."""

from . import queries_more, queries_zh  # noqa: F401  (they register their queries)
from .queries import QUERIES, SQL, flagship

__all__ = ["QUERIES", "SQL", "flagship"]
