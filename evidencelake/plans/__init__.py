"""All registered queries of the library."""

from . import documents, learned, payloads, relations, sessions, stores, vectors  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES  # noqa: F401
