"""The registered queries of the engine's operators and their SQL, one pair per operator."""

from .plans import entities, joins, matching, profiles, reshape, scalars, schema, validation  # noqa: F401
from .plans.registry import QUERIES, SQL  # noqa: F401
