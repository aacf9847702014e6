"""Operators applied to the driver's tables, one query per operator."""

from quirelens.queries import (  # noqa: F401
    audits,
    catalog,
    changes,
    graphs,
    links,
    scalars,
    searches,
)
from quirelens.queries.registry import ORACLES, QUERIES  # noqa: F401
