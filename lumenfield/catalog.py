"""All registered queries of the library's own operators, with their DuckDB SQL where it exists."""

import lumenfield.plans.frame_queries  # noqa: F401  registers its queries
import lumenfield.plans.scene_queries  # noqa: F401  registers its queries
from lumenfield.plans.queries import FLAGSHIP, ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
