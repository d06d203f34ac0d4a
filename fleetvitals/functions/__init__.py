"""Column helpers shared by the operators."""

from fleetvitals.functions.keys import CATALOG_SCOPE, SCOPE, SERVER_SCOPE, scope_of
from fleetvitals.functions.numeric import div, guarded, half_up, trimmed_mean
from fleetvitals.functions.text import base_name, fill, fixed_width, format_datetime, quote_name

__all__ = [
    "CATALOG_SCOPE",
    "SCOPE",
    "SERVER_SCOPE",
    "base_name",
    "div",
    "fill",
    "fixed_width",
    "format_datetime",
    "guarded",
    "half_up",
    "quote_name",
    "scope_of",
    "trimmed_mean",
]
