from stockgrid.functions.exact import exact_sum, exact_total, grouped  # noqa: F401
from stockgrid.functions.normalize import (  # noqa: F401
    coerce_numeric, coerce_timestamp, normalize_identifier, strip_ws,
)
