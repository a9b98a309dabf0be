from launchlens.functions.columns import (  # noqa: F401
    amount, bound, clamp, clip01, nz, ratio, rounded, std_from_integer_sums, std_from_parts, std_of_units, units,
)
from launchlens.functions.ranks import floor_quantile_rank, median_from, order_statistics  # noqa: F401
from launchlens.functions.ordered import asof_join, prefix_sums, running_total, top_rows, totals_before  # noqa: F401
from launchlens.functions.ranges import range_aggregate  # noqa: F401
from launchlens.functions.tokens import token_join  # noqa: F401
