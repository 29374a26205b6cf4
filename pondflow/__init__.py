"""pondflow: keyed daily time-series toolkit for pond and salt-works balances on Spark.

Layout: ``functions`` (column expressions), ``operators`` (keyed DataFrame ->
DataFrame operators), ``sources`` (readers, driver tables, sinks), ``plans``
(composite queries and the driver catalog).

The most used entry points are re-exported here.
"""

__version__ = "0.1.0"

from pondflow.operators.filters import month_range, month_range_with_fallback  # noqa: E402,F401
from pondflow.operators.lookup import cyclic_lookup, map_lookup  # noqa: E402,F401
from pondflow.operators.recursive import fit_recursive, forecast_recursive, recursive_forecast  # noqa: E402,F401
from pondflow.operators.scan import chained_ratio, prefix_scan, running_sum  # noqa: E402,F401
from pondflow.operators.series import (asfreq_daily, detect_frequency, interpolate_time,  # noqa: E402,F401
                                       normalize_readings, resample)
from pondflow.operators.stats import quantiles, robust_scale  # noqa: E402,F401
from pondflow.operators.windows import expanding_stats, lag_features, rolling_stats  # noqa: E402,F401
from pondflow.plans.balance import (pond_balance, pond_balance_from_readings, pond_constant_balance,  # noqa: E402,F401
                                    zone_balance, zone_balance_from_readings)
from pondflow.session import checkpoint_dir, cluster_conf, get_spark  # noqa: E402,F401
from pondflow.sources.csv import read_csv, read_readings  # noqa: E402,F401
