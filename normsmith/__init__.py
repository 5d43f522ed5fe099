"""normsmith: rating-study analytics (dedup, screening, agreement,
resampling, norms) expressed as Spark DataFrame jobs."""

import sys as _sys

__version__ = "0.1.0"

# The pandas UDFs / grouped maps of this package are shipped to executors
# inside their task closures (pickled by value), so Python workers need not
# have the package installed or on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with --py-files
    pass
