"""A raster dataflow engine on Spark: scans, per-band statistics, stretches, pyramids, catalog and ingest as DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions that run there are sent with what they use of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
