"""Flow-ecology analytics for streams, written as Spark DataFrame operators.

``riffle.functions``  column-level rules (missing values, labels, grids)
``riffle.sources``    tables, label dimension, point and ring layers, model tables
``riffle.operators``  joins, reshaping, tallies, limits, outcomes, reports
``riffle.models``     grouped regression from statistics aggregated in Spark
``riffle.geo``        projections, point in polygon, gage crosswalk, upstream walk
``riffle.plans``      the analyses end to end, and the query registry
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors as code: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
