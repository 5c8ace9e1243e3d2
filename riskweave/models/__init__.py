"""Anomaly models, classifiers and role mining as Spark jobs.

The functions that run inside tasks travel to the executors by value, so a
cluster needs no copy of this package on its workers.
"""

from pyspark import cloudpickle

import riskweave

cloudpickle.register_pickle_by_value(riskweave)
