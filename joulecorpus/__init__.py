"""Spark-native corpus preparation and energy-telemetry analytics."""

import sys

from pyspark import cloudpickle

from joulecorpus.config import CorpusConfig, SyncConfig

# Functions that run in Python workers travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["CorpusConfig", "SyncConfig"]
