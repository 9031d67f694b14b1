"""Post analytics on Spark: enrichment, scoring, decisions, history and review as DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so no executor needs a copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
