"""Operators for training-data pipelines: deduplication, filters, language, quality, tokens and vector search."""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this package with the job, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
