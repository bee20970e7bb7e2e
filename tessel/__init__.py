"""tessel: vector collections, retrieval and evaluation expressed as Spark DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions handed to executors travel with their code, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
