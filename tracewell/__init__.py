"""Sensor-trace analytics as plain Spark DataFrame jobs.

Every public function takes and returns DataFrames; the work is left to Catalyst.
"""

import sys

from pyspark import cloudpickle

from tracewell.session import configure, shared_dir, stored

# Functions that run inside tasks travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["configure", "shared_dir", "stored"]
