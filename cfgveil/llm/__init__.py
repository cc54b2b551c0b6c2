"""Operators for preparing training data: deduplication, quality, packing, sharding, scoring.

Nothing outside this subpackage imports it. Its functions run inside Spark tasks and are
sent to the workers by value, so the workers need numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
