"""Brand-mention analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

from mentionlake.params import Params

# Executors need no copy of this package: its functions travel with the tasks using them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Params"]
