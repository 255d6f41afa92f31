"""leafmill: section trees, chunk stores, ranked retrieval and retrieval analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry this package's code with them: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
