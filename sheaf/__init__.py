"""sheaf: corpus packing on Spark.

Turns tables of files into Markdown packs, one per session, and keeps the history and
staleness of those packs.  Every operator maps DataFrames to DataFrames.
"""

import sys

from pyspark import cloudpickle

# Tasks get the package's small Python helpers inside the pickled function, so executors
# need nothing installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
