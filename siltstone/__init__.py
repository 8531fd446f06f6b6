"""Document ingestion, hybrid retrieval and corpus preparation on Spark.

Functions that run on executors travel with their code, so that executors need
neither an installed copy of the package nor a shared source folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
