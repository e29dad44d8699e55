"""Text-rewrite corpus curation and embedding analytics as Spark DataFrame operators.

Every public operator takes DataFrames and parameters and returns a DataFrame.
"""

import sys

from pyspark import cloudpickle

# Python functions that run on executors travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
