"""Spark jobs over evidence documents, versioned requirements and text corpora.

Functions of this package run inside Python workers too. The package is pickled by value, so that
executors need no copy of it on their own import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
