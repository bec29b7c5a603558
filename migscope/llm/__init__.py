"""Operators of a training-data pipeline over documents, embeddings and a benchmark.

Nothing else in the library imports this subpackage.  ``registry`` holds the
registered queries and their SQL; every operator module has its own general
interface and real outputs."""

import sys

from pyspark import cloudpickle

# Tasks get the code of this subpackage with their functions: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
