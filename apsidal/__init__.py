"""Spark-native orbital conjunction analytics, with a training-data pipeline in ``apsidal.llm``."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
