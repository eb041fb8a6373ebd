"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

Functions of this subpackage travel to the workers by value: a job runs on executors that lack the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
