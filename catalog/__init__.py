"""Adapter over the driver tables, the registered queries and their SQL."""

import sys

from pyspark import cloudpickle

# As those of the library, functions of the queries travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
