"""Operators for preparing training text; nothing else in the library imports them.

Their Python functions travel to the executors by value, so workers need only numpy,
pyarrow and, for the URL filter, pyahocorasick.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
