"""Operators of a training-data pipeline over web-scale text tables.

Each module holds one operator with a general interface; ``queries`` holds the thin
``opN_<name>`` queries over the standard tables.  Nothing else in the library imports
this subpackage.  Its Python stages are sent to the executors by value, so that these need
numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
