"""Operators for training data: language, duplicates, leaks, licenses, secrets, archives, chats, tokens.

Functions of this package travel to the executors by value, so nothing has to be
installed there besides the public libraries they import.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
