"""Training-data operators: sharding, filtering, deduplication, scoring and tokenisation.

Nothing else in the library imports this subpackage. Functions that run on
executors are pickled by value, so executors need no copy of the package.
"""

import lodestone.llm as _self
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(_self)
