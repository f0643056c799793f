"""Operators for building training corpora. Nothing outside this subpackage imports it."""

from pyspark import cloudpickle

import tallyforge.llm as _self

# Workers need not have this package on their path: functions travel by value.
cloudpickle.register_pickle_by_value(_self)
