"""Operators for preparing training corpora. Nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

import capwindow.llm as _self

# Workers get the code of the operators with the plan, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(_self)
