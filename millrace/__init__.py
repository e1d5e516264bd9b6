"""millrace: feature preparation, evaluation and classical modelling as Spark plans."""

import sys

from pyspark import cloudpickle

# Python-side operators travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
