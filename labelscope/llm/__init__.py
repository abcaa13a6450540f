"""Training-data operators: near-dedup, packing, URL filter, decontamination,
language id, toxicity, line dedup, token counts, quality rules, substring dedup.

Nothing else in the library imports this package. The functions it hands to
Spark's Python workers are pickled by value, so a worker needs neither this
folder nor a PYTHONPATH of its own.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
