"""skuloom: product-catalogue intake, enrichment and export as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Small helper functions travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
