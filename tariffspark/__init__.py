"""tariffspark: motor-insurance risk and tariff analytics on PySpark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run inside tasks travel with their code, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
