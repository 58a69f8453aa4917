"""Speech-transcript analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a lazy DataFrame.  A corpus holds many
recordings; the key is always ``recording_id``.  Times are BIGINT milliseconds from the
start of the recording inside operators and DOUBLE seconds where values are shown.
"""

import sys

from pyspark import cloudpickle

# the small per-slice helpers travel to the executors with the query, so the package need
# not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
