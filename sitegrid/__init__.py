"""Site-audit analytics as Spark DataFrame jobs.

Every table carries ``run_id`` and ``site``; every operator takes DataFrames and
returns DataFrames, so Catalyst sees one declarative plan per analysis.
"""

import sys

from pyspark import cloudpickle

# The few Python helpers that run inside tasks are shipped with the job, so
# executors do not need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
