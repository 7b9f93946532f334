"""churnscope: service-agreement churn analytics on Spark DataFrames.

Every operator is a plain function ``DataFrame(s) -> DataFrame`` that takes the
as-of date and key columns as parameters.  Sub-packages:

* ``sources``   - table scans, CSV hand-over, test-table analog views
* ``functions`` - column expressions (as-of windows, flags, buckets, hashing)
* ``operators`` - joins, aggregates, windows, segments, statistics, sampling,
                  evaluation and MLlib models
* ``plans``     - end-to-end compositions (feature table, labelled active set,
                  train/score/report)
* ``streaming`` - intentionally empty: the studied workload is batch only
"""

from churnscope.session import get_spark, checkpoint_dir  # noqa: F401

DEFAULT_AS_OF = "1998-03-01"
HORIZONS = (7, 14, 21)
