"""evenkeel: skew-aware grouping of keyed tables and streams, written as Spark jobs.

A *grouping* decides which of ``k`` workers every row of a keyed table goes to, so that
load stays even although a few keys dominate. Tables carry these columns by convention:

``seq``     dense arrival number, from 0        ``key``     BIGINT or STRING
``source``  parallel source, 0..s-1             ``period``  count window, from 1
``worker``  chosen worker, 0..k-1               ``cnt``     rows counted
``bucket``  hash bucket of a key
"""

import sys

from pyspark import cloudpickle

from evenkeel.plans.groupings import (
    ColumnGrouping,
    Grouping,
    HashGrouping,
    LearnedGrouping,
    OnlineGrouping,
    PandasGrouping,
    TwoChoiceGrouping,
    compare,
)

# Functions that run inside tasks travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "ColumnGrouping",
    "Grouping",
    "HashGrouping",
    "LearnedGrouping",
    "OnlineGrouping",
    "PandasGrouping",
    "TwoChoiceGrouping",
    "compare",
]
