"""clickpath: clickstream funnel analytics as Spark DataFrame jobs.

Raw events become sessions; sessions are cleaned, winsorized and enriched with
journey features; on top of them sit the conversion funnel, scorecards,
rank-based and contingency hypothesis tests and a purchase-propensity model.

Sub-packages
------------
``sources``    table scans, the fixture adapter, event cleaning, sinks
``functions``  pure ``Column`` expressions and scalar finishers (p-value tails)
``operators``  sessionization, session tables, scorecards, ranks, statistics, model
``plans``      the registered queries and their DuckDB SQL twins
``streaming``  Structured Streaming versions of sessionization and daily counts
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python functions that run inside tasks (p-value finishers, stateful streams, corpus
# operators) are pickled by value, so executors need no installed copy of
# this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from clickpath.context import configure, checkpoint_dir  # noqa: E402,F401

__all__ = ["configure", "checkpoint_dir"]
