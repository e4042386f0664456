"""docweave: a Spark-native engine for turning document collections into
clean text and summaries with DataFrame operators.

Layout
------
functions/  Column-level rules (text, HTML, JSON) that stay inside Catalyst.
sources/    Readers that bring files or tables in as one row per document.
operators/  DataFrame -> DataFrame operators (extraction, assembly, requests,
            inference, output, reports).
plans/      End-to-end summarisation plans and the registered query set.
streaming/  The same column rules run incrementally on a streaming source.
"""

from __future__ import annotations

import sys as _sys

try:  # ship our Python helpers to executors by value: no py-files needed
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__all__ = ["__version__"]
__version__ = "0.1.0"
