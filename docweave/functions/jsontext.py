"""JSON text rules (S5 pretty printing, O1 output normalisation).

Pretty printing must keep key order, non-ASCII text and Python's number
spelling, which neither VARIANT nor ``to_json`` do; it is one Arrow-batched
pandas UDF over a string column.  Everything around it is JVM expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pyspark.sql.types import StringType, StructField, StructType  # noqa: E402

PRETTY_SCHEMA = StructType([StructField("text", StringType()), StructField("error", StringType())])


def safe_text(s):
    """``s`` as valid Unicode: a lone surrogate, which no Arrow string can
    hold, becomes U+FFFD.  Null stays null."""
    if s is None:
        return None
    try:
        s.encode()
        return s
    except UnicodeEncodeError:
        return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def pretty_one(v):
    """(pretty text, None) or (None, error) for one JSON string."""
    import json

    if v is None:
        return None, None
    try:
        return safe_text(json.dumps(json.loads(v), indent=2, ensure_ascii=False)), None
    except (ValueError, RecursionError) as e:
        return None, safe_text(f"{type(e).__name__}: {e}")


@F.pandas_udf(PRETTY_SCHEMA)
def _pretty(s: pd.Series) -> pd.DataFrame:
    pairs = [pretty_one(v) for v in s]
    return pd.DataFrame({"text": [p[0] for p in pairs], "error": [p[1] for p in pairs]})


def json_pretty(c) -> Column:
    """struct(text, error); invalid JSON gives text null and the error."""
    col = F.col(c) if isinstance(c, str) else c
    return _pretty(col)


# O1 ----------------------------------------------------------------------
_FENCE = r"(?sU)\A```(?:json)?[\s\x1c-\x1f]*(.*?)[\s\x1c-\x1f]*```\z"


def strip_fence(c) -> Column:
    """Remove one surrounding code fence (``` or ```json)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.rlike(_FENCE), F.regexp_replace(col, _FENCE, "$1")).otherwise(col)
