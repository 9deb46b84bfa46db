"""The user-defined function surface: scalar, aggregate, table and grouped functions over Arrow batches.

Types are given as objects, since a DDL string would need a session when this module is imported.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def discounted(price: pd.Series, discount: pd.Series) -> pd.Series:
    """Price after the discount."""
    return price * (1 - discount)


@F.pandas_udf(T.DoubleType())
def middle(values: pd.Series) -> float:
    """The median of a group or of a window frame."""
    return float(values.median())


@F.arrow_udf(T.LongType())
def doubled(x: pa.Array) -> pa.Array:
    """Twice the value, on Arrow arrays."""
    return pc.multiply(x, 2)


@F.udf(T.StringType(), useArrow=True)
def initials(name: str | None) -> str | None:
    """The capitals and digits of a name."""
    return None if name is None else "".join(c for c in name if c.isupper() or c.isdigit())


@F.udtf(returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.IntegerType())]))
class WordLengths:
    """A row for each part of a string between underscores."""

    def eval(self, text: str):
        for word in (text or "").split("_"):
            yield word, len(word)
