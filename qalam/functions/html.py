"""HTML entity decoding — the one Python step in cleaning.

Python's ``html.unescape`` knows every HTML5 named entity (with and without
the trailing semicolon) and numeric references; re-implementing that table
in JVM expressions would be a copy of the standard library.  It runs as an
Arrow-batched pandas UDF whose input is null unless the string contains ``&``.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else x)


def unescape_html(c: Column) -> Column:
    # the UDF's input is null for all other rows: Spark runs it on every row of the plan
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)
