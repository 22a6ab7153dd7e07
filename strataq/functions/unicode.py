"""Functions that the JVM lacks, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def normalise_question(q: pd.Series) -> pd.Series:
    """Compatibility composition, lower case, white space to single blanks, stripped; null stays null."""
    return q.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).lower().split()))
