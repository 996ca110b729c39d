"""The few functions that no SQL expression covers, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> None:
    """Registers the UDFs in a session, under names of their own."""

    def normalize(texts: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else unicodedata.normalize(f, t) for t, f in zip(texts, forms, strict=True)])

    def resolve(relative: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else urljoin(b, r) for r, b in zip(relative, base, strict=True)])

    spark.udf.register("treequill_normalize", F.pandas_udf(normalize, "string"))
    spark.udf.register("treequill_resolve", F.pandas_udf(resolve, "string"))
