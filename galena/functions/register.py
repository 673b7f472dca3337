"""Named SQL functions, so that SQL text reaches the kernels and expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from galena.functions import kernels as K
from galena.operators.erasure import unpack_header
from galena.operators.ingest import movie


def register_all(spark: SparkSession) -> list[str]:
    """Registers blake2b256, cdc_cuts, shard_header_ok, movie_created, and the SQL-bodied hamming and haversine_km; returns their names."""

    @F.pandas_udf("binary")
    def blake2b256(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else K.blake(bytes(x)))

    @F.pandas_udf("array<long>")
    def cdc_cuts(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else K.cuts(bytes(x), 2048, 11, 16384))

    @F.pandas_udf("boolean")
    def shard_header_ok(data: pd.Series) -> pd.Series:
        return data.map(lambda x: x is not None and unpack_header(bytes(x)) is not None)

    @F.pandas_udf("double")
    def movie_created(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else movie(bytes(x)).get("created"))

    for f in (blake2b256, cdc_cuts, shard_header_ok, movie_created):
        spark.udf.register(f.__name__, f)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN 2 * 6371.0088 * asin(sqrt(least(1.0D, pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))")
    return ["blake2b256", "cdc_cuts", "shard_header_ok", "movie_created", "hamming", "haversine_km"]
