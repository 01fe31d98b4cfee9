"""Writing derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Degrees of a region's side.
REGION = 0.5


def with_region(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds `region`, the cell of half a degree a row lies in ("none" without a place)."""
    cell = lambda c: F.floor(F.col(c) / REGION).cast("string")
    return df.withColumn("region", F.coalesce(F.concat(cell(lat), F.lit("_"), cell(lon)), F.lit("none")))


def write_table(df: DataFrame, path: str, keys: list[str] | None = None, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Writes a derived table (nodes, edges, summaries, steps, documents) in folders by `keys`, such as region.

    Rows of one folder come from few tasks (dealt by the keys and 8 parts of the row), so that a large region is no single task and a small one no
    hundred files.
    """
    if keys:
        plain = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
        df = df.repartition(*keys, F.pmod(F.xxhash64(*plain), F.lit(8)))
    writer = df.write.mode(mode).format(kind)
    (writer.partitionBy(*keys) if keys else writer).save(path)
