"""The five smallest and largest values of each column, one job for each type family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import hashable, named

NUMBER = 5


def extremes(df: DataFrame, columns: dict[str, bool], number: int = NUMBER) -> DataFrame:
    """(k, side, place, v): the first values in either direction, in the columns' own order.

    ``columns`` maps a name to whether values are made distinct first; k is its place. The columns
    must share a physical type. Each task sends at most ``number`` rows for each column and side.
    """
    kind = df.schema[next(iter(columns))].dataType
    spread = [F.struct(F.lit(k).alias("k"), named(c).cast(kind).alias("v"), F.lit(d).alias("d")) for k, (c, d) in enumerate(columns.items())]
    flat = df.select(F.explode(F.array(*spread)).alias("s")).select("s.*").where("v is not null")
    if any(columns.values()):
        once = flat.where("d").dropDuplicates(["k", "v"])
        flat = once if all(columns.values()) else once.unionByName(flat.where("not d"))
    sides = []
    for side, order in (("smallest", F.col("v").asc()), ("largest", F.col("v").desc())):
        w = W.partitionBy("k").orderBy(order)
        sides.append(flat.withColumn("place", F.row_number().over(w)).where(F.col("place") <= number).select("k", F.lit(side).alias("side"), "place", "v"))
    return sides[0].unionByName(sides[1])


def grouped_by_type(df: DataFrame, columns: dict[str, bool]) -> list[dict[str, bool]]:
    """Columns of the same physical type together; nested ones are left out."""
    out: dict[str, dict[str, bool]] = {}
    for c, d in columns.items():
        kind = df.schema[c].dataType
        if hashable(kind):
            out.setdefault(kind.simpleString(), {})[c] = d
    return list(out.values())
