"""History of changing attributes: versions and the periods in which they held.

Method: tree-reduction coalescing. Each snapshot is a unit interval; in round r the neighbouring runs
2k and 2k+1 of a series are merged, and where the payloads at the seam are equal the two intervals become
one. After log2(longest series) rounds a series is one list of maximal runs. One shuffle by series serves
all rounds: a series has at most one row per day, so no group outgrows the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.keys import key


def observations(rows: DataFrame, field: str, part: str, plant: str | None, day: str, value: str, seen_at: str, is_code: bool) -> DataFrame:
    """(field_name, part_id, plant_code, day, value): the value that counts for each series and day.

    Rows without value, part or day say nothing (blank counts as null). Of several rows of a series and day
    the one with the latest seen_at counts, a null seen_at being the oldest; of rows seen at the same time the
    greatest value. plant None stands for the single series "*" of the part; a null plant is a series of its own.
    """
    v = key(value) if is_code else F.col(value).cast("string")
    slim = rows.select(
        F.lit(field).alias("field_name"), key(part).alias("part_id"), (F.lit("*") if plant is None else key(plant)).alias("plant_code"),
        F.col(day).cast("date").alias("day"), v.alias("value"), F.col(seen_at).alias("t"),
    ).where("part_id is not null and day is not null and value is not null")
    return slim.groupBy("field_name", "part_id", "plant_code", "day").agg(F.max(F.struct("t", "value")).alias("m")).select("field_name", "part_id", "plant_code", "day", F.col("m.value").alias("value"))


def _merge(left, right):
    """Two neighbouring lists of runs as one; the runs at the seam become one if their payload is equal."""
    last, first = F.element_at(left, -1), F.element_at(right, 1)
    seam = F.array(F.struct(last["valid_from"].alias("valid_from"), first["last_seen"].alias("last_seen"), last["value"].alias("value"), (last["n_rows"] + first["n_rows"]).alias("n_rows")))
    joined = F.concat(F.slice(left, 1, F.size(left) - 1), seam, F.slice(right, 2, F.size(right)))
    return F.when(right.isNull(), left).when(last["value"] == first["value"], joined).otherwise(F.concat(left, right))


def versions(obs: DataFrame, max_days: int = 65536) -> DataFrame:
    """(field_name, part_id, plant_code, valid_from, valid_to, value, n_rows): one row per version.

    obs as given by observations(). A version holds from its first day to the day before the next one;
    valid_to is null for the last. max_days bounds the days of a series (179 years) and so the rounds; in the later
    ones a short series is a single row that passes unchanged. Empty input gives no rows.
    """
    series = ["field_name", "part_id", "plant_code"]
    longest = obs.groupBy(*series).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    if longest > max_days:
        raise ValueError(f"a series has {longest} days; raise max_days")
    # 1 row per day and series: the window's partitioning by series is that of every later round
    w = Window.partitionBy(*series).orderBy("day")
    unit = F.array(F.struct(F.col("day").alias("valid_from"), F.col("day").alias("last_seen"), F.col("value"), F.lit(1).cast("long").alias("n_rows")))
    runs = obs.select(*series, (F.row_number().over(w) - 1).alias("pos"), unit.alias("runs"))
    for _ in range(max(1, (longest - 1).bit_length())):
        side = lambda odd: F.first(F.when(F.col("pos") % 2 == odd, F.col("runs")), ignorenulls=True)
        runs = runs.groupBy(*series, F.shiftright("pos", 1).alias("pos")).agg(side(0).alias("l"), side(1).alias("r")).select(*series, "pos", _merge(F.col("l"), F.col("r")).alias("runs"))
    ends = F.transform("runs", lambda r, i: F.struct(r["valid_from"], F.date_sub(F.get("runs", i + 1)["valid_from"], 1).alias("valid_to"), r["value"], r["n_rows"]))
    return runs.select(*series, F.inline(ends))
