"""Greedy choices along an order, by pointers instead of a loop over a patient's rows.

Where a choice says which row is chosen next, the rows chosen are those that a first row reaches over its pointers. Pointers
are doubled: round k joins all rows reached so far with pointers over 2 ** k choices, so that a chain of n choices takes
log2 n rounds of two equality joins, spread by row, and no row ever holds a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweetframe.scratch import round_of, stage, written


def chosen(pointers: DataFrame, *, by: str = "patient_id", place: str = "place") -> DataFrame:
    """(by, place) of the rows that the first ones reach. pointers: by, place, ``next`` (a place or null), ``first`` (boolean).

    A place occurs once in ``by``. A pointer to a row that is itself a first one may be null.
    """
    spark = pointers.sparkSession
    with stage(spark) as paths:
        pointers = round_of(pointers.select(by, place, "next", "first"), paths)
        reached = pointers.where("first").select(by, place)
        jump = pointers.where("next is not null").select(by, place, "next")
        while not jump.isEmpty():
            more = reached.join(jump, [by, place]).select(by, F.col("next").alias(place))
            reached = round_of(reached.unionByName(more).distinct(), paths)
            onward = jump.select(by, F.col(place).alias("next"), F.col("next").alias("far"))
            jump = round_of(jump.join(onward, [by, "next"]).select(by, place, F.col("far").alias("next")), paths)
        return written(reached)
