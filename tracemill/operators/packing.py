"""Sequences packed into bins of a capacity without cutting any: best fit decreasing over the histogram of lengths.

Rows of one length are alike, so bins are planned from the counts by length alone, as patterns that many bins share:
a plan is as long as there are lengths and patterns, not rows. Rows take their places in it by their number among
those of their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import places
from .names import free


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first, last, bin, each): the rows numbered first to last - 1 of a length go to bins from `bin` on, `each` to one.

    Longest first; each takes the fullest open bin that has room for it. A length beyond the capacity, and one of 0 or
    less, has bins of its own: the former one to a row, the latter one for all.
    """
    out, next_bin = [], 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by free space, runs of bins: first bin, number
    spaces: list[int] = []

    def open_(space: int, first: int, number: int) -> None:
        if number and space > 0:
            if not room[space]:
                insort(spaces, space)
            room[space].append((first, number))

    for length in sorted(counts, reverse=True):
        left, at = counts[length], 0
        if length > capacity or length <= 0:
            each = 1 if length > 0 else left
            out.append((length, 0, left, next_bin, each))
            next_bin += -(-left // each)
            continue
        while left:
            k = bisect_left(spaces, length)
            if k < len(spaces):
                space = spaces[k]
                first, number = room[space].pop()
                if not room[space]:
                    spaces.pop(k)
            else:
                space, first = capacity, next_bin
                number = -(-left // (capacity // length))
                next_bin += number
            each = space // length
            full = min(number, left // each)
            if full:
                out.append((length, at, at + full * each, first, each))
                at, left = at + full * each, left - full * each
                open_(space - each * length, first, full)
            if full < number:
                if left and left < each:  # what doesn't fill a bin goes to one more
                    out.append((length, at, at + left, first + full, left))
                    open_(space - left * length, first + full, 1)
                    at, left, full = at + left, 0, full + 1
                open_(space, first + full, number - full)
    return out


def packed(df: DataFrame, length: str, id_: str, capacity: int) -> DataFrame:
    """df with bin (long): rows of one bin have lengths of capacity together at most; a longer row has a bin of its own.

    id_ tells rows apart and orders rows of one length. A null length counts as 0; rows of length 0 or less share bins of
    their own. Bins are numbered from 0 without gaps. The counts by length come to the driver: there are as many as lengths.
    """
    own, at = free(df, "length"), free(df, "at")
    rows = df.withColumn(own, F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long"))
    counts = {r["n"]: r["rows"] for r in rows.groupBy(F.col(own).alias("n")).agg(F.count("*").alias("rows")).collect()}
    schema = "`length of bins` long, `first of bins` long, `last of bins` long, `bin of bins` long, `each of bins` long"
    table = df.sparkSession.createDataFrame(plan(counts, capacity), schema)
    placed = places.running(rows, [own], [id_], {at: F.lit(1).cast("long")})
    number = F.col(at) - 1
    met = placed.join(table, (F.col(own) == F.col("length of bins")) & (number >= F.col("first of bins")) & (number < F.col("last of bins")))
    bin_ = F.col("bin of bins") + F.floor((number - F.col("first of bins")) / F.col("each of bins"))
    return met.select(*df.columns, bin_.cast("long").alias("bin"))
