"""Interval joins on equal keys: windows as a few cells of several sizes, points reduced per cell.

A window of time is covered exactly by cells of `SIZES` seconds, the largest that fit,
and by the parts of its first and last second (level `INSTANTS`). No more than 30 cells of
each size but the largest are needed, however the window lies. Points are reduced per cell
by whoever joins them (summed, or cut to the newest few), so a window meets reduced rows
everywhere; inside the two partial seconds it meets points reduced per exact instant. Any
number of points with one time stamp is thus one reduced row to a window that holds it.

Where windows are many, neighbouring cells of a window are one row, a run: `cover_runs`,
`sums_per_run` and `meet_runs`. `RUN` cells of one size make one of the next, and a run is a
range of positions inside it, so a window has two rows of each size at most, but for the
largest, and two of instants. Points are few rows per cell; windows are what is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE = 16
SIZES = tuple(BASE**k for k in range(5))
RUN = 64
RUN_SIZES = tuple(RUN**k for k in range(4))
INSTANTS = -1
SECOND = 1_000_000


def _down(value: Column, by: int) -> Column:
    """Floor of a whole number's quotient, exact: what is divided is a multiple."""
    return ((value - F.pmod(value, F.lit(by))) / F.lit(by)).cast("bigint")


def _up(value: Column, by: int) -> Column:
    return -_down(-value, by)


def _cells(level: int, first: Column, beyond: Column) -> Column:
    """Cells `first` up to, not including, `beyond`."""
    numbers = F.when(first < beyond, F.sequence(first, beyond - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda n: F.struct(F.lit(level).alias("level"), n.alias("cell")))


def cover(windows: DataFrame, first_us: Column, last_us: Column) -> DataFrame:
    """One row per cell of each closed window: adds `level`, `cell`, `first_us`, `last_us`.

    A row of level `INSTANTS` names a second of which the window holds a part only. Windows
    without a start or an end, and empty ones, have no cells.
    """
    timed = windows.withColumns({"first_us": first_us, "last_us": last_us}).where("first_us <= last_us")
    seconds = timed.withColumns({
        "_from": _down(F.col("first_us"), SECOND), "_to": _down(F.col("last_us"), SECOND),
        "_lo0": _up(F.col("first_us"), SECOND), "_hi0": _down(F.col("last_us") + 1, SECOND),
    })
    border = F.array_distinct(F.array_compact(F.array(
        F.when(F.col("_from") < F.col("_lo0"), F.col("_from")), F.when(F.col("_to") >= F.col("_hi0"), F.col("_to")))))
    pieces = [F.transform(border, lambda s: F.struct(F.lit(INSTANTS).alias("level"), s.alias("cell")))]
    rows = seconds
    for level in range(len(SIZES)):
        lo, hi = F.col(f"_lo{level}"), F.col(f"_hi{level}")
        if level + 1 == len(SIZES):
            pieces.append(_cells(level, lo, hi))
            break
        up, down = f"_lo{level + 1}", f"_hi{level + 1}"
        rows = rows.withColumns({up: _up(lo, BASE), down: _down(hi, BASE)})
        inside = F.col(up) < F.col(down)
        pieces.append(_cells(level, lo, F.when(inside, F.col(up) * BASE).otherwise(hi)))
        pieces.append(_cells(level, F.when(inside, F.col(down) * BASE).otherwise(hi), hi))
    covered = rows.withColumn("_piece", F.explode(F.concat(*pieces)))
    return covered.select(*windows.columns, "first_us", "last_us", "_piece.level", "_piece.cell")


def _second(time_us: str) -> Column:
    return _down(F.col(time_us), SECOND)


def sums_per_cell(points: DataFrame, time_us: str, keys: Sequence[str], value: str) -> DataFrame:
    """`keys`, `level`, `cell`, `time_us`, `value`: sums per cell of every size, added up before the shuffle."""
    nowhen = F.lit(None).cast("bigint")
    pieces = [F.struct(F.lit(INSTANTS).alias("level"), _second(time_us).alias("cell"), F.col(time_us).alias("at"))] + [
        F.struct(F.lit(level).alias("level"), _down(_second(time_us), size).alias("cell"), nowhen.alias("at"))
        for level, size in enumerate(SIZES)
    ]
    celled = points.select(*keys, value, F.explode(F.array(*pieces)).alias("_piece"))
    return celled.groupBy(*keys, "_piece.level", "_piece.cell", F.col("_piece.at").alias(time_us)).agg(F.sum(value).alias(value))


def newest_per_cell(points: DataFrame, time_us: str, keys: Sequence[str], order: Sequence[Column | str], count: int) -> DataFrame:
    """The first `count` points, in `order`, of every instant and of every cell; adds `level` and `cell`.

    Instants are cut first. All finer cells of one largest cell are in one place then, so
    the ranks of all sizes take no further exchange.
    """
    first = Window.partitionBy(*keys, time_us).orderBy(*order)
    rows = points.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= count).drop("_rank")
    rows = rows.withColumn("_top", _down(_second(time_us), SIZES[-1]))
    pieces = [F.struct(F.lit(INSTANTS).alias("level"), _second(time_us).alias("cell"))]
    for level, size in enumerate(SIZES):
        rows = rows.withColumn(f"_cell{level}", _down(_second(time_us), size))
        place = Window.partitionBy(*keys, "_top", f"_cell{level}").orderBy(*order)
        rows = rows.withColumn(f"_rank{level}", F.row_number().over(place))
        pieces.append(F.when(
            F.col(f"_rank{level}") <= count, F.struct(F.lit(level).alias("level"), F.col(f"_cell{level}").alias("cell"))))
    kept = rows.withColumn("_piece", F.explode(F.array_compact(F.array(*pieces))))
    return kept.select(*points.columns, "_piece.level", "_piece.cell")


def meet(covered: DataFrame, leveled: DataFrame, time_us: str, keys: Sequence[str] = ()) -> DataFrame:
    """Windows' cells joined to the reduced points in them under equal `keys`."""
    met = covered.join(leveled, [*keys, "level", "cell"])
    return met.where((F.col("level") != INSTANTS) | F.col(time_us).between(F.col("first_us"), F.col("last_us"))).drop(
        "level", "cell", "first_us", "last_us")


def _run(level: int, cell: Column, lo: Column, hi: Column) -> Column:
    return F.struct(
        F.lit(level).alias("level"), cell.alias("cell"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def cover_runs(windows: DataFrame, first_us: Column, last_us: Column) -> DataFrame:
    """One row per run of each closed window: adds `level`, `cell`, and positions `lo` to `hi` inside the cell.

    A cell holds `RUN` cells of `RUN_SIZES[level]` seconds; at level `INSTANTS` it is a second
    and a position a microsecond. Windows without a start or an end, and empty ones, have no runs.
    """
    rows = windows.withColumns({"_first": first_us, "_last": last_us}).where("_first <= _last").withColumns({
        "_from": _down(F.col("_first"), SECOND), "_to": _down(F.col("_last"), SECOND),
        "_lo0": _up(F.col("_first"), SECOND), "_hi0": _down(F.col("_last") + 1, SECOND),
    })
    cut, second = F.col("_from") < F.col("_lo0"), F.lit(SECOND)
    end = F.col("_last") - F.col("_to") * second
    pieces = [
        F.when(cut, _run(INSTANTS, F.col("_from"), F.pmod("_first", second),
                         F.when(F.col("_from") == F.col("_to"), end).otherwise(second - 1))),
        F.when((F.col("_to") >= F.col("_hi0")) & ~(cut & (F.col("_from") == F.col("_to"))),
               _run(INSTANTS, F.col("_to"), F.lit(0), end)),
    ]
    for level in range(len(RUN_SIZES) - 1):
        lo, hi = F.col(f"_lo{level}"), F.col(f"_hi{level}")
        rows = rows.withColumns({f"_lo{level + 1}": _up(lo, RUN), f"_hi{level + 1}": _down(hi, RUN)})
        up, down = F.col(f"_lo{level + 1}"), F.col(f"_hi{level + 1}")
        last = hi - 1 - down * RUN
        pieces += [
            # a cell border lies in the range: what is before the first and from the last one on
            F.when((up <= down) & (lo < up * RUN), _run(level, up - 1, lo - (up - 1) * RUN, F.lit(RUN - 1))),
            F.when((up <= down) & (down * RUN < hi), _run(level, down, F.lit(0), last)),
            F.when((up > down) & (lo < hi), _run(level, down, lo - down * RUN, last)),
        ]
    top = len(RUN_SIZES) - 1
    lo, hi = F.col(f"_lo{top}"), F.col(f"_hi{top}")
    cells = F.when(lo < hi, F.sequence(_down(lo, RUN), _down(hi - 1, RUN))).otherwise(F.array().cast("array<bigint>"))
    whole = F.transform(cells, lambda c: _run(
        top, c, F.greatest(F.lit(0), lo - c * RUN), F.least(F.lit(RUN - 1), hi - 1 - c * RUN)))
    covered = rows.withColumn("_piece", F.explode(F.concat(F.array_compact(F.array(*pieces)), whole)))
    return covered.select(*windows.columns, "_piece.*")


def sums_per_run(points: DataFrame, time_us: str, keys: Sequence[str], value: str) -> DataFrame:
    """`keys`, `level`, `cell`, `pos`, `value`: sums per position of cells of every size, added up before the shuffle."""
    second = _second(time_us)
    piece = lambda level, cell, pos: F.struct(
        F.lit(level).alias("level"), cell.alias("cell"), pos.cast("int").alias("pos"))
    pieces = [piece(INSTANTS, second, F.pmod(time_us, F.lit(SECOND)))] + [
        piece(level, _down(second, size * RUN), F.pmod(_down(second, size), F.lit(RUN)))
        for level, size in enumerate(RUN_SIZES)
    ]
    celled = points.select(*keys, value, F.explode(F.array(*pieces)).alias("_piece"))
    return celled.groupBy(*keys, "_piece.level", "_piece.cell", "_piece.pos").agg(F.sum(value).alias(value))


def meet_runs(covered: DataFrame, leveled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Windows' runs joined to the reduced points in them under equal `keys`."""
    met = covered.join(leveled, [*keys, "level", "cell"])
    return met.where(F.col("pos").between(F.col("lo"), F.col("hi"))).drop("level", "cell", "lo", "hi", "pos")
