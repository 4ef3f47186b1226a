"""Long windows from pre-aggregated time tiles.

Values are summed up once per (key, tile). A row's window has three parts: its
own tile up to the row, whole tiles, and the end of the tile its far edge lies
in. The first is a running aggregate within the tile, the second a RANGE frame
over the tiles of a key, worked out once a tile and not once a row, and the
third a running aggregate from the tile's end back to the edge. So a row costs
the same however many rows its window holds, a key is spread over tasks by its
tiles, and the answer equals the untiled one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .window import Feature, micros, window_features

SECOND_US = 1_000_000
#: Default granularities of one minute, five minutes, one hour and one day.
DEFAULT_TILES_US = (60 * SECOND_US, 300 * SECOND_US, 3600 * SECOND_US, 86_400 * SECOND_US)


def check_tiles(tiles_us: tuple[int, ...]) -> tuple[int, ...]:
    """Sorted granularities; each must be a multiple of the one before."""
    ordered = tuple(sorted(tiles_us))
    if not ordered or ordered[0] <= 0 or any(b % a for a, b in zip(ordered, ordered[1:])):
        raise ValueError("each granularity must be a positive multiple of the finer one")
    return ordered


def cover(start: int, end: int, tiles_us: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """Parts (granularity or 0 for raw, from, to) of [start, end): coarsest aligned tiles first, raw at the edges."""
    out: list[tuple[int, int, int]] = []
    at = start
    while at < end:
        fits = [g for g in tiles_us if at % g == 0 and at + g <= end]
        if fits:
            step = max(fits)
            to = at + step
        else:
            step, to = 0, min(end, (at // tiles_us[0] + 1) * tiles_us[0])
        if out and out[-1][0] == step and out[-1][2] == at:
            out[-1] = (step, out[-1][1], to)
        else:
            out.append((step, at, to))
        at = to
    return out


def build_tiles(df: DataFrame, keys: list[str], time: str, value: str, tiles_us: tuple[int, ...]) -> DataFrame:
    """(keys, g, tile, s, n, lo, hi): coarser tiles are made from the finest, not from rows."""
    fine = check_tiles(tiles_us)[0]
    stamp = micros(F.col(time), dict(df.dtypes)[time])
    base = df.groupBy(*keys, (F.floor(stamp / fine) * fine).alias("tile")).agg(F.sum(value).alias("s"), F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    each = base.withColumn("g", F.explode(F.array(*(F.lit(g) for g in check_tiles(tiles_us)))))
    return each.groupBy(*keys, "g", (F.floor(F.col("tile") / F.col("g")) * F.col("g")).alias("tile")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def chosen_tile(tiles_us: tuple[int, ...], length_us: int, most: int = 256) -> int | None:
    """The finest granularity of which at most ``most`` make the window, else the coarsest that is not longer; None where all are longer."""
    fit = [g for g in check_tiles(tiles_us) if g <= length_us]
    return next((g for g in fit if length_us <= most * g), fit[-1] if fit else None)


FUNCTIONS = ("sum", "count", "avg", "min", "max")


def tiled_features(df: DataFrame, keys: list[str], time: str, value: str, length_us: int, row_id: str, tiles_us: tuple[int, ...] = DEFAULT_TILES_US, functions: tuple[str, ...] = FUNCTIONS, prefix: str = "w_") -> DataFrame:
    """``df`` with w_sum, w_count, w_avg, w_min and w_max of ``value`` over [time - length, row] in (time, row_id) order.

    ``functions`` names those to add, after ``prefix``. ``row_id`` must be unique
    within a time of a key. Rows with a null time are left out. Windows shorter than
    every tile are plain ones.
    """
    kinds = dict(df.dtypes)
    g = chosen_tile(tiles_us, length_us)
    if g is None:
        made = [Feature(f"{prefix}{f}", f, (value,), length_us) for f in functions]
        return window_features(df, keys, time, made, row_id)
    by = [*keys, "__tile"]
    stamp = micros(F.col(time), kinds[time])
    rows = df.where(F.col(time).isNotNull()).withColumn("__ts", stamp).withColumn("__tile", F.floor(F.col("__ts") / g) * g).withColumn("__v", F.col(value))
    # Whole tiles between: ``k`` tiles back lies the one with the far edge; k takes one value, or two where tiles do not divide the length.
    backs = sorted({-(-length_us // g), length_us // g})
    tiles = rows.groupBy(*by).agg(*(f.alias(f"t_{x}") for x, f in zip("snlh", _plain("__v", raw=True))))
    frames = {}
    for k in backs:
        over = Window.partitionBy(*keys).orderBy("__tile").rangeBetween(-(k - 1) * g, -g)
        frames |= {f"m{k}_{x}": f.over(over) if k > 1 else F.lit(None).cast("long") for x, f in zip("snlh", _plain("t_"))}
    middle = tiles.select(*(F.col(c).alias(f"__k{n}") for n, c in enumerate(keys)), F.col("__tile").alias("__at"), *(f.alias(c) for c, f in frames.items()))
    same = F.col("__tile") == F.col("__at")
    for n, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{n}"))
    head = Window.partitionBy(*by).orderBy("__ts", row_id).rowsBetween(Window.unboundedPreceding, 0)
    first = rows.select("*", *(f.over(head).alias(f"a_{x}") for x, f in zip("snlh", _plain("__v", raw=True))))
    joined = first.join(middle, same, "left")
    edge = F.col("__ts") - length_us
    back = ((F.col("__tile") - F.floor(edge / g) * g) / g).cast("long")
    for x in "snlh":
        pick = F.lit(None)
        for k in backs:
            pick = F.when(back == k, F.col(f"m{k}_{x}")).otherwise(pick)
        joined = joined.withColumn(f"b_{x}", pick)
    ask = joined.select(*df.columns, *(f"{p}_{x}" for p in "ab" for x in "snlh"), (F.floor(edge / g) * g).alias("__tile"), edge.alias("__from"), F.lit(1).alias("__ask"), F.lit(None).cast(kinds[value] if value in kinds else "double").alias("__v"))
    seen = rows.select(*keys, "__tile", F.col("__ts").alias("__from"), F.lit(0).alias("__ask"), "__v")
    tail = Window.partitionBy(*by).orderBy(F.desc("__from"), "__ask").rowsBetween(Window.unboundedPreceding, 0)
    both = ask.unionByName(seen, allowMissingColumns=True)
    done = both.select("*", *(f.over(tail).alias(f"c_{x}") for x, f in zip("snlh", _plain("__v", raw=True)))).where("__ask = 1")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n = zero("a_n") + zero("b_n") + zero("c_n")
    total = F.when(n > 0, zero("a_s") + zero("b_s") + zero("c_s"))
    answers = {"sum": total, "count": n, "avg": F.try_divide(total, n), "min": F.least("a_l", "b_l", "c_l"), "max": F.greatest("a_h", "b_h", "c_h")}
    return done.select(*df.columns, *(answers[f].alias(f"{prefix}{f}") for f in functions))


def _plain(p: str, raw: bool = False) -> list[Column]:
    """sum, count, min and max of a value, or of tiles' parts with the prefix ``p``."""
    if raw:
        return [F.sum(p), F.count(p), F.min(p), F.max(p)]
    return [F.sum(f"{p}s"), F.sum(f"{p}n"), F.min(f"{p}l"), F.max(f"{p}h")]
