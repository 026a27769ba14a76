"""Areas and statistics by class: one pass, one aggregation with a partial step on the map side, for all times at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import KEYS, Raster
from .align import align
from .area import cell_area, with_area

CLASS, TOTAL = "classification", "total_area"
Area = DataFrame | Raster | float | bool | None
#: Whole multiples of this add up without rounding to 1.4e11 (2**53 of them), more hectares than the Earth has.
SUM_STEP = 2.0**-16


def prepared(raster: Raster, area: Area) -> DataFrame:
    """Pixels with their area: True by the grid, a number for every cell, a table or raster of areas, or 1 for each cell (None, False, 0)."""
    if area is True:
        return with_area(raster, cell_area(raster))
    if isinstance(area, Raster):
        area = area.pixels.select(*area.keys, F.col(area.variables[0]).alias("area"))
    if isinstance(area, DataFrame):
        return with_area(raster, area)
    return raster.pixels.withColumn("area", F.lit(float(area) if area else 1.0))


def steady_sum(c: Column) -> Column:
    """Sum of doubles in any order of rows: that of the nearest whole steps, exact, and that of the small rests, whose rounding is below the last bit of the result. A plain sum of 240,000 cells is off by hundreds of last bits, others in each order."""
    c = c.cast("double")
    whole = F.rint(c / SUM_STEP) * SUM_STEP
    return F.sum(whole) + F.sum(F.nanvl(c - whole, F.lit(0.0)))  # no rest of an infinite area


def legend_names(legend: Mapping[int, str] | None, codes: list, skip_zero: bool = True) -> dict:
    """Names of wide columns: by value where the legend has it, else the code itself; whole numbers without a fraction."""
    whole = lambda c: int(c) if float(c).is_integer() else c
    return {c: str((legend or {}).get(whole(c), whole(c))) for c in codes if not (skip_zero and c == 0)}


def legend_of(raster: Raster, var: str | None = None) -> list[str] | None:
    """Meanings of a variable's codes in the order of the codes, None where there is no legend."""
    names = [var] if var else raster.variables
    legend = raster.legends.get(names[0]) if len(names) == 1 else None
    return [legend[k] for k in sorted(legend)] if legend else None


def positional_legend(meanings: str | list[str]) -> dict[int, str]:
    """The legend of codes 1, 2, ... for meanings without values: a list, or one string of words."""
    words = meanings.split() if isinstance(meanings, str) else list(meanings)
    return {k + 1: w for k, w in enumerate(words)}


def _wide(long: DataFrame, key: str, keys: list[str], metric: str, names: dict) -> DataFrame:
    """A column for each name and their sum, NULL for a class that a time lacks; one row without time. Codes of one name share its column."""
    codes: dict[str, list] = {}
    for c, n in names.items():
        codes.setdefault(n, []).append(c)
    taken = {x.lower() for x in (*keys, TOTAL)}
    if bad := [n for n in codes if n.lower() in taken]:
        raise ValueError(f"no class can be named {bad}")
    cols = [F.sum(F.when(F.col(key).isin(own), F.col(metric))).alias(n) for n, own in codes.items()]
    wide = long.groupBy(*keys).agg(*cols) if cols else long.groupBy(*keys).agg(F.lit(0).alias("_none")).drop("_none")
    parts = [F.coalesce(F.col("`" + n.replace("`", "``") + "`"), F.lit(0.0)) for n in codes]
    total: Column = F.lit(0.0)
    for p in parts:
        total = total + p
    return wide.withColumn(TOTAL, total)


def class_area(raster: Raster, area: Area = None, var: str | None = None, count_name: str = "area_hectares", wide: bool = True, drop_zero: bool = True, legend: Mapping[int, str] | None = None, classes: list | None = None) -> DataFrame:
    """Area by class, and by time where there is one. Cells without a class are left out, areas of NULL are skipped.

    Long: [time,] classification, count_name. Wide: a column for each class, named by the legend, and total_area, for each time or in one
    row. Class 0 is no data and goes with drop_zero. classes gives the wide columns; without it, and without a legend, the classes are looked up first."""
    r = raster.select(var)
    v = r.variables[0]
    keys = [k for k in r.keys if k == "time"]
    p = prepared(r, area).where(F.col(v).isNotNull())
    if drop_zero:
        p = p.where(F.col(v) != 0)
    long = p.groupBy(*keys, F.col(v).alias(CLASS)).agg(F.sum("area").alias(count_name))
    if not wide:
        return long
    legend = legend or r.legends.get(v)
    if classes is None:
        classes = sorted(legend) if legend else [x[0] for x in long.select(CLASS).distinct().orderBy(CLASS).collect()]
    return _wide(long, CLASS, keys, count_name, legend_names(legend, classes, drop_zero))


def combine_classes(primary: Raster, secondary: Raster, drop_zero: bool = True) -> DataFrame:
    """([time,] yi, xi, p, s, code) of cells that either raster has on one grid (a static one counts at each time of the other): code is p + s / 10, or 0 where either is 0 and drop_zero is set, even if the other is missing or has no row; otherwise NULL where either is missing. p and s stay the real keys, as codes of s from 10 on collide."""
    a, b = primary.select(), secondary.select()
    left, right = a.pixels.withColumnRenamed(a.variables[0], "p"), b.pixels.withColumnRenamed(b.variables[0], "s")
    on = [k for k in KEYS if k in left.columns and k in right.columns]
    # merge: where a filter makes this an inner join, pixels of a well packed file would look small enough to be broadcast
    if len(left.columns) == len(right.columns):
        d = left.hint("merge").join(right, on, "full")
    else:  # a static raster at the times of the other: a cell without a row at any of them is of no time
        timed, static = (left, right) if "time" in left.columns else (right, left)
        times = F.broadcast(timed.select("time").distinct())  # few: the steps of a time axis
        d = timed.hint("merge").join(static.crossJoin(times), [*on, "time"], "full")
    code = F.col("p").cast("double") + F.col("s") / 10
    if drop_zero:
        code = F.when((F.col("p") == 0) | (F.col("s") == 0), 0.0).otherwise(code)
    return d.select(*[k for k in KEYS if k in d.columns], "p", "s", code.alias("code"))


def _part(c: Column) -> Column:
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def combined_class_area(primary: Raster, secondary: Raster, area: Area = None, count_name: str = "area_hectares", drop_zero: bool = True, wide: bool = True, legends: tuple[Mapping[int, str] | None, Mapping[int, str] | None] | None = None, classes: list[tuple] | None = None) -> DataFrame:
    """Area by pair of classes; secondary is first brought to primary's grid (nearest).

    Long: [time,] primary, secondary, classification ("p.s"), count_name. Wide: a column "meaning - meaning" for each pair, codes where a legend lacks them, and total_area. drop_zero leaves out pairs with a 0; without it each such pair stays."""
    a = primary.select()
    b, _ = align(a, secondary.select(), area=False)
    both = combine_classes(a, b, drop_zero=False).where(F.col("p").isNotNull() & F.col("s").isNotNull())
    if drop_zero:
        both = both.where((F.col("p") != 0) & (F.col("s") != 0))
    keys = [k for k in ("time",) if k in both.columns]
    cells = prepared(Raster(both.drop("code"), a.grid), area)
    long = cells.groupBy(*keys, F.col("p").alias("primary"), F.col("s").alias("secondary")).agg(steady_sum(F.col("area")).alias(count_name))
    long = long.select(*keys, "primary", "secondary", F.concat_ws(".", _part(F.col("primary")), _part(F.col("secondary"))).alias(CLASS), count_name)
    if not wide:
        return long
    first, second = legends or (primary.legends.get(a.variables[0]), secondary.legends.get(b.variables[0]))
    pairs = classes or [tuple(x) for x in long.select("primary", "secondary").distinct().orderBy("primary", "secondary").collect()]
    names = {}
    whole = lambda c: int(c) if float(c).is_integer() else c
    for p, s in pairs:
        if not (drop_zero and 0 in (p, s)):
            names[f"{whole(p)}.{whole(s)}"] = f"{legend_names(first, [p], False)[p]} - {legend_names(second, [s], False)[s]}"
    return _wide(long, CLASS, keys, count_name, names)


def category_stats(category: Raster, values: Raster) -> DataFrame:
    """([time,] category, mean_value, std_value): mean and population standard deviation of the positive values on cells of each positive category, NULL for a category without any. values is brought to the category's grid (nearest), each time by itself."""
    a = category.select()
    b, _ = align(a, values.select(), area=False)
    left, right = a.pixels.withColumnRenamed(a.variables[0], "category"), b.pixels.withColumnRenamed(b.variables[0], "v")
    on = [k for k in KEYS if k in left.columns and k in right.columns]
    d = left.where(F.col("category") > 0).join(right, on, "left")
    v = F.when(F.col("v") > 0, F.col("v"))
    keys = [k for k in ("time",) if k in d.columns]
    return d.groupBy(*keys, F.col("category").cast("int").alias("category")).agg(F.avg(v).alias("mean_value"), F.stddev_pop(v).alias("std_value"))


def weighted_class_area(raster: Raster, mask: DataFrame, area: Area = True, count_name: str = "area_hectares", drop_zero: bool = True) -> DataFrame:
    """Long class areas with each cell weighted by mask's (yi, xi, proportion); cells that the mask lacks count nothing."""
    r = raster.select()
    p = prepared(r, area).join(mask.where(F.col("proportion") > 0), ["yi", "xi"])
    weighted = p.withColumn("area", F.col("area") * F.col("proportion")).drop("proportion")
    own = weighted.select(*r.keys, "area")
    return class_area(r, own, count_name=count_name, wide=False, drop_zero=drop_zero).where(F.col(count_name).isNotNull())
