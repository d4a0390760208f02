"""Row numbers and order statistics from value cells, without a job of their own.

``ROW_NUMBER() OVER (ORDER BY ...)`` and "the value at position k" need the
place of a row among all rows.  Both are answered in two levels here:

* edges: ``cells - 1`` approximate quantiles of a column, one aggregate row
  (a mergeable sketch), attached to the rows.  They split the values into
  cells that follow each other in value order; a value that fills several
  quantiles is a cell of its own;
* counts: rows per cell, one aggregate of at most ``cells`` cells, turned into
  running totals by a window over those few rows.

A position then lies in one cell, and only that cell's rows are sorted
(``order_statistics``, ``weighted_percentile_cont``); a row's number is its
cell's offset plus its number in the cell (``numbered``).  Edges only balance
the work: cells are counted exactly, so results are exact whatever the sketch
says.  Nothing runs or is written before the caller's action, and equal plans
below are shared by Spark's exchange reuse.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 128
STEP = 12           # edges below a value are counted in steps of so many, then one by one


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of ``row``, an aggregate of exactly one row.

    A broadcast hash join on a key that is 0 on both sides.  A scalar subquery
    would be copied, with all the plan below it, into every expression that
    uses it."""
    left = df.withColumn("_one", F.pmod(F.xxhash64(df.columns[0]), F.lit(1)))
    right = row.withColumn("_one", F.pmod(F.xxhash64(row.columns[0]), F.lit(1)))
    return left.join(F.broadcast(right), "_one").drop("_one")


def _marked(df: DataFrame, values: dict[str, Column], cells: int, edges_from: DataFrame | None = None) -> DataFrame:
    """``df`` with _marks, from one aggregate: per column its ``edges``, every
    ``STEP``-th of them (``steps``), and ``heavy``, the values that fill more than
    one quantile."""
    named = (df if edges_from is None else edges_from).select(*[v.alias(k) for k, v in values.items()])
    shares = ",".join(f"{k / cells}D" for k in range(1, cells))
    found = named.agg(*[F.expr(f"percentile_approx(`{k}`, array({shares}), {40 * cells})").alias(k) for k in values])
    # quantiles ascend, so a value that fills several stands next to itself
    found = found.select(*[F.coalesce(F.col(f.name), F.array().cast(f.dataType)).alias(f.name) for f in found.schema.fields])
    marks = [F.struct(F.array_distinct(k).alias("edges"), F.expr(f"filter(array_distinct(`{k}`), (e, i) -> (i + 1) % {STEP} = 0)").alias("steps"),
                      F.expr(f"array_distinct(filter(`{k}`, (e, i) -> get(`{k}`, i - 1) = e))").alias("heavy")).alias(k) for k in values]
    return with_row(df, found.select(F.struct(*marks).alias("_marks")))


def _cell(value: Column, name: str) -> Column:
    """Cells in value order: 2i below the i-th edge, 2i + 1 for a heavy value that is that edge."""
    mark = F.col("_marks")[name]
    steps = STEP * F.size(F.filter(mark["steps"], lambda e: e < value))
    place = steps + F.size(F.filter(F.slice(mark["edges"], steps + 1, F.lit(STEP)), lambda e: e < value))
    return 2 * place + F.array_contains(mark["heavy"], value).cast("int")


def _running(counts: DataFrame, keys: list[str], within: list[str], n: str) -> DataFrame:
    """``counts`` with _before: total of ``n`` over the cells before, per ``within``."""
    w = Window.partitionBy(*within).orderBy(*keys)      # at most one row a cell
    return counts.withColumn("_before", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(n))


def numbered(df: DataFrame, numbers: dict[str, tuple[Column, bool]], ties: list[str], cells: int = CELLS,
             edges_from: DataFrame | None = None) -> DataFrame:
    """``df`` with a row number for each entry of ``numbers``: name -> (value,
    nulls first), ascending by value and then by the columns ``ties`` (nulls
    first), which make the order total.

    Rows are shuffled once a number, by cell.  A heavy value and the nulls are
    split further by cells of the first tie column, so no value however frequent
    lands in one task.  ``edges_from``: a table of about the same values that is
    cheaper to read for the edges."""
    first_tie = F.col(ties[0])
    marked = _marked(df, {**{k: v for k, (v, _) in numbers.items()}, "_tie": first_tie}, cells, edges_from)
    names = list(numbers)

    def place(k: str) -> list[Column]:
        value, nulls_first = numbers[k]
        alone = value.isNull() | F.array_contains(F.col("_marks")[k]["heavy"], value)
        sub = F.when(first_tie.isNull(), F.lit(-1)).otherwise(_cell(first_tie, "_tie"))
        null_cell = F.lit(-1) if nulls_first else F.lit(2 * cells + 1)
        return [F.when(value.isNull(), null_cell).otherwise(_cell(value, k)).alias("_cell"),
                F.when(alone, sub).otherwise(F.lit(-2)).alias("_sub")]

    # the counts read every column, so that they need the same shuffles below as
    # the numbered rows and Spark computes those once
    every = marked.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_m"), *place(k)) for i, k in enumerate(names)])).alias("_p"),
                          F.xxhash64(*df.columns).alias("_read"))
    counts = (every.groupBy("_p._m", "_p._cell", "_p._sub").agg(F.count(F.lit(1)).alias("_n"), F.max("_read").alias("_read"))
              .filter(F.col("_read").isNotNull()).drop("_read"))
    offsets = _running(counts, ["_cell", "_sub"], ["_m"], "_n").select(F.struct("_m", "_cell", "_sub").alias("_key"), "_before")
    offsets = F.broadcast(offsets)                    # a row a cell; one table for all numbers, computed once
    out = marked.select(*df.columns, *[F.struct(F.lit(i).alias("_m"), *place(k)).alias(f"_p{i}") for i, k in enumerate(names)])
    for i, k in enumerate(names):
        order = [numbers[k][0].asc(), *[F.col(t).asc_nulls_first() for t in ties]]
        so_far = Window.partitionBy(f"_p{i}").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        local = F.count(F.lit(1)).over(so_far)
        out = (out.withColumn("_local", local).join(offsets, F.col(f"_p{i}") == F.col("_key"))
               .withColumn(k, (F.col("_before") + F.col("_local")).cast("long"))
               .drop("_key", "_before", "_local", f"_p{i}"))
    return out


def order_statistics(df: DataFrame, values: dict[str, tuple[Column, bool]], quantiles, cells: int = CELLS) -> DataFrame:
    """One row: column ``{name}{i}`` is the value at row ``round(q_i * N)``
    (half away from zero, N all rows) of the ascending order of ``values[name]``
    = (value as double, nulls first); null where that row holds a null or does
    not exist.  Several columns and quantiles share both passes."""
    names = list(values)
    marked = _marked(df, {k: v for k, (v, _) in values.items()}, cells)

    def entry(i: int, k: str) -> Column:
        value, nulls_first = values[k]
        null_cell = F.lit(-1) if nulls_first else F.lit(2 * cells + 1)
        return F.struct(F.lit(i).alias("_m"), F.when(value.isNull(), null_cell).otherwise(_cell(value, k)).alias("_cell"),
                        value.alias("_v"))

    long = marked.select(F.explode(F.array(*[entry(i, k) for i, k in enumerate(names)])).alias("_p")).select("_p.*")
    counts = long.groupBy("_m", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    placed = _running(counts, ["_cell"], ["_m"], "_n").withColumn("_all", F.sum("_n").over(Window.partitionBy("_m")))
    targets = F.explode(F.array(*[F.struct(F.lit(j).alias("_q"), F.floor(F.lit(float(q)) * F.col("_all") + F.lit(0.5)).alias("_k"))
                                  for j, q in enumerate(quantiles)]))
    wanted = (placed.select("_m", "_cell", "_before", "_n", targets.alias("_t")).select("*", "_t.*")
              .filter((F.col("_k") > F.col("_before")) & (F.col("_k") <= F.col("_before") + F.col("_n")))
              .select("_m", "_cell", "_q", (F.col("_k") - F.col("_before")).alias("_rank")))
    # a row a quantile and column
    hist = (long.join(F.broadcast(wanted), ["_m", "_cell"]).groupBy("_m", "_q", "_rank", "_v").agg(F.count(F.lit(1)).alias("_n")))
    found = _running(hist, ["_v"], ["_m", "_q"], "_n").filter(
        (F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_n")))
    picked = [F.max(F.when((F.col("_m") == i) & (F.col("_q") == j), F.col("_v"))).alias(f"{k}{j}")
              for i, k in enumerate(names) for j in range(len(quantiles))]
    return found.agg(*picked)


def weighted_percentile_cont(df: DataFrame, value: str, weight: str, q: float = 0.5, out: str = "value",
                             cells: int = CELLS) -> DataFrame:
    """One-row DataFrame: PERCENTILE_CONT(q) of ``value`` where each row counts
    ``weight`` times (NULL values skipped).

    The values are first reduced to a histogram (one row per distinct value,
    map-side combined); only the cells that hold the one or two interpolation
    points are sorted."""
    hist = (df.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
            .groupBy(F.col(value).alias("_v")).agg(F.sum(weight).cast("long").alias("_w")))
    celled = _marked(hist, {"_v": F.col("_v")}, cells).select("_v", "_w", _cell(F.col("_v"), "_v").alias("_cell"))
    totals = celled.groupBy("_cell").agg(F.sum("_w").alias("_total"))
    placed = _running(totals, ["_cell"], [], "_total").withColumn("_all", F.sum("_total").over(Window.partitionBy()))
    rank = (F.col("_all") - 1) * F.lit(float(q))
    ends = [F.floor(rank), F.ceil(rank)]
    hit = reduce(lambda a, b: a | b, [(e >= F.col("_before")) & (e < F.col("_before") + F.col("_total")) for e in ends])
    wanted = placed.filter(hit).select("_cell", F.col("_before").alias("_offset"), F.floor(rank).alias("_lo"), F.ceil(rank).alias("_hi"),
                                       (rank - F.floor(rank)).alias("_frac"))
    near = _running(celled.join(F.broadcast(wanted), "_cell"), ["_v"], ["_cell"], "_w")     # at most two cells
    start = F.col("_offset") + F.col("_before")

    def at(end: str) -> Column:
        return F.max(F.when((F.col(end) >= start) & (F.col(end) < start + F.col("_w")), F.col("_v"))).cast("double")

    return near.agg(at("_lo").alias("_vlo"), at("_hi").alias("_vhi"), F.max("_frac").alias("_frac")).select(
        (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias(out))
