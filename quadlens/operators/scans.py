"""Ordered scans of strips of any length: rows are dealt by ranges of (strip, order), scanned range by range, and what a
range needs from the ones beside it is carried over in a small table.

A strip that lies in one range needs nothing carried. Of n ranges at most n - 1 cuts fall inside strips, so the table of
carried values has at most 2n rows, whatever the number of strips and the length of the longest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlens.operators.graph import cut


class Ranged:
    """rows dealt by ranges of (by, order): `rows` has _part, and windows of `within` never leave a range's piece of a strip."""

    def __init__(self, rows: DataFrame, by: list[str], order: list[str], ranges: int | None = None):
        self.by, self.order = by, order
        dealt = rows.repartitionByRange(ranges, *by, *order) if ranges else rows.repartitionByRange(*by, *order)
        self.rows = cut(dealt.withColumn("_part", F.spark_partition_id()))
        pieces = self.rows.groupBy("_part", *by).count()
        pieces = pieces.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where("_n > 1")
        self.pieces = cut(pieces.select(*[F.col(c).alias(f"_p_{c}") for c in ("_part", *by)]))  # strips that ranges cut: 2n pieces

    def within(self) -> Window:
        return Window.partitionBy("_part", *self.by).orderBy(*self.order)

    def carried(self, rows: DataFrame, ends: list[Column], carry: list[Column]) -> DataFrame:
        """rows with the columns `carry`, windows (over `across`) of the aggregates `ends` of the pieces of cut strips; null in other strips."""
        some = rows.join(F.broadcast(self.pieces), self._same("_p_"), "left_semi")
        table = cut(some.groupBy("_part", *self.by).agg(*ends).select("_part", *self.by, *carry))
        table = table.withColumnsRenamed({c: f"_c_{c}" for c in ("_part", *self.by)})
        return rows.join(F.broadcast(table), self._same("_c_"), "left").drop(*[f"_c_{c}" for c in ("_part", *self.by)])

    def _same(self, prefix: str) -> Column:
        same = F.col("_part") == F.col(f"{prefix}_part")
        for c in self.by:
            same = same & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
        return same

    def before(self, value: str, f=F.last) -> Column:
        """The last known value of the pieces before (or, with F.sum, their total)."""
        w = Window.partitionBy(*self.by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        return (f(value) if f is F.sum else f(value, True)).over(w)

    def after(self, value: str) -> Column:
        """The first known value of the pieces behind."""
        return F.first(value, True).over(Window.partitionBy(*self.by).orderBy("_part").rowsBetween(1, Window.unboundedFollowing))


def running_total(rows: DataFrame, by: list[str], order: list[str], previous: dict[str, Column], amount: Column, name: str, ranges: int | None = None) -> DataFrame:
    """rows with name, the running total of `amount` along each strip. previous: columns whose value in the row before amount may use, as
    names of the values there."""
    r = Ranged(rows, by, order, ranges)
    values = {f"_v_{k}": v for k, v in previous.items()}
    v = r.rows.withColumns(values) if values else r.rows
    if previous:
        # the row just before a piece is the last of the piece ahead of it
        last = [F.max_by(F.struct(f"_v_{k}"), F.struct(*order)).alias(f"_e_{k}") for k in previous]
        back = Window.partitionBy(*by).orderBy("_part")
        v = r.carried(v, last, [F.lag(f"_e_{k}").over(back).alias(f"_b_{k}") for k in previous])
        w = r.within()
        first = F.row_number().over(w) == 1
        v = v.withColumns({k: F.when(first, F.col(f"_b_{k}._v_{k}")).otherwise(F.lag(f"_v_{k}").over(w)) for k in previous}).drop(*[f"_b_{k}" for k in previous], *values)
    v = cut(v.withColumn("_amount", amount))
    v = r.carried(v, [F.sum("_amount").alias("_s")], [r.before("_s", F.sum).alias("_ahead")])
    own = F.sum("_amount").over(r.within().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return v.withColumn(name, F.coalesce("_ahead", F.lit(0.0)) + own).drop("_ahead", "_amount", "_part", *previous)


def interpolated(asked: DataFrame, known: DataFrame, by: list[str], at: str, value: str, ranges: int | None = None) -> DataFrame:
    """asked (by, at and more) with value, that of known (by, at, value; one row a place) interpolated linearly at each row's place:
    constant beyond the ends, null in strips where nothing is known. Both sides may be of any size."""
    rest = [c for c in asked.columns if c not in (*by, at)]
    place = F.col(at).cast("double")
    a = asked.select(*by, place.alias("_at"), F.lit(1).alias("_kind"), F.struct(*asked.columns).alias("_row"), F.lit(None).cast("struct<t:double,v:double>").alias("_known"))
    given = F.struct(place.alias("t"), F.col(value).cast("double").alias("v"))
    k = known.where(F.col(value).isNotNull() & F.col(at).isNotNull()).select(*by, place.alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), given.alias("_known"))
    r = Ranged(a.unionByName(k), by, ["_at", "_kind"], ranges)
    order = F.struct("_at", "_kind")
    known_at = F.when(F.col("_known").isNotNull(), order)
    v = r.carried(r.rows, [F.max_by("_known", known_at).alias("_l"), F.min_by("_known", known_at).alias("_f")], [r.before("_l").alias("_before"), r.after("_f").alias("_after")])
    w = r.within()
    low = F.coalesce(F.last("_known", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_before")
    high = F.coalesce(F.first("_known", True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)), "_after")
    v = v.withColumns({"_lo": low, "_hi": high}).where("_kind = 1")
    t = F.try_divide(F.col("_at") - F.col("_lo.t"), F.col("_hi.t") - F.col("_lo.t"))
    between = F.col("_lo.v") + t * (F.col("_hi.v") - F.col("_lo.v"))
    found = F.when(F.col("_lo").isNull(), F.col("_hi.v")).when(F.col("_hi").isNull(), F.col("_lo.v")).otherwise(between)
    out = F.when(F.col("_at").isNotNull(), found)
    return v.select(*[F.col(f"_row.{c}").alias(c) for c in (*by, at, *rest)], out.alias(value))
