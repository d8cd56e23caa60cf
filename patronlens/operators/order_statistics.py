"""Exact order statistics of several orders at once, without moving a row.

A window without a partition would sort everything in one task, and the built-in exact
percentile gathers all distinct values in one. Here the wanted places of all orders are
narrowed together: a scan counts the rows in BUCKETS slices of each open range of values
(then, among equal values, of tie-breaking ids), and each place goes on in the slice that
holds it, until that slice has one value. Counts are combined in each task, so a scan
sends at most BUCKETS rows per open range and task, and no row is shuffled. Ranges of
values are cut evenly on a logarithmic scale, so a few scans are enough for skewed ones.
Tiles then follow from comparing each row with the first row of every tile.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


@dataclass(frozen=True)
class Order:
    """Rows by a value, then by a unique id; NULL is the largest value: last ascending, first descending."""

    value: str
    descending: bool = False
    tie: str | None = None

    @property
    def key(self) -> Column:
        """The value that ascends in this order; NaN counts as infinite."""
        value = F.nanvl(F.col(self.value).cast("double"), F.lit(float("inf"))) + F.lit(0.0)  # no negative zero
        return -value + F.lit(0.0) if self.descending else value


@dataclass
class _Place:
    """A wanted place: the rows still open are those with ``low <= key <= high``, then ``first <= tie <= last``."""

    order: int
    skip: int  # open rows before the place
    low: float | None = None  # None: the rows without a value
    high: float | None = None
    first: int | None = None
    last: int | None = None
    value_found: bool = False
    found: bool = False

    @property
    def range(self) -> tuple:
        return self.order, self.low, self.high, self.first, self.last, self.value_found


def _log_scale(value: Column) -> Column:
    """Ascends with the value and is finite for every one."""
    return F.signum(value) * F.least(F.log1p(F.abs(value)), F.lit(710.5))


def _slice_of(value: Column, low: float, high: float) -> Column:
    """The slice from 0 of a value in a range; every step ascends or stays, so slices are in order."""
    def even(x: Column, a: Column, b: Column) -> Column:
        return F.least(F.floor((x - a) / (b - a) * BUCKETS), F.lit(BUCKETS - 1))

    a, b = F.lit(low), F.lit(high)
    la, lb = _log_scale(a), _log_scale(b)
    return F.when(lb > la, even(_log_scale(value), la, lb)).otherwise(even(value, a, b)).cast("long")


def _tie_slice(tie: Column, first: int, last: int) -> Column:
    shift = max((last - first).bit_length() - BUCKETS.bit_length() + 2, 0)
    return F.shiftright(tie, shift) - F.lit(first >> shift)


def _open_rows(n: int, place: _Place, orders: list[Order]) -> Column:
    """What a row adds to the counts of a range: its slice, key and tie, or NULL."""
    order = orders[place.order]
    key, tie = order.key, F.col(order.tie).cast("long") if order.tie else F.lit(0).cast("long")
    value = F.col(order.value)
    if place.value_found:
        inside = value.isNull() if place.low is None else key == F.lit(place.low)
        if place.first is not None:
            inside = inside & tie.between(place.first, place.last)
            at = _tie_slice(tie, place.first, place.last)
        else:
            at = F.lit(0).cast("long")
    else:
        inside = key.between(F.lit(place.low), F.lit(place.high))
        at = _slice_of(key, place.low, place.high)
    return F.when(
        value.isNull() & inside if place.low is None else value.isNotNull() & inside,
        F.struct(F.lit(n).alias("range"), at.alias("slice"), key.alias("key"), tie.alias("tie")),
    )


def _narrow(df: DataFrame, orders: list[Order], open_places: list[_Place]) -> None:
    """One scan: every open place goes on in the slice that holds it."""
    ranges = list(dict.fromkeys(p.range for p in open_places))
    of_range = {r: next(p for p in open_places if p.range == r) for r in ranges}
    entries = [_open_rows(n, of_range[r], orders) for n, r in enumerate(ranges)]
    counted = (
        df.select(F.inline(F.array_compact(F.array(*entries))))
        .groupBy("range", "slice")
        .agg(
            F.count(F.lit(1)).alias("held"),
            F.min("key").alias("low"),
            F.max("key").alias("high"),
            F.min("tie").alias("first"),
            F.max("tie").alias("last"),
        )
        .collect()
    )
    slices: dict[int, list] = {}
    for row in sorted(counted, key=lambda r: (r["range"], r["slice"])):
        slices.setdefault(row["range"], []).append(row)
    for place in open_places:
        before = 0
        for row in slices[ranges.index(place.range)]:
            if place.skip < before + row["held"]:
                break
            before += row["held"]
        place.skip -= before
        _go_on(place, row, orders[place.order])


def _go_on(place: _Place, row, order: Order) -> None:
    """Keep the slice's rows only; the place is found where one row or, without a tie-breaker, one value is left."""
    if not place.value_found:
        place.low, place.high = row["low"], row["high"]
        place.value_found = row["low"] == row["high"]
        if not place.value_found:
            return
    place.first, place.last = row["first"], row["last"]
    if place.skip in (0, row["held"] - 1):  # the first or the last of its ties
        place.first = place.last = row["last"] if place.skip else row["first"]
    place.found = order.tie is None or place.first == place.last


def keys_at(df: DataFrame, orders: list[Order], places: list[list[int]]) -> list[list[tuple]]:
    """The (key, tie) of the rows at given places, counted from 0, of each order.

    ``key`` is None where the row has no value. ``df`` is scanned a few times, so pass a
    stored table.
    """
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(o.key if f is not F.count else F.col(o.value)).alias(f"{f.__name__}{n}") for n, o in enumerate(orders) for f in (F.count, F.min, F.max)],
    ).first()
    wanted = []
    for n, order in enumerate(orders):
        known, low, high = (totals[f"{f}{n}"] for f in ("count", "min", "max"))
        without = totals["rows"] - known
        for at in places[n]:
            if order.descending:
                empty, skip = at < without, at if at < without else at - without
            else:
                empty, skip = at >= known, at - known if at >= known else at
            if not 0 <= at < totals["rows"]:
                raise ValueError(f"place {at} of {totals['rows']} rows")
            place = _Place(n, skip) if empty else _Place(n, skip, low, high)
            place.value_found = empty or low == high
            place.found = place.value_found and order.tie is None
            wanted.append(place)
    while open_places := [p for p in wanted if not p.found]:
        _narrow(df, orders, open_places)
    found = iter([(p.low, p.first) for p in wanted])
    return [[next(found) for _ in of_order] for of_order in places]


def tile_starts(total: int, tiles: int) -> list[int]:
    """The places at which tiles 2, 3, ... of NTILE begin: the first tiles take the remainder."""
    size, larger = divmod(total, tiles)
    starts = [n * size + min(n, larger) for n in range(1, tiles)]
    return [s for s in starts if s < total]


def with_ntiles(df: DataFrame, scores: dict[str, tuple[str, bool]], tie: str, tiles: int = 5) -> DataFrame:
    """Add NTILE columns ``{name: (value column, descending)}``.

    NULLs rank as the largest value: last ascending, first descending. Equal values
    are ordered by ``tie``, a unique column of whole numbers. A row's tile is the number of
    tiles that begin at or before it. Pass a stored table.
    """
    total = df.count()
    orders = [Order(column, descending, tie) for column, descending in scores.values()]
    starts = keys_at(df, orders, [tile_starts(total, tiles)] * len(orders)) if total else [[] for _ in orders]
    columns = {name: _tile(order, keys).cast("int") for name, order, keys in zip(scores, orders, starts)}
    return df.select("*", *[c.alias(name) for name, c in columns.items()])


def _tile(order: Order, starts: list[tuple]) -> Column:
    value, tie = F.col(order.value), F.col(order.tie)

    def reached(key: float | None, first: int) -> Column:
        if key is None:
            empty = value.isNull() & (tie >= first)
            return empty | value.isNotNull() if order.descending else empty
        known = (order.key > F.lit(key)) | ((order.key == F.lit(key)) & (tie >= first))
        return F.coalesce(known, F.lit(not order.descending))

    return sum((reached(*s).cast("int") for s in starts), F.lit(1))


def quantiles(df: DataFrame, column: str, fractions: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation between neighbours; NULLs do not count.

    Pass a stored table.
    """
    known = df.select(F.col(column).cast("double").alias("value")).filter("value is not null")
    total = known.count()
    if total == 0:
        raise ValueError(f"no values in {column!r}")
    positions = [p * (total - 1) for p in fractions]
    wanted = sorted({f(p) for p in positions for f in (floor, ceil)})
    at = dict(zip(wanted, (key for key, _ in keys_at(known, [Order("value")], [wanted])[0])))
    return [at[floor(p)] + (at[ceil(p)] - at[floor(p)]) * (p - floor(p)) for p in positions]
