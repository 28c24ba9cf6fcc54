"""Exact quantiles that never gather one column, or one group, into one task.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation
buffer, which a continuous column at cluster scale does not fit. Here a quantile
is located by counting, whatever the size of the input.

Without groups, in two scans:

1. a KLL sketch of each column (Spark's built-in one), beside its count, extremes
   and moments. It gives a band of values around each wanted rank, of about one
   percent of the rows. The band is 13 standard deviations of the sketch's error
   wide; should a rank lie outside all the same, the query fails, it is never wrong.
2. values inside a band are counted one by one, those between bands together, both
   with map-side combining. Bands are cut at the quantiles of the sketch and then
   in equal steps, so a band is spread over many tasks; the totals of the steps (a
   fixed number for each wanted quantile) show which one holds the rank, and only
   its values are put in order.

The sketches are a job of their own, run when the quantiles are asked for; what comes
to the driver is a few numbers per column and wanted quantile. They enter the second
scan as literals.

Per group, in one scan: equal values are counted once per (group, bucket), the
bucket totals show which bucket holds the rank, the bucket is cut into equal steps
between its lowest and highest value, and only the values of the steps that hold a
rank are put in order. A large group is thus split over its buckets and steps.

No value is dropped and the result is exact. ``method="sketch"`` stops at the sketch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import quoted

_SKETCH_SIZE = 4096  # parameter k of the sketch; its rank error is below 0.0004 (one deviation)
_REACH = 0.005  # half the width of a band, as a share of the rows
_CUTS = 8  # parts of a band between quantiles of the sketch
_STEPS = 128  # equal steps of such a part
_STEPS_PER_OCTAVE = 256
_FINE_STEPS = 1 << 12
_OCTAVE_OFFSET = 1100  # lifts the smallest exponent of a double (-1074) above zero


@dataclass(frozen=True)
class Quantile:
    """One wanted quantile: ``alias`` = value at ``prob`` of ``value``."""

    alias: str
    value: Column
    prob: float


def aggregate_with_quantiles(
    df: DataFrame,
    plain: dict[str, Column],
    quantiles: list[Quantile],
    by: list[str] | None = None,
    method: str = "counting",
) -> DataFrame:
    """Aggregates and exact quantiles, one row in all or one per ``by`` group.

    ``method="builtin"`` asks for Spark's ``percentile`` instead of counting; it
    holds the values of a group in one buffer. ``method="sketch"`` gives values whose
    rank is right to about a thousandth of the rows, from one scan.
    """
    if method not in ("counting", "builtin", "sketch"):
        raise ValueError(f"unknown method {method!r}")
    names = list(by or [])
    by = [f"_g{i}" for i in range(len(names))]
    work = df.select("*", *[quoted(n).alias(g) for n, g in zip(names, by, strict=True)])
    plain_cols = [c.alias(a) for a, c in plain.items()]
    if method != "counting" or not quantiles:
        parts = _builtin(quantiles) if method == "builtin" else _sketched(quantiles)
        out = work.groupBy(*by).agg(*plain_cols, *parts)
        out = out.select(*by, *[quoted(a) for a in plain], *_one_by_one(quantiles))
    elif by:
        out = _per_group(work, plain_cols, quantiles, by)
    else:
        out = _in_all(work, plain_cols, quantiles)
    return out.select(
        *[F.col(g).alias(n) for n, g in zip(names, by, strict=True)],
        *[quoted(a) for a in (*plain, *[q.alias for q in quantiles])],
    )


def _builtin(quantiles: list[Quantile]) -> list[Column]:
    """One buffer per column for all its quantiles."""
    lanes = _lanes(quantiles)
    return [
        F.percentile(v, F.array(*[F.lit(float(p)) for _, p in wanted])).alias(f"_p{i}")
        for i, (v, wanted) in enumerate(lanes)
    ]


def _sketched(quantiles: list[Quantile]) -> list[Column]:
    """The quantiles that one sketch per column gives."""
    out = []
    for i, (v, wanted) in enumerate(_lanes(quantiles)):
        probs = F.array(*[F.lit(float(p)) for _, p in wanted])
        out.append(_from_sketch(sketch_of(v), probs).alias(f"_p{i}"))
    return out


def sketch_of(v: Column) -> Column:
    """NaN is the greatest value, like in Spark's order, and the sketch takes no NaN."""
    v = v + F.lit(0.0)
    return F.kll_sketch_agg_double(F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v), _SKETCH_SIZE)


def _from_sketch(sketch: Column, probs: Column) -> Column:
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, probs))


def _one_by_one(quantiles: list[Quantile]) -> list[Column]:
    place = {
        target: F.col(f"_p{i}")[k]
        for i, (_, wanted) in enumerate(_lanes(quantiles))
        for k, (target, _) in enumerate(wanted)
    }
    return [place[i].alias(q.alias) for i, q in enumerate(quantiles)]


def _lanes(quantiles: list[Quantile]) -> list[tuple[Column, list[tuple[int, float]]]]:
    """Different columns, each with its (number of the quantile, probability)."""
    lanes: dict[int, tuple[Column, list[tuple[int, float]]]] = {}
    for i, q in enumerate(quantiles):
        lanes.setdefault(id(q.value), (q.value, []))[1].append((i, q.prob))
    return list(lanes.values())


def _pivot(quantiles: list[Quantile]) -> list[Column]:
    """The value of each quantile from rows (_target, _side, _frac, _v)."""
    out = []
    for i, q in enumerate(quantiles):
        low, high = (
            F.max(F.when((F.col("_target") == i) & (F.col("_side") == side), F.col("_v"))) for side in (0, 1)
        )
        frac = F.max(F.when(F.col("_target") == i, F.col("_frac")))
        value = F.when(low == high, low).otherwise(low * (F.lit(1.0) - frac) + high * frac)
        out.append(value.alias(q.alias))
    return out


def _coarse_bucket(v: Column) -> Column:
    """A whole number, kept as double, that never falls as ``v`` grows.

    Zero has no logarithm (NULL) and gets bucket 0; infinities and NaN are
    buckets of their own, ordered like the values. Short on purpose: the passes
    evaluate it for every value, inside generated code that must stay small
    enough to be compiled.
    """
    size = F.rint(F.log2(F.abs(v)) * float(_STEPS_PER_OCTAVE)) + float(
        _OCTAVE_OFFSET * _STEPS_PER_OCTAVE
    )
    return F.coalesce(F.signum(v) * size, F.lit(0.0))


def _values(df: DataFrame, quantiles: list[Quantile], by: list[str]) -> DataFrame:
    """(by..., _lane, _v, _coarse): a row per value, quantiles of a column sharing a lane."""
    lanes = [
        F.struct(F.lit(i).alias("lane"), (v + F.lit(0.0)).alias("v"))
        for i, (v, _) in enumerate(_lanes(quantiles))
    ]
    rows = df.select(*by, F.explode(F.array(*lanes)).alias("_e"))
    rows = rows.select(*by, F.col("_e.lane").alias("_lane"), F.col("_e.v").alias("_v"))
    return rows.where(F.col("_v").isNotNull()).withColumn("_coarse", _coarse_bucket(F.col("_v")))


def _wanted(counts: DataFrame, quantiles: list[Quantile], by: list[str], place: list[str]) -> DataFrame:
    """``counts`` with ``_want``: the ranks that each place holds, as (target, side, rank, frac).

    ``counts`` has (by..., _lane, place..., _n); side 0 and 1 are the values
    below and above the quantile, and rank is the rank inside the place.
    """
    whole = Window.partitionBy(*by, "_lane")
    upto = whole.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    probs = F.array(
        *[
            F.array(
                *[F.struct(F.lit(i).alias("target"), F.lit(float(p)).alias("prob")) for i, p in wanted]
            )
            for _, wanted in _lanes(quantiles)
        ]
    )

    def ranks(w: Column) -> Column:
        position = w["prob"] * (F.col("_total") - 1).cast("double")
        return F.array(
            *[
                F.struct(
                    w["target"].alias("target"),
                    F.lit(side).alias("side"),
                    rounded(position).cast("bigint").alias("rank"),
                    (position - F.floor(position)).alias("frac"),
                )
                for side, rounded in ((0, F.floor), (1, F.ceil))
            ]
        )

    rows = counts.withColumn("_total", F.sum("_n").over(whole)).withColumn("_end", F.sum("_n").over(upto))
    rows = rows.withColumn("_want", F.flatten(F.transform(F.get(probs, F.col("_lane")), ranks)))
    return _inside(rows)


def _inside(rows: DataFrame) -> DataFrame:
    """Keep the wanted ranks that fall into a row's own share [_end - _n, _end), counted from its begin."""
    begin, end = F.col("_end") - F.col("_n"), F.col("_end")
    own = F.transform(
        F.filter("_want", lambda w: (w["rank"] >= begin) & (w["rank"] < end)),
        lambda w: w.withField("rank", w["rank"] - begin),
    )
    return rows.withColumn("_want", own).where(F.size("_want") > 0)


def _in_order(rows: DataFrame, place: list[str]) -> DataFrame:
    """Of counted values with the ranks their place holds, those that a rank falls on."""
    upto = Window.partitionBy(*place).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return _inside(rows.withColumn("_end", F.sum("_n").over(upto)))


def _found(rows: DataFrame, quantiles: list[Quantile], by: list[str]) -> DataFrame:
    """One row per group from values that hold wanted ranks."""
    each = rows.select(*by, "_v", F.explode("_want").alias("_w"))
    each = each.select(
        *by, "_v", F.col("_w.target").alias("_target"), F.col("_w.side").alias("_side"), F.col("_w.frac").alias("_frac")
    )
    return each.groupBy(*by).agg(*_pivot(quantiles))


def _same(by: list[str], keys: list[str]) -> list[Column]:
    return [
        F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) if k in by else F.col(f"l.{k}") == F.col(f"r.{k}")
        for k in keys
    ]


def _equal_step(v: Column, low: Column, high: Column, steps: int) -> Column:
    """Number of the step, of ``steps`` equal ones between ``low`` and ``high``; 0 where they are not finite."""
    step = F.floor(F.try_divide(v - low, high - low) * float(steps))
    return F.coalesce(F.when(step < steps, step).when(step >= steps, F.lit(steps - 1)), F.lit(0)).cast("int")


def _per_group(df: DataFrame, plain: list[Column], quantiles: list[Quantile], by: list[str]) -> DataFrame:
    place = [*by, "_lane", "_coarse"]
    counted = _values(df, quantiles, by).groupBy(*place, "_v").agg(F.count(F.lit(1)).alias("_n"))
    buckets = counted.groupBy(*place).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    chosen = _wanted(buckets, quantiles, by, ["_coarse"]).select(*place, "_want", "_lo", "_hi")
    rows = counted.alias("l").join(chosen.alias("r"), _same(by, place)).select("l.*", "r._want", "r._lo", "r._hi")
    rows = rows.withColumn("_step", _equal_step(F.col("_v"), F.col("_lo"), F.col("_hi"), _FINE_STEPS))
    steps = rows.groupBy(*place, "_step").agg(F.sum("_n").alias("_n"), F.first("_want").alias("_want"))
    upto = Window.partitionBy(*place).orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    steps = _inside(steps.withColumn("_end", F.sum("_n").over(upto))).select(*place, "_step", "_want")
    rows = rows.drop("_want").alias("l").join(steps.alias("r"), _same(by, [*place, "_step"]))
    rows = _in_order(rows.select("l.*", "r._want"), [*place, "_step"])
    located = _found(rows, quantiles, by).alias("p")
    # The plain side holds every group; a group without values has no rank to find.
    base = df.groupBy(*by).agg(*plain, F.lit(1).alias("_one")).alias("b")
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"p.{k}")) for k in by]
    return base.join(located, same, "left").select("b.*", *[f"p.`{q.alias}`" for q in quantiles]).drop("_one")


# --------------------------------------------------------------------------
# without groups: sketch, then count around the ranks
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class State:
    """What one scan tells of a column: counts, extremes, moments, and for each wanted
    probability the cuts of the band around it."""

    n: int = 0
    raw: int = 0
    minimum: float | None = None
    maximum: float | None = None
    mean: float | None = None
    stddev: float | None = None
    variance: float | None = None
    std_pop: float | None = None
    bands: tuple[tuple[float, ...], ...] = ()


_MOMENTS = ("minimum", "maximum", "mean", "stddev", "variance", "std_pop")


def _ranks(prob: float) -> list[float]:
    return [prob + _REACH * (2 * c / _CUTS - 1) for c in range(_CUTS + 1)]


def _band(prob: float, n: int, cuts: list[float]) -> tuple[float, ...]:
    """Values around a rank, cut at quantiles of the sketch; all values where they are few."""
    ranks, ends = _ranks(prob), (float("-inf"), float("inf"))
    if n <= _SKETCH_SIZE:
        return ends
    return (
        ends[0] if ranks[0] <= 0 else cuts[0],
        *cuts[1:-1],
        ends[1] if ranks[-1] >= 1 else cuts[-1],
    )


def states(df: DataFrame, lanes: list[tuple[Column, list[float], Column | None]]) -> list[State]:
    """A job: the state of every lane, which is (value, probabilities, raw column)."""
    entries = [
        F.struct(
            F.lit(i).alias("lane"),
            (v + F.lit(0.0)).alias("v"),
            (v if raw is None else raw).isNotNull().cast("int").alias("raw"),
        )
        for i, (v, _, raw) in enumerate(lanes)
    ]
    v = F.col("v")
    state = df.select(F.inline(F.array(*entries))).groupBy("lane").agg(
        F.count(v).alias("n"), F.sum("raw").alias("raw"), F.min(v).alias("minimum"), F.max(v).alias("maximum"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("stddev"), F.var_samp(v).alias("variance"),
        F.stddev_pop(v).alias("std_pop"), sketch_of(v).alias("sketch"),
    )
    return read_states(state, [probs for _, probs, _ in lanes])


def read_states(state: DataFrame, wanted: list[list[float]]) -> list[State]:
    """A job: states from a row per lane with (lane, n, raw, moments, sketch); ``wanted``
    are the probabilities of each lane."""
    # Lanes mostly share their probabilities; a rank must be a literal of the plan.
    kinds: dict[tuple[float, ...], list[int]] = {}
    for i, probs in enumerate(wanted):
        kinds.setdefault(tuple(probs), []).append(i)
    cuts = F.lit(None).cast("array<double>")
    for probs, members in kinds.items():
        ranks = [F.lit(min(max(r, 0.0), 1.0)) for p in probs for r in _ranks(p)]
        if ranks:
            own = _from_sketch(F.col("sketch"), F.array(*ranks))
            cuts = F.when(F.col("lane").isin(members), own).otherwise(cuts)
    out = [State()] * len(wanted)
    for row in state.withColumn("cuts", cuts).drop("sketch").collect():  # one row per lane
        probs, size = wanted[row["lane"]], _CUTS + 1
        bands = tuple(
            _band(p, row["n"], row["cuts"][k * size : (k + 1) * size]) for k, p in enumerate(probs) if row["n"]
        )
        out[row["lane"]] = State(row["n"], row["raw"], *[row[m] for m in _MOMENTS], bands)
    return out


def _cell(v: Column, bands: tuple[tuple[float, ...], ...]) -> Column:
    """Where a value is among the bands: odd numbers inside a band, even ones between."""
    cell = F.when(F.isnan(v), F.lit(2 * len(bands) + 1))
    for t, band in enumerate(bands):
        cell = cell.when(v < band[0], F.lit(2 * t)).when(v <= band[-1], F.lit(2 * t + 1))
    return cell.otherwise(F.lit(2 * len(bands)))


def _located(df: DataFrame, quantiles: list[Quantile], found: list[State]) -> DataFrame:
    """One row of quantiles, from one scan that counts around the ranks."""
    entries = []
    lanes = _lanes(quantiles)
    held = df.select(*[(v + F.lit(0.0)).alias(f"_v{i}") for i, (v, _) in enumerate(lanes)])
    held = held.select("*", *[_cell(F.col(f"_v{i}"), s.bands).alias(f"_c{i}") for i, s in enumerate(found)])
    for i in range(len(lanes)):
        v, cell = F.col(f"_v{i}"), F.col(f"_c{i}")
        entries.append(
            F.struct(
                F.lit(i).alias("_lane"),
                F.when(v.isNotNull(), cell).otherwise(F.lit(-1)).alias("_cell"),
                F.when(cell % 2 == 1, v).alias("_v"),
            )
        )
    # No nullable key below: filters that a join would infer from one differ between the
    # two uses of the counts, and the scan would not be shared.
    cells = held.select(F.inline(F.array(*entries))).where(F.col("_cell") >= 0)
    counted = cells.groupBy("_lane", "_cell", "_v").agg(F.count(F.lit(1)).alias("_n"))
    return _ranked(counted, quantiles, found)


def quantiles_of_counts(counts: DataFrame, probs: list[float], found: list[State]) -> DataFrame:
    """(lane, quantiles) from rows (lane, v, n): how often each value of a column occurs."""
    lane, v = F.col("lane"), F.col("v") + F.lit(0.0)
    cell = F.lit(-1)
    for i, s in enumerate(found):
        cell = F.when(lane == i, _cell(v, s.bands)).otherwise(cell)
    rows = counts.where(F.col("v").isNotNull()).select(lane.alias("_lane"), cell.alias("_cell"), v.alias("_v"), "n")
    inside = F.when(F.col("_cell") % 2 == 1, F.col("_v")).alias("_v")
    rows = rows.select("_lane", "_cell", inside, "n").where(F.col("_cell") >= 0)
    counted = rows.groupBy("_lane", "_cell", "_v").agg(F.sum("n").alias("_n"))
    wanted = [Quantile(f"_q{i}_{k}", c, p) for i, c in _lane_columns(found) for k, p in enumerate(probs)]
    row = _ranked(counted, wanted, found)
    each = [
        F.struct(F.lit(i).alias("lane"), F.array(*[F.col(f"_q{i}_{k}") for k in range(len(probs))]).alias("quantiles"))
        for i in range(len(found))
    ]
    return row.select(F.inline(F.array(*each)))


def _lane_columns(found: list[State]) -> list[tuple[int, Column]]:
    """A column object of its own for each lane; quantiles with the same one share a lane."""
    return [(i, F.lit(i)) for i in range(len(found))]


def _ranked(counted: DataFrame, quantiles: list[Quantile], found: list[State]) -> DataFrame:
    """One row of quantiles from (_lane, _cell, _v, _n): counts of the values inside the
    bands, and of all values between them."""
    none = F.lit(None).cast("array<double>")
    every = F.array(
        *[F.array(none, *[F.array(*map(F.lit, band)) for band in s.bands]) for s in found]
    )
    own = F.get(F.get(every, F.col("_lane")), F.floor((F.col("_cell") + 1) / 2).cast("int"))
    counted = counted.withColumn("_cuts", F.when(F.col("_cell") % 2 == 1, own))
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_v"))), F.lit(0))
    counted = counted.withColumn("_part", part)
    low, high = F.get("_cuts", F.col("_part") - 1), F.get("_cuts", F.col("_part"))
    counted = counted.withColumn("_step", _equal_step(F.col("_v"), low, high, _STEPS)).drop("_cuts")
    place = ["_cell", "_part", "_step"]
    totals = counted.groupBy("_lane", *place).agg(F.sum("_n").alias("_n"))
    # At most two rows for each wanted quantile.
    chosen = _wanted(totals, quantiles, [], place).select("_lane", *place, "_want")
    missed = F.raise_error(F.lit("a rank lies outside the band of its sketch; run the query again"))
    chosen = chosen.withColumn("_want", F.when(F.col("_cell") % 2 == 1, F.col("_want")).otherwise(missed))
    rows = counted.join(F.broadcast(chosen), ["_lane", *place])
    return _found(_in_order(rows, ["_lane", *place]), quantiles, [])


def _in_all(df: DataFrame, plain: list[Column], quantiles: list[Quantile]) -> DataFrame:
    lanes = [(v, sorted({p for _, p in wanted}), None) for v, wanted in _lanes(quantiles)]
    row = _located(df, quantiles, states(df, lanes))
    if not plain:
        return row
    return df.agg(*plain).withColumn("_q", row.select(F.struct("*")).scalar()).select("*", "_q.*")


def summaries(
    df: DataFrame, values: list[tuple[Column, Column | None]], probs: list[float], method: str = "counting"
) -> DataFrame:
    """(lane, count, raw, minimum, maximum, mean, stddev, variance, std_pop, quantiles).

    One row per (value, raw column) of ``values``: aggregates of the value, ``raw`` the
    non-null cells of the raw column (of the value, if it is None), ``quantiles`` at
    ``probs``. Two scans in all, as moments and sketches come from the same one.
    """
    if method not in ("counting", "builtin", "sketch"):
        raise ValueError(f"unknown method {method!r}")
    wanted = [Quantile(f"_q{i}_{k}", v, p) for i, (v, _) in enumerate(values) for k, p in enumerate(probs)]
    parts: list[dict[str, Column]] = []
    if method == "counting":
        found = states(df, [(v, sorted(set(probs)), raw) for v, raw in values])
        row = _located(df, wanted, found)
        for s in found:
            parts.append({"n": F.lit(s.n).cast("bigint"), "raw": F.lit(s.raw).cast("bigint")})
            parts[-1] |= {m: F.lit(getattr(s, m)).cast("double") for m in _MOMENTS}
    else:
        plain: dict[str, Column] = {}
        for i, (v, raw) in enumerate(values):
            each = {
                "n": F.count(v), "raw": F.count(v if raw is None else raw), "minimum": F.min(v), "maximum": F.max(v),
                "mean": F.avg(v), "stddev": F.stddev_samp(v), "variance": F.var_samp(v), "std_pop": F.stddev_pop(v),
            }
            plain |= {f"_{name}{i}": c for name, c in each.items()}
            parts.append({name: F.col(f"_{name}{i}") for name in each})
        row = aggregate_with_quantiles(df, plain, wanted, method=method)
    rows = [
        F.struct(
            F.lit(i).alias("lane"),
            part["n"].alias("count"),
            *[part[name].alias(name) for name in ("raw", *_MOMENTS)],
            F.array(*[F.col(f"_q{i}_{k}") for k in range(len(probs))]).alias("quantiles"),
        )
        for i, part in enumerate(parts)
    ]
    return row.select(F.inline(F.array(*rows)))
