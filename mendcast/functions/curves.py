"""Closed-form gap curves over the nearest observed knots of a row.

``left`` and ``right`` hold the nearest observed knots per side in position order (see ``layout``); each
function is a column of the row's value at its own abscissa. ``let`` names a value that is used several
times, so that neither the plan nor the generated code repeats it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once per row and hands it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _left(i: int) -> Column:
    return F.get("left", F.size("left") - i)


def _right(i: int) -> Column:
    return F.get("right", F.lit(i - 1))


def axis_of(k: Column, axis: str) -> Column:
    return k[axis].cast("double")


def here(axis: str) -> Column:
    return F.col(axis).cast("double")


def _gap(a: Column, b: Column, axis: str) -> Column:
    return axis_of(b, axis) - axis_of(a, axis)


def _secant(a: Column, b: Column, axis: str) -> Column:
    return (b["value"] - a["value"]) / _gap(a, b, axis)


def _knots() -> Column:
    return F.struct(*[_left(i).alias(f"l{i}") for i in (1, 2, 3)], *[_right(i).alias(f"r{i}") for i in (1, 2, 3)])


def ffill() -> Column:
    return _left(1)["value"]


def bfill() -> Column:
    return _right(1)["value"]


def linear(axis: str) -> Column:
    """Straight line between the neighbours; leading gaps stay missing, trailing ones repeat the last value."""
    a, b = _left(1), _right(1)
    inner = a["value"] + _secant(a, b, axis) * (here(axis) - axis_of(a, axis))
    return F.when(a.isNull(), F.lit(None)).when(b.isNull(), a["value"]).otherwise(inner)


def linear_both() -> Column:
    """Line by position with both edges filled; a series without any value becomes 0."""
    return F.coalesce(linear("pos"), _right(1)["value"], F.lit(0.0))


def nearest(axis: str) -> Column:
    """Nearer neighbour, the left one on a tie; both edges stay missing."""
    a, b = _left(1), _right(1)
    to_left = here(axis) - axis_of(a, axis)
    to_right = axis_of(b, axis) - here(axis)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(to_left <= to_right, a["value"]).otherwise(b["value"]))


def _hermite(a: Column, b: Column, h: Column, da: Column, db: Column, axis: str) -> Column:
    """Cubic with the given end slopes, read off at the row."""
    def curve(t):
        return (
            (1 + 2 * t) * (1 - t) * (1 - t) * a["value"] + t * (1 - t) * (1 - t) * h * da
            + t * t * (3 - 2 * t) * b["value"] + t * t * (t - 1) * h * db
        )

    return let((here(axis) - axis_of(a, axis)) / h, curve)


def _pchip_inner(h0, h1, d0, d1):
    """Weighted harmonic mean of the secants, 0 where they change sign."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 <= 0, F.lit(0.0)).otherwise((w0 + w1) / (w0 / d0 + w1 / d1))


def _pchip_end(h0, h1, d0, d1):
    """Slope at an end knot from the two steps inwards; with a single step its secant."""
    def bounded(m):
        return (
            F.when(F.signum(m) != F.signum(d0), F.lit(0.0))
            .when((F.signum(d0) != F.signum(d1)) & (F.abs(m) > 3 * F.abs(d0)), 3 * d0)
            .otherwise(m)
        )

    return F.when(d1.isNull(), d0).otherwise(let(((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1), bounded))


def _steps(axis: str, **pairs: tuple[Column, Column]) -> Column:
    """Step widths ``h_name`` and secants ``d_name`` of the named knot pairs."""
    return F.struct(
        *[_gap(a, b, axis).alias(f"h_{n}") for n, (a, b) in pairs.items()],
        *[_secant(a, b, axis).alias(f"d_{n}") for n, (a, b) in pairs.items()],
    )


def pchip(axis: str) -> Column:
    """Monotone cubic Hermite; leading gaps stay missing, trailing ones follow the last piece."""
    def shape(k):
        def inner(s):
            da = F.when(s["d_a"].isNull(), _pchip_end(s["h_m"], s["h_b"], s["d_m"], s["d_b"])).otherwise(
                _pchip_inner(s["h_a"], s["h_m"], s["d_a"], s["d_m"]))
            db = F.when(s["d_b"].isNull(), _pchip_end(s["h_m"], s["h_a"], s["d_m"], s["d_a"])).otherwise(
                _pchip_inner(s["h_m"], s["h_b"], s["d_m"], s["d_b"]))
            return _hermite(k["l1"], k["r1"], s["h_m"], da, db, axis)

        def tail(s):
            da = F.when(s["d_b"].isNull(), s["d_a"]).otherwise(_pchip_inner(s["h_b"], s["h_a"], s["d_b"], s["d_a"]))
            db = _pchip_end(s["h_a"], s["h_b"], s["d_a"], s["d_b"])
            return _hermite(k["l2"], k["l1"], s["h_a"], da, db, axis)

        between = _steps(axis, a=(k["l2"], k["l1"]), m=(k["l1"], k["r1"]), b=(k["r1"], k["r2"]))
        beyond = _steps(axis, a=(k["l2"], k["l1"]), b=(k["l3"], k["l2"]))
        return (
            F.when(k["l1"].isNull(), F.lit(None))
            .when(k["r1"].isNotNull(), let(between, inner))
            .when(k["l2"].isNull(), k["l1"]["value"])
            .otherwise(let(beyond, tail))
        )

    return let(_knots(), shape)


def akima(axis: str) -> Column:
    """Akima piece between the neighbours; secants beyond the ends are extended linearly."""
    def slope(m1, m2, m3, m4):
        right, left = F.abs(m4 - m3), F.abs(m2 - m1)
        return F.when(right + left > 0, (right * m2 + left * m3) / (right + left)).otherwise((m2 + m3) / 2)

    def shape(k):
        def near(s):
            m, a, b = s["d_m"], s["d_a"], s["d_b"]
            first = F.struct(F.coalesce(a, 2 * m - b, m).alias("a"), F.coalesce(b, 2 * m - a, m).alias("b"))

            def far(n):
                second = F.struct(
                    F.coalesce(s["d_aa"], 2 * n["a"] - m).alias("a"), F.coalesce(s["d_bb"], 2 * n["b"] - m).alias("b")
                )
                return let(second, lambda o: _hermite(
                    k["l1"], k["r1"], s["h_m"], slope(o["a"], n["a"], m, n["b"]), slope(n["a"], m, n["b"], o["b"]), axis
                ))

            return let(first, far)

        steps = _steps(
            axis, m=(k["l1"], k["r1"]), a=(k["l2"], k["l1"]), aa=(k["l3"], k["l2"]), b=(k["r1"], k["r2"]),
            bb=(k["r2"], k["r3"]),
        )
        return F.when(k["l1"].isNotNull() & k["r1"].isNotNull(), let(steps, near))

    return let(_knots(), shape)


def lagrange(axis: str, left: int, total: int) -> Column:
    """Polynomial through ``total`` knots around the gap, ``left`` of them before it.

    At the edges knots of the other side step in; with fewer knots the degree drops. Outside the
    observed range the value stays missing.
    """
    nl, nr = F.size("left"), F.size("right")
    take_l = F.least(nl, F.greatest(F.lit(left), F.lit(total) - nr))
    take_r = F.least(nr, F.lit(total) - take_l)
    chosen = F.concat(
        F.slice("left", F.greatest(nl - take_l + 1, F.lit(1)), take_l), F.slice("right", F.lit(1), take_r)
    )
    x = here(axis)

    def polynomial(knots):
        def term(acc, k):
            basis = F.aggregate(
                knots, F.lit(1.0),
                lambda p, j: p * F.when(j["pos"] == k["pos"], F.lit(1.0)).otherwise(
                    (x - axis_of(j, axis)) / (axis_of(k, axis) - axis_of(j, axis))
                ),
            )
            return acc + k["value"] * basis

        return F.aggregate(knots, F.lit(0.0), term)

    return F.when((nl > 0) & (nr > 0), let(chosen, polynomial))


def knn_temporal(k: int = 3) -> Column:
    """Mean of the ``k`` observed points nearest by position (earlier first on ties)."""
    if k < 1:
        raise ValueError("k must be positive")
    near = F.slice(
        F.array_sort(
            F.transform(
                F.concat("left", "right"),
                lambda n: F.struct(F.abs(n["pos"] - F.col("pos")).alias("d"), n["pos"].alias("p"), n["value"].alias("v")),
            )
        ),
        1, k,
    )
    return let(near, lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, n: s + n["v"]) / F.size(a)))


def ar1_bridge(mean: Column, phi: Column) -> Column:
    """Conditional mean of a stationary AR(1) given the neighbours ``k`` steps back and ``m`` ahead."""
    a, b = _left(1), _right(1)
    facts = F.struct(
        F.pow(phi, (F.col("pos") - a["pos"]).cast("double")).alias("k"),
        F.pow(phi, (b["pos"] - F.col("pos")).cast("double")).alias("m"),
        (a["value"] - mean).alias("a"), (b["value"] - mean).alias("b"),
    )

    def bridge(f):
        k, m = f["k"], f["m"]
        both = mean + (k * (1 - m * m) * f["a"] + m * (1 - k * k) * f["b"]) / (1 - k * k * m * m)
        return F.when(k.isNotNull() & m.isNotNull(), both).when(k.isNotNull(), mean + k * f["a"]).otherwise(
            mean + m * f["b"])

    return let(facts, bridge)


def local_quadratic(axis: str) -> Column:
    """Least-squares parabola through the observed rows of ``_near``, read off at the row itself.

    Abscissae are centred on the row and scaled to the window, so the wanted value is the constant
    term. Two distinct rows give a line, one its value.
    """
    offsets = F.transform("_near", lambda k: F.struct((axis_of(k, axis) - here(axis)).alias("u"), k["value"].alias("v")))
    names = ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")
    zero = F.struct(*[F.lit(0.0).alias(n) for n in names])

    def sums(rows, scale):
        def add(acc, k):
            return let(k["u"] / scale, lambda u: F.struct(
                (acc["s0"] + 1).alias("s0"), (acc["s1"] + u).alias("s1"), (acc["s2"] + u * u).alias("s2"),
                (acc["s3"] + u * u * u).alias("s3"), (acc["s4"] + u * u * u * u).alias("s4"),
                (acc["t0"] + k["v"]).alias("t0"), (acc["t1"] + u * k["v"]).alias("t1"),
                (acc["t2"] + u * u * k["v"]).alias("t2"),
            ))

        return F.aggregate(rows, zero, add)

    def solve(m):
        s0, s1, s2, s3, s4, t0, t1, t2 = [m[n] for n in names]
        det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
        num = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)
        line = (t0 * s2 - s1 * t1) / (s0 * s2 - s1 * s1)
        return F.when(s0 >= 3, num / det).when(s0 == 2, line).when(s0 == 1, t0)

    def fit(rows):
        widest = F.array_max(F.transform(rows, lambda k: F.abs(k["u"])))
        return let(widest, lambda w: let(sums(rows, w), solve))

    return let(offsets, fit)
