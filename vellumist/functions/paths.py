"""Cubics, elliptical arcs and path commands as column expressions.

A cubic is eight columns x0, y0 to x3, y3; a command is a struct of COMMAND; a path is an array of commands. All of it runs inside code generation
or Spark's own higher-order functions, so paths are edited without leaving the JVM.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMAND = "struct<type:string,x1:double,y1:double,x2:double,y2:double,x:double,y:double,rx:double,ry:double,rotation:double,large_arc:boolean,sweep:boolean>"
FIELDS = ("type", "x1", "y1", "x2", "y2", "x", "y", "rx", "ry", "rotation", "large_arc", "sweep")

# Numbers that each kind of segment adds to a document.
LINE_NUMBERS, CUBIC_NUMBERS, ARC_NUMBERS, ELLIPSE_NUMBERS = 2, 6, 5, 7
#: Weight of a wobble beside the price of a number, and the bending that costs nothing.
WOBBLE, FREE_BENDING, MOST_BENDING = 1.0, 2.5, 10.0

Cubic = tuple  # of eight columns


def cubic_columns(prefix: str = "") -> Cubic:
    return tuple(F.col(f"{prefix}{c}{i}") for i in range(4) for c in "xy")


def bernstein(t: Column) -> tuple[Column, Column, Column, Column]:
    u = 1 - t
    return u * u * u, 3 * u * u * t, 3 * u * t * t, t * t * t


def _weighted(weights, values) -> Column:
    total = weights[0] * values[0]
    for w, v in zip(weights[1:], values[1:]):
        total = total + w * v
    return total


def cubic_at(b: Cubic, t: Column) -> tuple[Column, Column]:
    w = bernstein(t)
    return _weighted(w, b[0::2]), _weighted(w, b[1::2])


def cubic_tangent(b: Cubic, t: Column) -> tuple[Column, Column]:
    u = 1 - t
    w = (3 * u * u, 6 * u * t, 3 * t * t)
    return tuple(_weighted(w, [hi - lo for lo, hi in zip(v, v[1:])]) for v in (b[0::2], b[1::2]))


def unit(x: Column, y: Column) -> Column:
    """struct(x, y) of length one; null for a vector shorter than 1e-12 or not finite."""
    n = F.hypot(x, y)
    fine = (n >= 1e-12) & ~F.isnan(n) & (n < float("inf"))
    return F.when(fine, F.struct((x / n).alias("x"), (y / n).alias("y")))


def _chord2(b: Cubic) -> Column:
    return (b[6] - b[0]) * (b[6] - b[0]) + (b[7] - b[1]) * (b[7] - b[1])


def has_inflection(b: Cubic) -> Column:
    """The control polygon turns both ways, beyond noise."""
    legs = [(b[2 * i + 2] - b[2 * i], b[2 * i + 3] - b[2 * i + 1]) for i in range(3)]
    turn = [p[0] * q[1] - p[1] * q[0] for p, q in zip(legs, legs[1:])]
    return turn[0] * turn[1] < -1e-6 * F.greatest(_chord2(b), F.lit(1.0))


def bending_energy(b: Cubic) -> Column:
    """Integral of the squared second derivative over the squared chord, a third of it; 0 without a chord."""
    a, c = ([b[k] - 2 * b[k + 2] + b[k + 4] for k in start] for start in ((0, 1), (2, 3)))
    form = sum((p * p + p * q + q * q for p, q in zip(a, c)), F.lit(0.0))
    chord = _chord2(b)
    return F.when(chord <= 1e-12, 0.0).otherwise(12 * form / chord)


def wobble_penalty(b: Cubic, price: float) -> Column:
    energy = bending_energy(b)
    excess = F.when(energy > FREE_BENDING, F.least(energy - FREE_BENDING, F.lit(MOST_BENDING)) * (price * WOBBLE * 0.5)).otherwise(0.0)
    return F.when(has_inflection(b), 2 * price * WOBBLE).otherwise(0.0) + excess


def self_intersects(b: Cubic) -> Column:
    """Whether a cubic crosses itself inside its span: both parameters of the double point solve one quadratic."""
    third = [v[3] - v[0] + 3 * (v[1] - v[2]) for v in (b[0::2], b[1::2])]
    second = [3 * (v[0] - 2 * v[1] + v[2]) for v in (b[0::2], b[1::2])]
    first = [3 * (v[1] - v[0]) for v in (b[0::2], b[1::2])]
    det = third[0] * second[1] - third[1] * second[0]
    w = (first[1] * second[0] - first[0] * second[1]) / det
    total = (third[1] * first[0] - third[0] * first[1]) / det
    gap2 = total * total - 4 * (total * total - w)
    gap = F.sqrt(F.greatest(gap2, F.lit(0.0)))
    lo, hi = (total - gap) / 2, (total + gap) / 2
    edge = 1e-9
    inside = (lo > edge) & (lo < 1 - edge) & (hi > edge) & (hi < 1 - edge) & (hi - lo > edge)
    return F.when(F.abs(det) < 1e-12, False).otherwise((gap2 > 0) & inside)


def canonical_angle(angle: Column) -> Column:
    """The same axis direction in (-pi/2, pi/2]."""
    return angle - pi * F.ceil(angle / pi - 0.5)


def with_arc_frame(df: DataFrame, ends: tuple, out: str = "frame") -> DataFrame:
    """df with struct(cx, cy, rx, ry, theta1, delta) of arcs given by their ends (the published endpoint to center conversion); radii too small for the ends grow.

    ends: names of the columns x0, y0, rx, ry, phi (radians), large, sweep, x1, y1. Without a chord or a radius the sweep is 0. Each step is a column of its own,
    so that no expression is repeated in the generated code.
    """
    x0, y0, rx, ry, phi, large, sweep, x1, y1 = (F.col(c) for c in ends)
    v = {n: F.col(f"__{n}") for n in ("rx", "ry", "hx", "hy", "c", "s", "px", "py", "gx", "gy", "k", "qx", "qy", "start", "turn")}
    steps = [
        {"rx": F.abs(rx), "ry": F.abs(ry), "hx": (x0 - x1) / 2, "hy": (y0 - y1) / 2, "c": F.cos(phi), "s": F.sin(phi)},
        {"px": v["c"] * v["hx"] + v["s"] * v["hy"], "py": v["c"] * v["hy"] - v["s"] * v["hx"]},
        {"k": F.sqrt(F.greatest(F.lit(1.0), v["px"] * v["px"] / (v["rx"] * v["rx"]) + v["py"] * v["py"] / (v["ry"] * v["ry"])))},
        {"gx": v["rx"] * v["k"], "gy": v["ry"] * v["k"]},
        {"k": v["gx"] * v["gx"] * v["py"] * v["py"] + v["gy"] * v["gy"] * v["px"] * v["px"]},
        {"k": F.when(v["k"] > 0, F.sqrt(F.greatest(v["gx"] * v["gx"] * v["gy"] * v["gy"] - v["k"], F.lit(0.0)) / v["k"])).otherwise(0.0) * F.when(large == sweep, -1.0).otherwise(1.0)},
        {"qx": v["k"] * v["gx"] * v["py"] / v["gy"], "qy": -v["k"] * v["gy"] * v["px"] / v["gx"]},
        {"start": F.atan2((v["py"] - v["qy"]) / v["gy"], (v["px"] - v["qx"]) / v["gx"])},
        {"turn": F.atan2((-v["py"] - v["qy"]) / v["gy"], (-v["px"] - v["qx"]) / v["gx"]) - v["start"]},
        {"turn": F.when(~sweep & (v["turn"] > 0), v["turn"] - 2 * pi).when(sweep & (v["turn"] < 0), v["turn"] + 2 * pi).otherwise(v["turn"])},
    ]
    flat = (F.col("__hx") * F.col("__hx") + F.col("__hy") * F.col("__hy") <= 1e-24) | (v["rx"] <= 1e-12) | (v["ry"] <= 1e-12)
    whole = {"cx": v["c"] * v["qx"] - v["s"] * v["qy"] + (x0 + x1) / 2, "cy": v["s"] * v["qx"] + v["c"] * v["qy"] + (y0 + y1) / 2, "rx": v["gx"], "ry": v["gy"], "theta1": v["start"], "delta": v["turn"]}
    none = {"cx": x0 - v["rx"], "cy": y0, "rx": v["rx"], "ry": v["ry"], "theta1": F.lit(0.0), "delta": F.lit(0.0)}
    kept = df.columns
    for step in steps:
        df = df.withColumns({f"__{n}": c for n, c in step.items()})
    frame = F.when(flat, F.struct(*[c.alias(n) for n, c in none.items()])).otherwise(F.struct(*[c.alias(n) for n, c in whole.items()]))
    return df.withColumn(out, frame).select(*kept, out)


def arc_point(frame: Column, phi: Column, t: Column) -> tuple[Column, Column]:
    u, v = frame["rx"] * F.cos(t), frame["ry"] * F.sin(t)
    return frame["cx"] + F.cos(phi) * u - F.sin(phi) * v, frame["cy"] + F.sin(phi) * u + F.cos(phi) * v


def arc_span(frame: Column) -> Column:
    """At most the arc's length."""
    return F.abs(F.greatest(F.abs(frame["rx"]), F.abs(frame["ry"])) * frame["delta"])


# --- commands


def command(kind: str, **fields: Column) -> Column:
    """A command; what is not given is null."""
    types = dict(part.split(":") for part in COMMAND[7:-1].split(","))
    return F.struct(F.lit(kind).alias("type"), *[fields.get(n, F.lit(None)).cast(types[n]).alias(n) for n in FIELDS[1:]])


def move_to(x, y) -> Column:
    return command("M", x=x, y=y)


def line_to(x, y) -> Column:
    return command("L", x=x, y=y)


def quad_to(x1, y1, x, y) -> Column:
    return command("Q", x1=x1, y1=y1, x=x, y=y)


def cubic_to(x1, y1, x2, y2, x, y) -> Column:
    return command("C", x1=x1, y1=y1, x2=x2, y2=y2, x=x, y=y)


def elliptical_arc(rx, ry, phi, large, sweep, x, y) -> Column:
    """phi in radians; the command has degrees."""
    return command("A", rx=rx, ry=ry, rotation=F.degrees(phi), large_arc=large, sweep=sweep, x=x, y=y)


def circular_arc(r, large, sweep, x, y) -> Column:
    return command("A", rx=r, ry=r, rotation=F.lit(0.0), large_arc=large, sweep=sweep, x=x, y=y)


def close() -> Column:
    return command("Z")


def is_circular(c: Column) -> Column:
    """An arc of a circle; true for whatever has no radii."""
    return (c["type"] != "A") | ((F.abs(c["rx"] - c["ry"]) <= 1e-9 * F.greatest(F.abs(c["rx"]), F.lit(1.0))) & (c["rotation"] == 0))


def segment_numbers(c: Column) -> Column:
    return F.when(c["type"] == "L", LINE_NUMBERS).when(c["type"] == "C", CUBIC_NUMBERS).when(c["type"] == "A", F.when(is_circular(c), ARC_NUMBERS).otherwise(ELLIPSE_NUMBERS))


def path_numbers(path: Column) -> Column:
    """Numbers that a path adds: its start and all its segments."""
    return F.aggregate(path, F.lit(2), lambda n, c: n + F.coalesce(segment_numbers(c), F.lit(0)))


def node_count(path: Column) -> Column:
    return F.size(F.filter(path, lambda c: c["type"] != "Z"))


def place(path: Column, scale: Column, dx: Column, dy: Column) -> Column:
    """Every point p becomes scale * p + (dx, dy); radii scale, rotation and flags stay."""

    def moved(c: Column) -> Column:
        new = {n: c[n] * scale + (dx if n[0] == "x" else dy) for n in ("x1", "y1", "x2", "y2", "x", "y")}
        new |= {n: c[n] * scale for n in ("rx", "ry")}
        return F.struct(*[new.get(n, c[n]).alias(n) for n in FIELDS])

    return F.transform(path, moved)


def path_end(path: Column) -> Column:
    """The last point of a path: that of its last command but a closing one."""
    return F.element_at(F.filter(path, lambda c: c["type"] != "Z"), -1)


def pin_end(path: Column, x: Column, y: Column) -> Column:
    """The path with its last drawn point at (x, y)."""
    last = F.size(F.filter(path, lambda c: c["type"] != "Z")) - 1
    swapped = {"x": x, "y": y}
    return F.transform(path, lambda c, i: F.when(i == last, F.struct(*[swapped.get(n, c[n]).alias(n) for n in FIELDS])).otherwise(c))


def reverse(path: Column) -> Column:
    """The same outline drawn backwards: a move to the end, then each segment towards the point before it; arcs sweep the other way."""

    def turned(drawn: Column) -> Column:
        n = F.size(drawn)

        def back(i: Column) -> Column:
            pair = F.slice(drawn, n - i - 1, 2)

            def step(p: Column) -> Column:
                before, c = p[0], p[1]
                cubic = c["type"] == "C"
                new = {
                    "x1": F.when(cubic, c["x2"]).otherwise(c["x1"]), "y1": F.when(cubic, c["y2"]).otherwise(c["y1"]), "x2": F.when(cubic, c["x1"]), "y2": F.when(cubic, c["y1"]),
                    "x": before["x"], "y": before["y"], "sweep": ~c["sweep"],
                }
                return F.struct(*[new.get(f, c[f]).alias(f) for f in FIELDS])

            return F.transform(F.array(pair), step)[0]

        end = F.element_at(drawn, -1)
        body = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), back)).otherwise(F.expr(f"cast(array() as array<{COMMAND}>)"))
        return F.when(n > 0, F.concat(F.array(move_to(end["x"], end["y"])), body))

    # What is drawn is bound once, as the one element of an array.
    drawn = F.array(F.filter(path, lambda c: c["type"] != "Z"))
    closed = F.filter(path, lambda c: c["type"] == "Z")
    return F.coalesce(F.concat(F.transform(drawn, turned)[0], closed), path)
