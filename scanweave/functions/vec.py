"""Three-component vector algebra as Column expressions (no UDF)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class V(NamedTuple):
    x: Column
    y: Column
    z: Column

    def __add__(self, o: "V") -> "V":
        return V(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: "V") -> "V":
        return V(self.x - o.x, self.y - o.y, self.z - o.z)

    def __mul__(self, s) -> "V":
        return V(self.x * s, self.y * s, self.z * s)

    def __truediv__(self, s) -> "V":
        return V(self.x / s, self.y / s, self.z / s)

    def __neg__(self) -> "V":
        return V(-self.x, -self.y, -self.z)

    def dot(self, o: "V") -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: "V") -> "V":
        return V(
            self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x
        )

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def unit(self) -> "V":
        """Unit vector; the zero vector stays zero."""
        n = self.norm()
        return self / F.when(n == 0, 1.0).otherwise(n)

    def named(self, prefix: str = "", suffix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}{suffix}") for n, c in zip("xyz", self)]


def vec(prefix: str = "", suffix: str = "") -> V:
    """The columns `<prefix>x<suffix>`, `…y…`, `…z…`."""
    return V(*[F.col(f"{prefix}{n}{suffix}") for n in "xyz"])


def lit(x: float, y: float, z: float) -> V:
    return V(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))


def pick(condition: Column, yes: V, no: V) -> V:
    return V(*[F.when(condition, a).otherwise(b) for a, b in zip(yes, no)])


def frame_from_axis(axis: V) -> tuple[V, V]:
    """Two unit vectors that complete `axis` to a right-handed frame.

    The helper direction is X unless the axis leans more than 0.9 towards it, then Y.
    """
    a = axis.unit()
    helper = pick(F.abs(a.x) < 0.9, lit(1, 0, 0), lit(0, 1, 0))
    e1 = a.cross(helper).unit()
    return e1, a.cross(e1)


def transform(m: Column, p: V) -> V:
    """Row-major 4 x 4 rigid transform held in an `array<double>` column."""
    return V(*[m[4 * k] * p.x + m[4 * k + 1] * p.y + m[4 * k + 2] * p.z + m[4 * k + 3] for k in range(3)])


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded measure without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def hypot(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def stage(df: DataFrame, **vectors: V) -> DataFrame:
    """Add vectors as columns `<name>x`, `<name>y`, `<name>z`.

    Long vector formulas use each intermediate several times; a named stage keeps the
    expression from growing with every use (the optimizer does not inline it again).
    """
    return df.select("*", *[c for name, v in vectors.items() for c in v.named(name)])
