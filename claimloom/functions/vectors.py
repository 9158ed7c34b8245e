"""Vector arithmetic on array columns (#179)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, shifted: bool = False) -> Column:
    """Cosine similarity, 0 if a vector has no length; ``shifted`` maps it to 0 to 1."""
    n = norm(a) * norm(b)
    c = F.when(n > 0, dot(a, b) / n).otherwise(0.0)
    return (c + 1) / 2 if shifted else c


def unit(a: Column) -> Column:
    """The vector divided by its length, so that later cosines are dot products.  The length is bound to a variable: named
    inside the inner function it would be taken anew for each element."""
    divided = lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))
    return F.get(F.transform(F.array(norm(a)), divided), F.lit(0))


def parse(text: Column) -> Column:
    """#4. A vector from text of the form ``[a,b,...]``."""
    return F.from_json(text, "array<double>")


def mean_vectors(df: DataFrame, key: str, vector: str, weight: str | None = None) -> DataFrame:
    """(key, centroid): the (weighted) mean vector per key, summed per position with partial sums."""
    w = F.col(weight) if weight else F.lit(1.0)
    x = df.select(key, w.alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    m = x.groupBy(key, "_i").agg((F.sum(F.col("_w") * F.col("_x").cast("double")) / F.sum("_w")).alias("_m"))
    return m.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))


class Grown:
    """Rows of numbers that grow in place; a worker's own, between rows that come in order."""

    def __init__(self, values: list, width: int) -> None:
        self.n = len(values) // width if width else 0
        self.rows = np.array(values, float).reshape(self.n, width or 0)

    def new(self, width: int) -> int:
        if self.n == len(self.rows):
            more = np.zeros((max(8, 2 * self.n), width))
            more[: self.n] = self.rows[:, :width] if self.n else 0
            self.rows = more
        self.n += 1
        return self.n - 1

    def nearest(self, v: np.ndarray, least: float) -> int | None:
        """The row of the largest cosine with v, if that is ``least`` at least; ties: the first."""
        if not self.n:
            return None
        cosine = np.round(self.rows[: self.n] @ v / np.linalg.norm(self.rows[: self.n], axis=1), 9)
        i = int(cosine.argmax())
        return i if cosine[i] >= least else None
