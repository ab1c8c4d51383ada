"""Embedding whitening: one aggregation of all centred products, LAPACK on the covariance, projection by expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Components that are returned, and the share of the largest eigenvalue below which there is no direction to whiten.
COMPONENTS, NEGLIGIBLE = 8, 1e-12
#: Dimensions of a tile. A row gives a record for each pair of tiles in the upper triangle, and TILE * TILE sums take them
#: all: some 2,000 sums of their own are more than a generated class can hold, and are then interpreted.
TILE = 8
#: Largest amount of an entry that becomes a whole number without loss.
LARGEST = 2.0**52


def entries(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", scale: float = 1024.0, shift: int = 100_000) -> tuple[DataFrame, int]:
    """key and columns x0, x1, ... (long, floor(scale * c) + shift) of each usable vector, and their number.

    Unusable are null vectors and those with null, non-finite or (more than LARGEST after scaling)
    unrepresentable entries. The longest usable vector sets the number of columns; what a shorter one
    lacks counts as null entries.
    """
    c = lambda x: x.cast("double") * scale
    # a comparison with NaN is one with the largest number; null is neither
    good = F.forall(F.col("v"), lambda x: F.coalesce(F.abs(c(x)) <= LARGEST, F.lit(False)))
    d = vectors.select(F.col(key), F.col(vec).alias("v")).where(F.col("v").isNotNull() & good)
    width = d.agg(F.max(F.size("v"))).first()[0] or 0
    x = [(F.floor(c(F.get("v", F.lit(i)))) + shift).cast("long").alias(f"x{i}") for i in range(width)]
    return d.where(F.size("v") == width).select(key, *x), width


@dataclass
class Fit:
    """What whiten() needs: number of vectors, sums, covariance, eigenvalues (falling) and unit eigenvectors (columns)."""
    n: int
    sums: list[int]
    cov: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        trace = float(np.trace(self.cov))
        return self.values / trace if trace > 0 else self.values * 0


def _products(x: DataFrame, width: int, middle: list[int], kind: str) -> list:
    """Rows (a, b, p0_0, p0_1, ...): sums of products of centred entries for each pair a <= b of tiles; null beyond the width."""
    tiles = range(-(-width // TILE))
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in tiles for b in tiles if a <= b))
    d = x.select(F.array(*((F.col(f"x{i}") - F.lit(m)).cast(kind) for i, m in enumerate(middle))).alias("v"), F.explode(pairs).alias("t"))
    d = d.select("t.a", "t.b", *(F.get("v", F.col(f"t.{t}") * TILE + k).alias(f"{t}{k}") for t in "ab" for k in range(TILE)))
    return d.groupBy("a", "b").agg(*(F.sum(F.col(f"a{i}") * F.col(f"b{j}")).alias(f"p{i}_{j}") for i in range(TILE) for j in range(TILE))).collect()


def covariance(x: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """n, sums and covariance (divisor n) of x0, x1, ...

    A pass over the rows gives n, each dimension's sum, least and largest entry; the next one adds up the
    products of all pairs of dimensions in the upper triangle, in one aggregation by tile. Entries are centred
    by the whole number next to their mean, which keeps sums of whole numbers exact; what is missing to the
    mean, at most a half, is taken off exactly. So the covariance depends on no order of rows. Where a
    sum could leave a long (values some 1e9 times as large as their number allows), doubles are added up.
    Tasks combine their rows first; the driver gets the sums, of which there are as many as pairs of dimensions.
    """
    if not width:
        return x.count(), [], np.zeros((0, 0))
    one = x.agg(F.count(F.lit(1)).alias("n"), *(f(F.col(f"x{i}").cast("decimal(20,0)") if f is F.sum else F.col(f"x{i}")).alias(f"{k}{i}") for i in range(width) for k, f in (("s", F.sum), ("a", F.min), ("z", F.max)))).first()
    n = one["n"]
    if not n:
        return 0, [0] * width, np.zeros((width, width))
    sums = [int(one[f"s{i}"]) for i in range(width)]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    reach = max(max(one[f"z{i}"] - m, m - one[f"a{i}"]) for i, m in enumerate(middle))
    kind = "long" if n * reach * reach < 2**63 else "double"
    cov = np.zeros((width, width))
    for row in _products(x, width, middle, kind):
        for i in range(row["a"] * TILE, min(width, (row["a"] + 1) * TILE)):
            for j in range(max(i, row["b"] * TILE), min(width, (row["b"] + 1) * TILE)):
                p = row[f"p{i % TILE}_{j % TILE}"]
                rest = (sums[i] - n * middle[i]) * (sums[j] - n * middle[j])
                # whole numbers of any size, one rounding at the end
                cov[i, j] = cov[j, i] = (p * n - rest) / (n * n) if kind == "long" else p / n - rest / n / n
    return n, sums, cov


def fit(x: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    """Covariance and its largest eigenvalues, decomposed by LAPACK's symmetric solver on the driver (width by width).

    An eigenvector's largest entry is positive. Directions without variance have no unit scale: there are
    as many components as eigenvalues above NEGLIGIBLE of the largest, at most the number asked for.
    """
    n, sums, cov = covariance(x, width)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    keep = values > NEGLIGIBLE * max(values[0], 0.0) if len(values) else []
    values, vectors = values[keep], vectors[:, keep]
    for k in range(len(values)):
        if vectors[np.argmax(np.abs(vectors[:, k])), k] < 0:
            vectors[:, k] = -vectors[:, k]
    return Fit(n, sums, cov, values, vectors)


def _total(parts: list[Column]) -> Column:
    """Sum as a balanced tree, whose depth the optimizer can take at any width."""
    while len(parts) > 1:
        parts = [a + b for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2:]
    return parts[0]


def whitened(x: DataFrame, f: Fit, key: str = "vec_id") -> DataFrame:
    """key, w1, w2, ...: centred entries on each component over its standard deviation; x's columns stay."""
    centred = [F.col(f"x{i}").cast("double") - F.lit(s / f.n) for i, s in enumerate(f.sums)] if f.n else []
    return x.select("*", *(_total([c * F.lit(float(v / np.sqrt(e))) for c, v in zip(centred, f.vectors[:, k])]).alias(f"w{k + 1}") for k, e in enumerate(f.values)))


def identity_error(w: DataFrame, k: int) -> float:
    """Largest amount by which the covariance of w1..wk (divisor n, centred) differs from the identity; one aggregation."""
    if not k:
        return 0.0
    pairs = [(i, j) for i in range(1, k + 1) for j in range(i, k + 1)]
    row = w.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Fit, float]:
    """Whitened vectors (key, x0, x1, ..., w1, w2, ...), the fit, and how far their covariance is from the identity.

    All usable rows (see entries) are fitted and whitened, repeated ones and equal vectors as often as
    they occur; a null key stays null. Ties of eigenvalues take LAPACK's order. An empty table, and one
    of equal vectors, have no components. Other columns are not read. Rows are nowhere shuffled; the
    driver holds sums and a matrix of width by width.
    """
    x, width = entries(vectors, key, vec)
    f = fit(x, width, components)
    w = whitened(x, f, key)
    return w, f, identity_error(w, len(f.values))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable vector and component. deviation is null where it does not fit into a long."""
    w, f, error = whiten(C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    d = lambda i: F.try_subtract(F.try_multiply(F.lit(f.n).cast("long"), F.col(f"x{i}")), F.lit(s).cast("long") if abs(s := f.sums[i]) < 2**63 else F.lit(None).cast("long"))
    squares = [F.try_multiply(d(i), d(i)) for i in range(len(f.sums))]
    while len(squares) > 1:
        squares = [F.try_add(a, b) for a, b in zip(squares[::2], squares[1::2])] + squares[len(squares) // 2 * 2:]
    deviation = squares[0] if squares else F.lit(0).cast("long")
    parts = [F.struct(F.lit(k + 1).cast("int").alias("component"), F.col(f"w{k + 1}").alias("whitened"), F.lit(float(e)).alias("explained")) for k, e in enumerate(f.explained)]
    kind = "array<struct<component:int,whitened:double,explained:double>>"
    out = w.select("vec_id", deviation.alias("deviation"), F.explode(F.array(*parts).cast(kind)).alias("c"))
    return out.select("vec_id", "c.component", F.lit(f.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error"))


QUERIES = {"op12_embedding_whitening": (op12_embedding_whitening, None)}
