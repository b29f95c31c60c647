"""Models over feature tables, fitted by aggregates: a linear model from its normal equations, a regression tree from histograms; clusters with the ml library."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _whole(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in (*features, label)]).dropna()


@dataclass
class Linear:
    """intercept + sum of coefficient * feature."""

    intercept: float
    coefficients: dict[str, float]

    def predicted(self) -> Column:
        return sum((F.col(c) * w for c, w in self.coefficients.items()), F.lit(self.intercept))


def linear(train: DataFrame, features: Sequence[str], label: str, ridge: float = 0.0) -> Linear:
    """Least squares with ridge * (sum of squared coefficients of features in population deviations) added to the mean squared error; the intercept is free.

    One aggregate with partial sums gives means, then one gives the covariances (centred, so that large values lose nothing);
    the driver solves a system of as many equations as features. Rows with nulls are left out. A feature without any
    deviation gets 0; of features that determine each other the solution of least length is taken.
    """
    df = _whole(train, features, label)
    names = [*features, label]
    means = df.agg(*[F.avg(c).alias(c) for c in names]).first()
    if means[0] is None:
        raise ValueError("no row without nulls")
    c = [F.col(x) - F.lit(means[x]) for x in names]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = df.agg(*[F.avg(c[i] * c[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    k = len(features)
    cov = np.zeros((k + 1, k + 1))
    for (i, j), v in zip(pairs, sums, strict=True):
        cov[i, j] = cov[j, i] = v
    sd = np.sqrt(np.diag(cov)[:k])
    scaled = np.where(sd > 0, sd, 1.0)
    system = cov[:k, :k] / np.outer(scaled, scaled) + ridge * np.eye(k)
    w = np.linalg.lstsq(system, cov[:k, k] / scaled, rcond=None)[0] / scaled * (sd > 0)
    return Linear(float(means[label] - sum(x * means[f] for x, f in zip(w, features, strict=True))), dict(zip(features, map(float, w), strict=True)))


@dataclass
class Node:
    """A leaf's value, or a test (feature <= edge) with the nodes below."""

    value: float
    feature: str | None = None
    edge: float | None = None
    yes: Node | None = None
    no: Node | None = None

    def predicted(self) -> Column:
        return F.lit(self.value) if self.feature is None else F.when(F.col(self.feature) <= self.edge, self.yes.predicted()).otherwise(self.no.predicted())


def tree(train: DataFrame, features: Sequence[str], label: str, depth: int = 4, bins: int = 32, least_rows: int = 1) -> Node:
    """A regression tree grown level by level from histograms: each feature's range is cut into equal bins, and one aggregate a level has count and sum of the label by node, feature and bin.

    A node takes the cut (a bin's upper edge) that lowers the sum of squares most, of equal ones that of the first feature and
    lowest bin; it stays a leaf if none does, or a side would have fewer than least_rows rows. The driver gets nodes * features
    * bins sums. Rows with nulls are left out.
    """
    df = _whole(train, features, label)
    ends = df.agg(F.avg(label).alias("mean"), *[F.min(f).alias(f"lo_{i}") for i, f in enumerate(features)], *[F.max(f).alias(f"hi_{i}") for i, f in enumerate(features)]).first()
    if ends["mean"] is None:
        raise ValueError("no row without nulls")
    edges = [[ends[f"lo_{i}"] + (ends[f"hi_{i}"] - ends[f"lo_{i}"]) * (b + 1) / bins for b in range(bins)] for i in range(len(features))]
    # the first bin whose upper edge isn't below the value; the last bin takes what rounding leaves
    below = lambda f: lambda edge: edge < F.col(f)
    binned = [F.struct(F.lit(i).alias("feature"), F.least(F.size(F.filter(F.array(*map(F.lit, edges[i])), below(f))), F.lit(bins - 1)).alias("bin")) for i, f in enumerate(features)]
    long = df.withColumn("_b", F.array(*binned))
    root = Node(ends["mean"])
    open_nodes = {1: root}
    for _ in range(depth):
        place = _place(root, open_nodes)
        got = long.select(place.alias("node"), F.col(label).alias("y"), F.inline("_b")).where("node IS NOT NULL").groupBy("node", "feature", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()
        sums = {}
        for r in got:
            sums.setdefault(r["node"], np.zeros((2, len(features), bins)))[:, r["feature"], r["bin"]] = r["n"], r["s"]
        opened = {}
        for at, node in open_nodes.items():
            if at not in sums:
                continue
            n, s = np.cumsum(sums[at], axis=2)
            total_n, total_s = n[0, -1], s[0, -1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = s**2 / n + (total_s - s) ** 2 / (total_n - n) - total_s**2 / total_n
            gain[(n < least_rows) | (total_n - n < least_rows)] = -np.inf
            f, b = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[f, b] > 1e-9 * max(1.0, total_s**2 / total_n):
                node.feature, node.edge = features[f], edges[f][b]
                node.yes, node.no = Node(s[f, b] / n[f, b]), Node((total_s - s[f, b]) / (total_n - n[f, b]))
                opened |= {2 * at: node.yes, 2 * at + 1: node.no}
        open_nodes = opened
        if not open_nodes:
            break
    return root


def _place(root: Node, open_nodes: dict[int, Node]) -> Column:
    """The number of the open node that a row falls into, null if it falls into a leaf."""
    number = {id(n): k for k, n in open_nodes.items()}

    def at(node: Node) -> Column:
        if node.feature is not None:
            return F.when(F.col(node.feature) <= node.edge, at(node.yes)).otherwise(at(node.no))
        return F.lit(number.get(id(node))).cast("long")

    return at(root)


def lloyd(df: DataFrame, array: str, first: list[list[float]], rounds: int) -> DataFrame:
    """df with cluster: k-means from the given centres (their places name the clusters), in so many rounds.

    A round is one aggregate: each row goes to its nearest centre (of equal ones the first), and the driver gets the means of k
    centres by component. A centre without rows stays where it is. All vectors have one size; null ones get a null cluster.
    """
    v = F.col(array).cast("array<double>")
    centres = [list(map(float, c)) for c in first]

    def nearest(centres: list[list[float]]) -> Column:
        far = lambda c: F.aggregate(F.zip_with(v, F.expr(f"array({', '.join(f'{x!r}D' for x in c)})"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        return F.array_min(F.array(*[F.named_struct(F.lit("d"), far(c), F.lit("c"), F.lit(i)) for i, c in enumerate(centres)]))["c"]

    for _ in range(rounds):
        placed = df.where(F.col(array).isNotNull()).select(nearest(centres).alias("_c"), v.alias("_v"))
        means = [F.avg(F.get("_v", F.lit(j))).alias(f"m{j}") for j in range(len(centres[0]))]
        for r in placed.groupBy("_c").agg(*means).collect():
            centres[r["_c"]] = list(r[1:])
    return df.withColumn("cluster", F.when(F.col(array).isNotNull(), nearest(centres)))


def clusters(df: DataFrame, array: str, k: int, seed: int = 1) -> tuple[DataFrame, float]:
    """df with cluster, and the silhouette of the clustering of an array column."""
    x = df.withColumn("_x", array_to_vector(F.col(array).cast("array<double>")))
    out = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(x).transform(x)
    return out.drop("_x"), ClusteringEvaluator(featuresCol="_x", predictionCol="cluster").evaluate(out)
