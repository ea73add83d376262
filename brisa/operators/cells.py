"""Learning from distinct rows: rows with equal features are one cell with their number and sums.

A forest draws rows, not cells: every row gets its own Poisson number of copies in every tree, in one
pass over the rows, and what reaches a tree are the copies and the sum of their labels per cell. With
the label's mean and the copies as weight the gains of all splits are those of the rows themselves.

Folds of a comparison are cells too. A cell of numbers is two points, its mean label less and plus the
deviation, with half of its rows each: sums, squares and products with features are those of its rows, so
squared losses, their fits and their penalties are as well. A cell of classes has one label.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from brisa.operators import ordered
from brisa.session import side_by_side, table_in_shared_folder

MAX_CELLS = 100_000          # travel to the tasks; a task keeps two numbers per cell and tree
ROWS_PER_CELL = 4            # with fewer there is little to gain
DRAWN_AT_ONCE = 200_000
MAX_FEATURES = 64            # of a vector that becomes columns

FORESTS = (RandomForestRegressor, RandomForestClassifier)
TREES = (*FORESTS, DecisionTreeRegressor, DecisionTreeClassifier, GBTRegressor, GBTClassifier)


def _group(columns: Sequence[str], kind: str) -> list[str]:
    return [*columns, *(["label"] if kind == "classificacao" else [])]


def flat_rows(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """(columns, label) as doubles, without the rows that lack a feature."""
    return df.dropna(subset=list(columns)).select(*[F.col(c).cast("double").alias(c) for c in columns],
                                                  F.col(label).cast("double").alias("label"))


def vectorise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


def cells_of(flat: DataFrame, columns: Sequence[str], kind: str) -> DataFrame | None:
    """(columns, n, label): distinct features, their rows and mean label, and for classes one row per
    label as well. None where rows are too seldom equal for it to pay, or cells too many to travel."""
    group = _group(columns, kind)
    n, about = flat.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*group))).first()
    if about > 0.8 * MAX_CELLS or about * ROWS_PER_CELL > n:
        return None
    mean = [] if "label" in group else [F.avg("label").alias("label")]
    return table_in_shared_folder(flat.groupBy(*group).agg(F.count(F.lit(1)).cast("double").alias("n"), *mean), "celulas")


class Forest:
    """Trees grown one by one: mean prediction or the class with most votes, mean of the importances."""

    def __init__(self, trees: Sequence, kind: str):
        self.trees, self.kind = list(trees), kind

    @property
    def featureImportances(self) -> DenseVector:
        parts = [t.featureImportances.toArray() for t in self.trees]
        total = np.sum([p / p.sum() for p in parts if p.sum() > 0] or [np.zeros(len(parts[0]))], axis=0)
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def transform(self, df: DataFrame) -> DataFrame:
        says = "prediction" if self.kind == "regressao" else "probability"
        out, names = df, [f"__p{i}" for i in range(len(self.trees))]
        for name, tree in zip(names, self.trees):
            out = tree.transform(out).withColumnRenamed(says, name).drop("rawPrediction", "probability", "prediction")
        if self.kind == "regressao":
            return out.withColumn("prediction", sum(F.col(c) for c in names) / len(names)).drop(*names)
        votes = F.array(*[sum(F.coalesce(F.get(vector_to_array(c), k), F.lit(0.0)) for c in names) for k in range(max(t.numClasses for t in self.trees))])
        return out.withColumn("prediction", (F.array_position(votes, F.array_max(votes)) - 1).cast("double")).drop(*names)


def bagged(flat: DataFrame, cells: DataFrame, columns: Sequence[str], kind: str, trees: int, seed: int) -> DataFrame:
    """(arvore, columns, label, peso): what each tree draws. Every row has Poisson(1) copies in every tree."""
    group = _group(columns, kind)
    numbered = table_in_shared_folder(ordered.row_numbers(cells.select(*group), group, "cela", start=0), "celulas")
    size = numbered.count()

    def draw(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        copies, sums = np.zeros((trees, size)), np.zeros((trees, size))

        def deal(part):
            cell, y = (np.concatenate([p[i] for p in part]) for i in range(2))
            for t in range(trees):
                k = rng.poisson(1.0, len(cell))
                copies[t] += np.bincount(cell, k, size)
                sums[t] += np.bincount(cell, k * y, size)
        part, rows = [], 0
        for batch in batches:
            part.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= DRAWN_AT_ONCE:
                deal(part)
                part, rows = [], 0
        if part:
            deal(part)
        for t in range(trees):
            hit = np.flatnonzero(copies[t])
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(np.full(len(hit), t, "int32")), pa.array(copies[t][hit]),
                                                  pa.array(sums[t][hit])], ["cela", "arvore", "peso", "soma"])
    marked = flat.filter(F.col("label").isNotNull()).join(F.broadcast(numbered), group).select("cela", "label")
    drawn = marked.mapInArrow(draw, "cela long, arvore int, peso double, soma double")
    drawn = drawn.groupBy("arvore", "cela").agg(F.sum("peso").alias("peso"), F.sum("soma").alias("soma"))
    told = drawn.join(F.broadcast(numbered.withColumnRenamed("label", "__y")), "cela") if "label" in group else drawn.join(F.broadcast(numbered), "cela")
    label = F.col("__y") if "label" in group else F.col("soma") / F.col("peso")
    told = told.select("arvore", *columns, label.alias("label"), "peso")
    return table_in_shared_folder(told.repartition("arvore").sortWithinPartitions("arvore"), "sorteio")


def fit_forest(df: DataFrame, columns: Sequence[str], kind: str, label: str = "label", trees: int = 50, depth: int = 5,
               seed: int = 42):
    """Random forest over the rows of `df`, grown from distinct rows where enough rows are equal."""
    columns = list(columns)
    made = RandomForestRegressor if kind == "regressao" else RandomForestClassifier
    flat = flat_rows(df, columns, label)
    cells = cells_of(flat, columns, kind)
    if cells is None:
        return made(numTrees=trees, maxDepth=depth, seed=seed).fit(vectorise(flat, columns))
    drawn = bagged(flat, cells, columns, kind, trees, seed)
    strategy = "onethird" if kind == "regressao" else "sqrt"        # what `auto` is for more than one tree

    def one(t):
        mine = vectorise(drawn.filter(F.col("arvore") == t).drop("arvore").coalesce(1), columns)
        return made(numTrees=1, bootstrap=False, featureSubsetStrategy=strategy if trees > 1 else "all", maxDepth=depth,
                    seed=seed * 1009 + t, weightCol="peso").fit(mine)
    return Forest(side_by_side(df.sparkSession, one, range(trees), 8), kind)


# ----------------------------------------------------------------------- folds
def learns_from_cells(model, kind: str) -> bool:
    """Does the estimator see nothing of rows but what their cells tell, with their number as weight?"""
    if type(model) not in (LinearRegression, LogisticRegression, *TREES) or model.isSet("weightCol"):
        return False
    of = model.getOrDefault
    if (of("featuresCol"), of("labelCol"), of("predictionCol")) != ("features", "label", "prediction"):
        return False
    if isinstance(model, LinearRegression) and of("loss") != "squaredError" or isinstance(model, GBTRegressor) and of("lossType") != "squared":
        return False
    if model.hasParam("validationIndicatorCol") and model.isSet("validationIndicatorCol"):
        return False
    if isinstance(model, TREES) and of("minInstancesPerNode") != 1:     # counts rows, whatever they weigh
        return False
    return not model.hasParam("subsamplingRate") or of("subsamplingRate") == 1.0


class FoldCells:
    """Distinct features of each fold: `rows` has them as columns, `cells` as vectors with label and `n`."""

    def __init__(self, rows: DataFrame, cells: DataFrame, columns: Sequence[str], kind: str, k: int):
        self.rows, self.flat, self.columns, self.kind, self.k = rows, cells, list(columns), kind, k
        if kind == "classificacao":
            points = cells.withColumn("__w", F.col("n"))
        else:
            two = F.when(F.col("desvio") > 0, F.array(F.col("label") - F.col("desvio"), F.col("label") + F.col("desvio"))).otherwise(F.array("label"))
            points = (cells.withColumn("__y", two).withColumn("__w", F.col("n") / F.size("__y"))
                      .withColumn("label", F.explode("__y")))
        self.cells = vectorise(points, self.columns).select("dobra", "features", "label", F.col("__w").alias("n")).cache()

    def unpersist(self) -> None:
        self.cells.unpersist()

    def split(self, fold: int) -> tuple[DataFrame, DataFrame]:
        return self.cells.filter(F.col("dobra") != fold), self.cells.filter(F.col("dobra") == fold)

    def medians(self) -> list[float | None]:
        """Median label of the rows outside each fold, all in the same scans."""
        names = [f"__m{i}" for i in range(self.k)]
        outside = self.rows.select(*[F.when(F.col("dobra") != i, F.col("label")).alias(m) for i, m in enumerate(names)])
        got = ordered.quantile_values(outside, names, [0.5])
        return [got[m][0.5] for m in names]

    def _drawn(self, numbered: DataFrame, size: int, trees: int, seed: int) -> DataFrame:
        """(dobra, arvore, cela, peso, soma): copies of the rows of each cell in each tree, and the sum of
        their labels. Every row has Poisson(1) copies: of rows with one label they are drawn together, of
        others as a Poisson number of copies that fall on the rows of a batch by chance, which is the same."""
        told = "dobra int, arvore int, cela long, peso double, soma double"

        def batch_of(fold, t, cell, copies, sums):
            return pa.RecordBatch.from_arrays([pa.array(fold.astype(np.int32)), pa.array(np.full(len(cell), t, "int32")), pa.array(cell),
                                               pa.array(copies.astype(float)), pa.array(sums)], ["dobra", "arvore", "cela", "peso", "soma"])
        if self.kind == "classificacao":
            def draw_cells(batches):
                rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
                for batch in batches:
                    fold, cell, n, y = (batch.column(i).to_numpy() for i in range(4))
                    for t in range(trees):
                        copies = rng.poisson(n)
                        hit = np.flatnonzero(copies)
                        yield batch_of(fold[hit], t, cell[hit], copies[hit], copies[hit] * y[hit])
            keyed = self.flat.filter(F.col("dobra").isNotNull()).join(F.broadcast(numbered), [*self.columns, "label"])
            return keyed.select("dobra", "cela", "n", "label").mapInArrow(draw_cells, told)

        def draw_rows(fold):
            def draw(batches):
                rng = np.random.default_rng([seed, fold, TaskContext.get().partitionId()])
                copies, sums = np.zeros((trees, size)), np.zeros((trees, size))

                def deal(part):
                    cell, y = (np.concatenate([p[i] for p in part]) for i in range(2))
                    for t in range(trees):
                        at = rng.integers(0, len(cell), rng.poisson(len(cell)), dtype=np.int32)
                        here = cell[at]
                        copies[t] += np.bincount(here, minlength=size)
                        sums[t] += np.bincount(here, y[at], size)
                part, rows = [], 0
                for batch in batches:
                    part.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                    rows += batch.num_rows
                    if rows >= DRAWN_AT_ONCE:
                        deal(part)
                        part, rows = [], 0
                if rows:
                    deal(part)
                for t in range(trees):
                    hit = np.flatnonzero(copies[t])
                    yield batch_of(np.full(len(hit), fold), t, hit, copies[t][hit], sums[t][hit])
            return draw
        at_once = -(-self.rows.sparkSession.sparkContext.defaultParallelism // self.k) + 1
        out = None
        for fold in range(self.k):
            mine = self.rows.filter(F.col("dobra") == fold).coalesce(at_once).join(F.broadcast(numbered), self.columns)
            part = mine.select("cela", "label").mapInArrow(draw_rows(fold), told)
            out = part if out is None else out.unionAll(part)
        return out

    def forests(self, model) -> list[Forest] | None:
        """A forest like `model` for each fold, grown from what its trees draw of the rows outside the fold:
        a row draws the same in all of them. None where the distinct features are too many to travel."""
        k, of = self.k, model.getOrDefault
        trees, seed = of("numTrees"), of("seed") % 2 ** 63          # a seed that was not set may be negative
        group = _group(self.columns, self.kind)
        distinct = self.flat.select(*group).distinct()
        if distinct.count() > MAX_CELLS:
            return None
        numbered = table_in_shared_folder(ordered.row_numbers(distinct, group, "cela", start=0), "celulas")
        size = numbered.count()

        def outside(batches):
            now, copies, sums = None, np.zeros((k, size)), np.zeros((k, size))

            def told():
                for fold in range(k):
                    others = [g for g in range(k) if g != fold]
                    n = copies[others].sum(axis=0)
                    hit = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), fold, "int32")), pa.array(np.full(len(hit), now, "int32")), pa.array(hit),
                                                      pa.array(n[hit]), pa.array(sums[others][:, hit].sum(axis=0) / n[hit])], ["dobra", "arvore", "cela", "peso", "__y"])
            for batch in batches:
                fold, tree, cell, n, y = (batch.column(i).to_numpy() for i in range(5))
                cuts = [0, *(np.flatnonzero(np.diff(tree)) + 1), len(tree)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if a < b and tree[a] != now:
                        if now is not None:
                            yield from told()
                        now = int(tree[a])
                        copies[:], sums[:] = 0, 0
                    np.add.at(copies, (fold[a:b], cell[a:b]), n[a:b])
                    np.add.at(sums, (fold[a:b], cell[a:b]), y[a:b])
            if now is not None:
                yield from told()
        drawn = self._drawn(numbered, size, trees, seed).repartition("arvore").sortWithinPartitions("arvore")
        drawn = drawn.mapInArrow(outside, "dobra int, arvore int, cela long, peso double, __y double")
        drawn = drawn.join(F.broadcast(numbered.select("cela", *self.columns)), "cela").select("dobra", "arvore", *self.columns, F.col("__y").alias("label"), "peso")
        drawn = table_in_shared_folder(drawn, "sorteio", ["dobra", "arvore"])
        features = of("featureSubsetStrategy")
        if features == "auto":
            features = ("onethird" if self.kind == "regressao" else "sqrt") if trees > 1 else "all"
        alike = {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": features, "weightCol": "peso"}

        def one(which):
            fold, t = which
            mine = drawn.filter((F.col("dobra") == fold) & (F.col("arvore") == t)).drop("dobra", "arvore").coalesce(1)
            tree = model.copy({model.getParam(p): v for p, v in (alike | {"seed": (seed * 1009 + t) % 2 ** 63}).items()})
            return tree.fit(vectorise(mine, self.columns))
        grown = side_by_side(drawn.sparkSession, one, [(fold, t) for fold in range(k) for t in range(trees)], 8)
        return [Forest(grown[fold * trees:(fold + 1) * trees], self.kind) for fold in range(k)]


def fold_cells(data: DataFrame, kind: str, k: int) -> FoldCells | None:
    """Cells of the rows (features, label, dobra). None where rows are too seldom equal, or where a row lacks
    something that fits stumble over: that is left to them."""
    if not isinstance(data.schema["features"].dataType, VectorUDT):
        return None
    first = data.filter(F.col("features").isNotNull()).select("features").first()
    size = len(first[0]) if first else 0
    if not 0 < size <= MAX_FEATURES:
        return None
    columns, label = [f"x{i}" for i in range(size)], F.col("label").try_cast("double")
    x = F.when(F.col("features").isNotNull(), vector_to_array("features"))
    rows = data.select("dobra", label.alias("label"), x.alias("__x"))
    rows = rows.select("dobra", "label", *[F.get("__x", F.lit(i)).alias(c) for i, c in enumerate(columns)],
                       (F.coalesce(F.size("__x"), F.lit(0)) == size).alias("inteira"))
    rows = table_in_shared_folder(rows, "linhas")
    group = _group(columns, kind)
    sound = F.col("inteira") & F.col("label").isNotNull() & ~F.isnan("label") & (F.abs("label") < float("inf"))
    n, about, every = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("dobra", *group)), F.bool_and(sound)).first()
    if not every or about * ROWS_PER_CELL > n:
        return None
    more = [] if "label" in group else [F.avg("label").alias("label"), F.stddev_pop("label").alias("desvio")]
    counted = rows.groupBy("dobra", *group).agg(F.count(F.lit(1)).cast("double").alias("n"), *more)
    return FoldCells(rows, table_in_shared_folder(counted, "celulas"), columns, kind, k)
