"""Bagged trees with columns drawn per tree.

Spark ML's forests draw columns at every split. Here every tree sees one subset of the
columns: ``MASKS`` subsets at most are drawn (a tree has its own up to that number, more
trees share them evenly), each subset's trees are one forest over the sliced vector that draws rows with
replacement and no columns, and the forests are fitted concurrently over one written table.
The prediction averages over all trees.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.session import cut_lineage

MASKS = 32
STEP = 4  # forests whose votes one plan holds


def draw_masks(width: int, trees: int, share: float, seed: int) -> list[tuple[list[int], int]]:
    """(columns, number of trees) of every subset: ``share`` of the columns, at least one."""
    rng = np.random.default_rng(seed)
    n, size = min(trees, MASKS), min(width, max(1, int(share * width)))
    each = [trees // n + (i < trees % n) for i in range(n)]
    return [(sorted(int(c) for c in rng.choice(width, size, replace=False)), k) for k in each]


class BaggedTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """``numTrees`` trees, each on ``maxFeatures`` (a share) of the columns."""

    def __init__(self, kind: str, featuresCol: str, labelCol: str, numTrees: int = 10, maxFeatures: float = 1.0, maxDepth: int = 10,
                 seed: int = 0, parallelism: int = 4, **options):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol)
        self.kind, self.trees, self.share, self.seed, self.parallelism = kind, numTrees, maxFeatures, seed, parallelism
        self.options = {"maxDepth": maxDepth, **options}

    def setLabelCol(self, value: str) -> BaggedTrees:
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str) -> BaggedTrees:
        return self._set(predictionCol=value)

    def _fit(self, df: DataFrame) -> BaggedModel:
        table = cut_lineage(df.select(F.col(self.getFeaturesCol()).alias("all"), F.col(self.getLabelCol()).cast("double").alias("label")))
        width = table.first()["all"].size
        learner = RandomForestClassifier if self.kind == "cls" else RandomForestRegressor

        def one(job: tuple[int, tuple[list[int], int]]):
            i, (columns, trees) = job
            sliced = VectorSlicer(inputCol="all", outputCol="some", indices=columns).transform(table)
            forest = learner(featuresCol="some", labelCol="label", numTrees=trees, featureSubsetStrategy="all", bootstrap=True,
                             seed=self.seed * 1000 + i, **self.options)
            return forest.fit(sliced)

        masks = draw_masks(width, self.trees, self.share, self.seed)
        with ThreadPoolExecutor(max_workers=max(1, self.parallelism)) as pool:
            forests = list(pool.map(one, enumerate(masks)))
        return BaggedModel(self.kind, width, [(columns, forest) for (columns, _), forest in zip(masks, forests)])._set(
            featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())


class BaggedModel(Model, HasFeaturesCol, HasPredictionCol):
    """Mean class probabilities (or mean prediction) over all trees."""

    def __init__(self, kind: str, width: int, forests: list):
        super().__init__()
        self.kind, self.width, self.forests = kind, width, forests

    @property
    def featureImportances(self) -> np.ndarray:
        """Importances over all columns, averaged over the trees."""
        out = np.zeros(self.width)
        for columns, forest in self.forests:
            out[columns] += np.asarray(forest.featureImportances.toArray()) * forest.getNumTrees
        return out / max(out.sum(), 1e-300)

    def _transform(self, df: DataFrame) -> DataFrame:
        """The votes are summed up, and the sums written after every ``STEP`` forests: one plan
        of all of them is more than the driver can optimise."""
        names, out, total = df.columns, df, sum(f.getNumTrees for _, f in self.forests)
        classes = self.forests[0][1].numClasses if self.kind == "cls" else 0
        out = out.withColumn("__sum", F.array_repeat(F.lit(0.0), classes) if classes else F.lit(0.0))
        for i, (columns, forest) in enumerate(self.forests, 1):
            sliced = VectorSlicer(inputCol=self.getFeaturesCol(), outputCol="__some", indices=columns).transform(out)
            forest, share = forest.copy().setFeaturesCol("__some").setPredictionCol("__vote"), forest.getNumTrees / total
            if classes:
                forest.setProbabilityCol("__probability").setRawPredictionCol("")
                more = F.zip_with("__sum", vector_to_array("__probability"), lambda s, v: s + v * share)  # noqa: B023
            else:
                more = F.col("__sum") + F.col("__vote") * share
            out = forest.transform(sliced).select(*names, more.alias("__sum"))
            if i % STEP == 0 or i == len(self.forests):
                out = cut_lineage(out)
        if not classes:
            return out.select(*names, F.col("__sum").alias(self.getPredictionCol()))
        best = (F.array_position("__sum", F.array_max("__sum")) - 1).cast("double")
        return out.select(*names, array_to_vector("__sum").alias("probability"), best.alias(self.getPredictionCol()))
