"""Re-ranking: one definition of the features for training and serving, blend, models, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..functions import vocabulary as V

FEATURES = (
    "bm25", "dense", "token_overlap", "indel_ratio", "pincode_match", "city_match", "number_match", "length_ratio",
)
BLEND = (0.3, 0.4, 0.3)


def _same(a: Column, b: Column) -> Column:
    """1 if both are known and equal, 0 if both are known and differ, 0.5 otherwise."""
    return F.when(a.isNull() | b.isNull(), 0.5).when(a == b, 1.0).otherwise(0.0)


def native_features(q: str, c: str) -> dict[str, Column]:
    """The features that need no retrieval scores, of two columns of tokens."""
    qn, cn = X.number_tokens(F.col(q)), X.number_tokens(F.col(c))
    pin = lambda t: F.get(F.filter(F.col(t), lambda x: x.rlike("^[0-9]{6}$")), F.lit(0))
    return {
        "token_overlap": X.token_jaccard(F.col(q), F.col(c)),
        "pincode_match": _same(pin(q), pin(c)),
        "city_match": _same(X.first_in(F.col(q), V.CITIES), X.first_in(F.col(c), V.CITIES)),
        "number_match": F.when(F.size(qn) == 0, 0.0).otherwise(X.token_overlap(qn, cn)),
        "length_ratio": F.least(F.size(q), F.size(c)) / F.greatest(F.size(q), F.size(c), F.lit(1)),
    }


def features(pairs: DataFrame) -> DataFrame:
    """Pairs (q_text, c_text, q_toks, c_toks, bm25, dense) with all of FEATURES."""
    own = native_features("q_toks", "c_toks")
    return pairs.withColumns(own | {"indel_ratio": S.indel_ratio("q_text", "c_text") / 100})


def blend_score(bm25: Column, dense: Column, overlap: Column) -> Column:
    return BLEND[0] * bm25 + BLEND[1] * dense + BLEND[2] * overlap


def pincode_anchor(score: Column, q_pin: Column, c_pin: Column) -> Column:
    """An equal pincode adds 0.20, up to 1; a different one takes 0.10, down to 0."""
    return (
        F.when(q_pin.isNull() | c_pin.isNull(), score)
        .when(q_pin == c_pin, F.least(F.lit(1.0), score + 0.20))
        .otherwise(F.greatest(F.lit(0.0), score - 0.10))
    )


def repick(ranked: DataFrame) -> DataFrame:
    """Where the first two of a query differ by under 0.02, the five best are ordered by match times overlap."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.col("probability").desc(), "addr_id")
    rows = ranked.withColumn("place", F.row_number().over(w)).withColumn(
        "gap", F.col("probability") - F.lead("probability").over(w)
    )
    close = F.max(F.when((F.col("place") == 1) & (F.col("gap") < 0.02), 1).otherwise(0)).over(Window.partitionBy("query_id"))
    factor = F.when(F.col("overlap") > 0, F.col("overlap")).otherwise(0.05)
    key = F.when((close == 1) & (F.col("place") <= 5), F.col("match_score") * factor).otherwise(F.lit(None).cast("double"))
    order = Window.partitionBy("query_id").orderBy(F.col("key").desc_nulls_last(), "place")
    return rows.withColumn("key", key).withColumn("rank", F.row_number().over(order).cast("long")).drop("key", "gap", "place")


def train_ranker(rows: DataFrame, label: str = "label", trees: int = 50, depth: int = 5):
    """Boosted trees on FEATURES; the fitted pipeline adds `probability`."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
            GBTClassifier(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, seed=42),
        ]
    ).fit(rows)


def fit_calibrator(scored: DataFrame, score: str, label: str):
    """Isotonic regression of labels on scores; outputs stay within what was seen."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    data = VectorAssembler(inputCols=[score], outputCol="_f").transform(scored.withColumn("_y", F.col(label).cast("double")))
    return IsotonicRegression(featuresCol="_f", labelCol="_y", predictionCol="calibrated").fit(data)


def calibrate(model, scored: DataFrame, score: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=[score], outputCol="_f").transform(scored)
    return model.transform(data).drop("_f")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
