"""Model fitting: one place to find the fitters.

Every fit sends model-sized sums to the driver (score vectors, information matrices,
gradients, counts of splits); the rows stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.forest import Forest, fit_forest, oob_table
from quire.operators.logit import (
    LogitData, LogitFit, backward_eliminate, logit_fit, logit_predict_expr, score_with, stepwise_aic, vif_table, vifs)
from quire.operators.nets import NetFit, resilient_net
from quire.operators.svm import PairwiseModel, cv_grid, fit_pairwise

__all__ = ["Forest", "fit_forest", "oob_table", "LogitData", "LogitFit", "backward_eliminate", "logit_fit",
           "logit_predict_expr", "score_with", "stepwise_aic", "vif_table", "vifs", "NetFit", "resilient_net",
           "PairwiseModel", "cv_grid", "fit_pairwise", "accuracy"]


def accuracy(pred: DataFrame, label: str, prediction: str = "prediction") -> float:
    return pred.agg(F.avg((F.col(label).cast("double") == F.col(prediction)).cast("double"))).first()[0]
