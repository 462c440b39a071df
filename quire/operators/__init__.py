"""DataFrame -> DataFrame operators.

Modules: ``rank`` (scalable global rank/ntile), ``profile`` (shape, schema,
summaries), ``clean`` (null/duplicate/outlier handling), ``relational`` (joins,
reshape, set operations), ``aggregate`` (grouped stats, top-k, shares),
``charts`` (the tables behind bar/histogram/box charts), ``features``
(scaling, dummy coding, WOE/IV, splits, PCA), ``models`` (pyspark.ml fits with
coefficient tables, stepwise and elimination), ``evaluate`` (confusion,
cutoff sweeps, ROC/AUC/KS, lift), ``scorecard`` (points, cutoffs, benefit),
``timeseries`` (smoothing, trend fits, ACF/PACF, AR, tests, MAPE).
"""
