"""spendlens - card-payment analytics on Spark DataFrames.

Public entry points (all take and return DataFrames unless noted):

* ``spendlens.plans.stages``: ``preprocess``, ``cleanup``, ``run_pipeline`` (raw files -> Parquet -> reports)
* ``spendlens.plans.analysis``: ``SpendAnalysis`` (frame-style reports), ``SqlAnalysis`` (SQL views)
* ``spendlens.operators.aggregates``: ``user_aggregate``, ``daily_aggregate``, ``merchant_aggregate``,
  ``mcc_aggregate``, ``card_aggregate``, ``risk_metrics``, ``user_aggregate_inner``, ``location_aggregate``
* ``spendlens.operators.reports``: summaries, time patterns, top-N, shares, demographic panels
* ``spendlens.operators.stats``: ``histogram(s)``, ``binned_mean``, ``kde``, ``correlation``, ``standardise``
* ``spendlens.operators.quantiles``: ``exact_quantile``, ``exact_quantiles``, ``exact_median``
* ``spendlens.operators.geo``: ``merchant_locations``, ``geocode``, ``bubble_legend``
* ``spendlens.operators.iforest``: ``IsolationForest`` / ``IsolationForestModel``
* ``spendlens.operators.ml``: ``impute``, ``pca_projection``, ``kmeans_clusters``, ``label_join``
* ``spendlens.operators.quality``: ``missing_report``, ``assert_no_missing``, ``profile``
* ``spendlens.streaming.ingest``: ``ingest_transactions`` (exactly-once incremental ingest)
"""
