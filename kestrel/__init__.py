"""kestrel: tabular anomaly analytics with causal structure, as Spark DataFrame operators.

Sub-packages
------------
sources    readers and writers (tables, factor catalogues, graphs, orders, weights)
functions  column-expression helpers and the scalable prefix-sum primitive
operators  the operator library (recode, binning, text, sampling, causal, graph,
           orders, scoring, metrics, joins, detectors, annotation)
plans      composite plans built from operators (density scoring, preparation chains,
           bindings of the roles to the driver tables)
streaming  stream-static scoring of a streaming DataFrame with fitted tables
"""

from kestrel.session import get_spark, ensure_checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "ensure_checkpoint_dir"]
