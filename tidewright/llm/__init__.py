"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; intermediate tables go to the shared folder the cluster names in
``spark.checkpoint.dir``.
"""
