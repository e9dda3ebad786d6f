"""Operators for large training-data pipelines. Nothing else in weftline imports this subpackage."""
