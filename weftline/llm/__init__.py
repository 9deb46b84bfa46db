"""Operators of a training-data pipeline. Nothing else in weftline imports this subpackage."""
