"""Operators of a training-data pipeline (ten methods and their queries).

Nothing else in the library imports this subpackage."""
