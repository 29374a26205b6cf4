"""Scalar column functions: physics (F9-F20), dates (F1-F8), numeric."""

from pondflow.functions import dates, numeric, physics  # noqa: F401
