"""Result labels and key normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label texts as the reference shows them.
ZONE_NAME = "Zone-B"
CALCULATION = "Calculation"
PREDICTION = "Prediction"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def result_label(mode, pond, verb: str = PREDICTION) -> Column:
    """``'<verb> for Zone-B'`` in zone mode, ``'<verb> for <pond>'`` in pond mode.

    Without a pond in pond mode a prediction is labelled ``'Prediction'`` and a
    calculation gets an empty label, as in the reference.
    """
    mode, pond = _c(mode), _c(pond)
    fallback = F.lit(PREDICTION) if verb == PREDICTION else F.lit("")
    return (F.when(mode == "a", F.lit(f"{verb} for {ZONE_NAME}"))
            .when((mode == "b") & pond.isNotNull() & (pond != ""), F.concat(F.lit(f"{verb} for "), pond))
            .otherwise(fallback))


def site_key(s, case: str = "upper") -> Column:
    """case-normalised site key (the reference mixes ``upper``/``lower``)."""
    s = F.trim(_c(s))
    return F.upper(s) if case == "upper" else F.lower(s)
