"""In-sample error of the concentration model (Q5/M6) on training CSVs.

Usage: python tools/model_quality.py file.csv [file.csv ...]
Each CSV has Date (dd-MM-yyyy), Brine_In, Brine_Out, Initial_Concentration_(gpl),
Final_Concentration_(gpl). Fits with the reference's capacity knobs (80/20 seeded
split, rows of both parts scored) and prints MAE / RMSE per file.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from pondflow.plans import forecast as fc  # noqa: E402
from pondflow.session import get_spark  # noqa: E402
from pondflow.sources import csv as C  # noqa: E402

COLUMNS = {"Brine_In": "brine_in", "Brine_Out": "brine_out",
           "Initial_Concentration_(gpl)": "initial_concentration",
           "Final_Concentration_(gpl)": "final_concentration"}


def main() -> None:
    spark = get_spark("local[8]", app="pondflow-quality", shuffle_partitions=8)
    for path in sys.argv[1:]:
        name = os.path.basename(path)
        df = C.read_readings(spark, path, COLUMNS, hourly=False, site=name)
        model = fc.fit_concentration_model(df, keys=["site"])
        scored = fc.score_final_concentration(model, df, None, None, keys=["site"])
        j = scored.join(df.select("site", "date", "final_concentration"), ["site", "date"])
        err = F.col("predicted_final") - F.col("final_concentration")
        m = j.agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.count("*").alias("n")).first()
        print(f"{name}: n={m['n']} MAE={m['mae']:.4f} RMSE={m['rmse']:.4f}")
    spark.stop()


if __name__ == "__main__":
    main()
