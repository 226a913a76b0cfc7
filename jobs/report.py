"""Dashboard tables: one small parquet table per view (volume trend, months,
vintage, daily intensity, odometer box, correlations) plus the records CSV.

    python jobs/report.py --sf-dir /root/testdata/sf0.01 --out /path/report
"""
import argparse

from _common import add_common, load_input, session


def main():
    p = argparse.ArgumentParser(description=__doc__)
    add_common(p)
    p.add_argument("--out", required=True)
    p.add_argument("--weak-only", action="store_true")
    args = p.parse_args()
    spark = session(args)

    from pyspark import StorageLevel

    from gearlens import schema as S
    from gearlens.functions.timefx import time_features
    from gearlens.operators import prep as P
    from gearlens.operators import profile as PR
    from gearlens.operators import trends as TR
    from gearlens.sources.io import write_records_csv, write_table
    df = load_input(spark, args)
    # the views share a handful of columns: keep that narrow projection once
    cols = P.present(df, [S.KEY, S.TIME, S.REG_YEAR, S.REG_YEAR_ALT, S.REG_MONTH, S.ODOMETER, S.FUEL, S.TARGET])
    base = df.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    out = args.out.rstrip("/")
    numbers = time_features(base, with_month_name=True) if S.TIME in cols else base
    corr_cols = P.present(numbers, [S.REG_YEAR, S.MONTH_NUM, S.ODOMETER, S.TARGET])
    views = {
        "volume_trend": TR.volume_trend(base, count_col=None),
        "monthly_volume": TR.monthly_volume(base),
        "vintage": TR.vintage(base),
        "daily_intensity": TR.daily_intensity_histogram(base, 30),
        "odometer_box": PR.box_summary(base, S.ODOMETER),
        "correlation": PR.pearson_matrix(numbers, corr_cols),
    }
    for name, view in views.items():
        write_table(view, f"{out}/{name}")
    write_records_csv(P.records_view(base, weak_only=args.weak_only), f"{out}/records_csv")
    base.unpersist()


if __name__ == "__main__":
    main()
