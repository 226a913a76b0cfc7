"""Search job: the draws of one of the notebook's two spaces with their mean R^2 over
three folds, best first.

    python jobs/search.py --sf-dir /root/testdata/sf0.01 --space leafwise --out /path/scores
"""
import argparse

from _common import add_common, load_input, session


def main():
    p = argparse.ArgumentParser(description=__doc__)
    add_common(p)
    p.add_argument("--space", choices=["depthwise", "leafwise"], default="leafwise")
    p.add_argument("--draws", type=int, help="instead of the space's own number")
    p.add_argument("--folds", type=int, default=3)
    p.add_argument("--out", required=True, help="folder of the scores (parquet)")
    args = p.parse_args()
    spark = session(args)

    from gearlens.plans import booster as BO
    from gearlens.plans import model as ML
    from gearlens.plans import pipelines as PL
    ff = PL.production_features(load_input(spark, args))
    base, n, space = BO.SPACES[args.space]
    found = BO.boosted_search(ML.split(ff.df)[0], ff.features, space, args.draws or n, args.folds, base)
    scores = BO.search_table(spark, found, space)
    scores.write.mode("overwrite").parquet(args.out)
    scores.orderBy(scores["mean_cv_r2"].desc()).show(5, truncate=False)


if __name__ == "__main__":
    main()
