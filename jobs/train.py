"""Batch training job: read -> features -> split -> fit -> R^2 -> save.

    python jobs/train.py --sf-dir /root/testdata/sf0.01 --model /path/model
"""
import argparse

from _common import add_common, load_input, session


def main():
    p = argparse.ArgumentParser(description=__doc__)
    add_common(p)
    p.add_argument("--model", required=True, help="output folder of the fitted pipeline model")
    p.add_argument("--pipeline", choices=["production", "explore"], default="production")
    p.add_argument("--kind", choices=["decision_tree", "random_forest", "boosted", "leafwise", "depthwise"], default="leafwise")
    p.add_argument("--rounds", type=int, help="of the boosted kinds, instead of their default")
    args = p.parse_args()
    spark = session(args)

    from gearlens.plans import model as ML
    from gearlens.plans import pipelines as PL
    df = load_input(spark, args)
    ff = PL.production_features(df) if args.pipeline == "production" else PL.explore_features(df)
    tr, va, te = ML.split(ff.df)
    params = {} if args.rounds is None else {"maxIter": args.rounds} if args.kind == "boosted" else {"rounds": args.rounds} if args.kind in ML.BOOSTERS else {}
    model, metrics = ML.final_fit(tr, va, te, ff.features, args.kind, **params)
    metrics.show(truncate=False)
    ML.save_model(model, args.model)
    ML.save_columns(spark, ff.features, args.model.rstrip("/") + "_columns")


if __name__ == "__main__":
    main()
