"""Score request records with a saved model, in batch or as a stream.

    python jobs/score.py --requests /path/requests --model /path/model --out /path/scores [--stream]
"""
import argparse

from _common import session


def main():
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--requests", required=True, help="folder of JSON-lines requests")
    p.add_argument("--model", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--stream", action="store_true", help="Structured Streaming, processes what is there")
    p.add_argument("--checkpoint", help="stream checkpoint (default: under spark.checkpoint.dir)")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--shuffle-partitions", type=int, default=8)
    args = p.parse_args()
    spark = session(args)

    from gearlens.plans import model as ML
    from gearlens.plans.score import score_requests
    from gearlens.sources.io import write_table
    from gearlens.sources.requests import read_requests
    model = ML.load_model(args.model)
    cols = ML.load_columns(spark, args.model.rstrip("/") + "_columns")
    out = args.out.rstrip("/")
    if args.stream:
        from gearlens.streaming.score_stream import run_to_completion, score_stream
        run_to_completion(score_stream(spark, args.requests, out, model, cols, checkpoint=args.checkpoint))
        return
    scored, rejected = score_requests(read_requests(spark, args.requests), model, cols)
    write_table(scored, f"{out}/scored")
    write_table(rejected, f"{out}/rejected")


if __name__ == "__main__":
    main()
