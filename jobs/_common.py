"""Shared argument handling of the job scripts."""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def load_input(spark, args):
    """The inspection table: a file/folder (--data) or derived from the
    driver tables (--sf-dir)."""
    from gearlens.session import configure, input_bytes
    from gearlens.sources.driver_tables import inspections
    from gearlens.sources.io import read_inspections
    df = inspections(spark, args.sf_dir) if args.sf_dir else read_inspections(spark, args.data)
    # size scans and shuffles to the input (see session.scale_conf), on any master
    configure(spark, input_bytes=input_bytes(df))
    if args.shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(args.shuffle_partitions))
    return df


def session(args):
    """The session that ``spark-submit`` describes: a master set here would win
    over its ``--master``, so none is, unless this script is given one."""
    from gearlens.session import configure
    from pyspark.sql import SparkSession
    builder = SparkSession.builder.appName("gearlens")
    if args.master:
        builder = builder.master(args.master)
    return configure(builder.getOrCreate())


def add_common(parser):
    parser.add_argument("--data", help="inspection table (csv/parquet/json)")
    parser.add_argument("--sf-dir", help="derive the inspection table from driver tables")
    parser.add_argument("--master", help="only where spark-submit does not set it")
    parser.add_argument("--shuffle-partitions", type=int, help="instead of the number that fits the input")
