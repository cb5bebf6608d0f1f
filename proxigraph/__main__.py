"""python -m proxigraph --dataset FILE --k N [--metric l2|inner_product] [--algorithm brute_force|nn_descent] [--output FILE]"""

from __future__ import annotations

import argparse
import sys

from proxigraph import __version__

EXIT_USAGE, EXIT_FAILED = 2, 1


def _positive(text: str) -> int:
    if not text.isascii() or not text.isdigit() or int(text) == 0:
        raise argparse.ArgumentTypeError(f"{text!r} is no positive whole number")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="proxigraph", description="Builds a k-nearest-neighbour graph of a .fvecs or .bvecs file.", allow_abbrev=False)
    p.add_argument("--dataset", required=True)
    p.add_argument("--k", required=True, type=_positive)
    p.add_argument("--metric", choices=["l2", "inner_product"], default="l2")
    p.add_argument("--algorithm", choices=["brute_force", "nn_descent"], default="brute_force")
    p.add_argument("--output", help="by default the dataset's name with .graph")
    p.add_argument("--version", action="version", version=f"proxigraph {__version__}")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import functions as F

    from proxigraph.operators.exact import exact_knn
    from proxigraph.operators.nn_descent import nn_descent
    from proxigraph.session import get_session
    from proxigraph.sources.graph_file import write_graph
    from proxigraph.sources.vecs import read_vecs
    from proxigraph.storage import through_files

    spark = get_session()
    try:
        vecs = through_files(read_vecs(spark, args.dataset).select("vec_id", F.col("v").cast("array<double>").alias("v")), "dataset")
        build = exact_knn if args.algorithm == "brute_force" else nn_descent
        write_graph(build(vecs, args.k, metric=args.metric), args.output or args.dataset + ".graph", vecs.count(), args.k, args.metric)
    except (ValueError, OSError) as e:
        print(f"proxigraph: {e}", file=sys.stderr)
        return EXIT_FAILED
    return 0


if __name__ == "__main__":
    sys.exit(main())
