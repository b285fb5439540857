"""Command line: python -m watchfold.plans.cli check|stage1|stage2|features|graph|sequences|stream|report ..."""

from __future__ import annotations

import argparse
import json

from ..functions.hashing import SALT
from ..operators import sequences
from ..session import session
from ..sources import logs, sinks
from ..streaming import live
from . import pipelines

GRAPH = [f"graph/{x}" for x in "nodes_user nodes_pc nodes_domain edges_used_pc edges_shared_pc edges_sent_email edges_browsed edges_device_on".split()]
EXPECTED = ["features", *(f"features_{x}" for x in sinks.WINDOW_NAMES.values()), "sequences", "scores", *GRAPH, "graph/ranks", "graph/mail"]
TASKS = "check stage1 stage2 features graph sequences stream report".split()


def streamed(spark, source: str, target: str, url: str | None) -> None:
    """Stage 2's user-days replayed as a stream: scored rows go to target/scored, threats to the url, each once. Runs until all files are through; a later run goes on."""
    rows = live.replay(spark, f"{source}/features", spark.read.parquet(f"{source}/features").schema)
    deliver = live.post_once(live.to_url(url), f"{target}/delivered", ["user", "date"]) if url else None

    def batch(df, number: int) -> None:
        # a folder a batch: one that is repeated replaces what it wrote
        df.write.mode("overwrite").parquet(f"{target}/scored/batch={number}")
        if deliver:
            deliver(live.threats(spark.read.parquet(f"{target}/scored/batch={number}")), number)

    live.write_available(live.enrich(rows), f"{target}/state").foreachBatch(batch).start().awaitTermination()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="watchfold")
    parser.add_argument("task", choices=TASKS)
    parser.add_argument("source")
    parser.add_argument("target", nargs="?")
    parser.add_argument("--no-http", action="store_true")
    parser.add_argument("--http-sample", type=int)
    parser.add_argument("--multi-line", action="store_true")
    parser.add_argument("--no-directory", action="store_true")
    parser.add_argument("--no-traits", action="store_true")
    parser.add_argument("--truth")
    parser.add_argument("--windows", default="24h,7d,30d,90d")
    parser.add_argument("--salt", default=SALT)
    parser.add_argument("--audit", help="file on the driver that the audit log is appended to")
    parser.add_argument("--url", help="where stream posts threats")
    args = parser.parse_args(argv)
    spark = session()
    audit = sinks.Audit(args.audit) if args.audit else None
    if audit:
        audit.log("start", task=args.task, source=args.source, target=args.target)
    if args.task == "check":
        print(json.dumps(logs.availability(spark, args.source)))
    elif args.task == "stream":
        streamed(spark, args.source, args.target, args.url)
    elif args.task == "report":
        print(json.dumps(sinks.completeness(spark, args.source, EXPECTED)))
    elif args.task == "stage1":
        pipelines.stage1(spark, args.source, args.target, args.salt, audit=audit, http=not args.no_http, http_sample=args.http_sample, directory=not args.no_directory, traits=not args.no_traits, multi_line=args.multi_line)
    else:
        web = () if args.no_http else ("http",)
        needed = {"graph": (("logon", "email", *web), ("device",)), "sequences": (("logon", "device", "file", "email", *web), ())}
        tables = logs.read_stage1(spark, args.source, *needed.get(args.task, (("logon",), ("device", "file", "email", *web))))
        truth = logs.read_ground_truth(spark, args.truth) if args.truth else None
        directory = None if args.no_directory else spark.read.parquet(f"{args.source}/ldap")
        traits = None if args.no_traits else spark.read.parquet(f"{args.source}/psychometric")
        windows = tuple(args.windows.split(","))
        if args.task == "stage2":
            pipelines.stage2(spark, tables, args.target, truth, directory, traits, windows)
        elif args.task == "features":
            sinks.write_parquet(pipelines.windowed_features(pipelines.with_context(pipelines.daily_features(tables), tables), windows), f"{args.target}/features")
        elif args.task == "graph":
            sinks.write_graph(*pipelines.graph_tables(tables, directory, traits), f"{args.target}/graph")
        else:
            sinks.write_parquet(sequences.encoded(sequences.unified(tables), truth), f"{args.target}/sequences")
    if audit:
        audit.log("end", task=args.task)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
