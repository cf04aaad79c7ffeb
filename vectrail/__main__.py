"""Commands over a stored collection: python -m vectrail --path FOLDER COMMAND ...; results come as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from vectrail import __version__
from vectrail.operators import bm25, hybrid, knn, stats
from vectrail.functions.filters import from_dict
from vectrail.session import build_session, materialize
from vectrail.sources import store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("vectrail", description=__doc__)
    p.add_argument("--path", help="folder of the collection")
    p.add_argument("--namespace", default="default")
    p.add_argument("--master", default="local[*]")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("insert", "update"):
        commands.add_parser(name).add_argument("--file", required=True, help="JSON lines with id, embedding, text, metadata")
    for name in ("search", "hybrid-search"):
        c = commands.add_parser(name)
        c.add_argument("--embedding", required=True, type=json.loads)
        c.add_argument("-k", type=int, default=10)
        c.add_argument("--filter", type=json.loads)
        if name == "search":
            c.add_argument("--metric", default="cosine")
        else:
            c.add_argument("--text", required=True)
            c.add_argument("--method", default="rrf", choices=sorted(hybrid.METHODS))
    commands.add_parser("delete").add_argument("--ids", required=True, type=json.loads)
    for name in ("stats", "health", "version"):
        commands.add_parser(name)
    return p


def run(args: argparse.Namespace, spark=None) -> list[dict]:
    """The rows that a command prints."""
    if args.command == "version":
        return [{"version": __version__}]
    if not args.path:
        raise ValueError("--path is required")
    spark = spark or build_session(args.master)
    there = Path(args.path).exists() or "://" in args.path
    rows = store.load(spark, args.path) if there else spark.createDataFrame([], store.SCHEMA)
    shown = lambda df: [json.loads(line) for line in df.toJSON().collect()]
    condition = from_dict(args.filter).column() if getattr(args, "filter", None) else None
    if args.command in ("insert", "update", "delete"):
        if args.command == "delete":
            ids = spark.createDataFrame([(args.namespace, int(i)) for i in args.ids], "ns string, id bigint")
            counts, new = {"deleted": rows.join(ids, ["ns", "id"], "left_semi").count()}, store.delete_ids(rows, ids)
        else:
            given = spark.read.schema("id bigint, embedding array<float>, text string, metadata map<string,string>").json(args.file).selectExpr(f"'{args.namespace}' as ns", "*")
            if args.command == "insert":
                batch = store.batch_insert(rows, given)
                counts, new = batch.summary.first().asDict(), batch.rows
            else:
                counts, new = {"updated": rows.join(given, ["ns", "id"], "left_semi").count()}, store.update(rows, given)
        store.save(materialize(new, "collection"), args.path)  # written elsewhere first: the table that is read is replaced
        return [counts]
    if args.command == "stats":
        return shown(stats.by_namespace(rows))
    if args.command == "health":
        return [{"status": "ok", "records": rows.count()}]
    mine = store.in_namespace(rows, args.namespace)
    if args.command == "search":
        return shown(knn.search(mine, args.embedding, args.k, args.metric, "id", before=condition).select("id", "distance", "metadata"))
    mine = mine if condition is None else mine.where(condition)
    q = spark.createDataFrame([(0, [float(x) for x in args.embedding])], "query_id int, embedding array<float>")
    hits = bm25.search(bm25.index(mine.where("text is not null"), "id"), bm25.single(args.text, spark), 2 * args.k).withColumnRenamed("doc_id", "id")
    return shown(hybrid.fuse(knn.search_many(mine, q, 2 * args.k, id_col="id"), hits, args.k, args.method).drop("query_id"))


def main() -> None:
    try:
        for row in run(parser().parse_args()):
            print(json.dumps(row))
    except ValueError as wrong:
        sys.exit(str(wrong))


if __name__ == "__main__":
    main()
