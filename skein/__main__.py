"""python -m skein index|query: the command line."""

import argparse
import json

from skein.engine import Engine, check_sizes
from skein.session import get_spark


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="skein")
    p.add_argument("--store", required=True, help="folder of the tables")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("--repo-path", required=True)
    for name, default in (("chunk-size", 400), ("chunk-overlap", 64), ("batch-size", 64)):
        i.add_argument(f"--{name}", type=int, default=default)
    i.add_argument("--dry-run", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("question")
    q.add_argument("--mode", choices=("vector", "graph", "hybrid"), default="hybrid")
    q.add_argument("--top-k", type=int, default=10)
    q.add_argument("--language")
    q.add_argument("--file-pattern")
    q.add_argument("--min-score", type=float, default=0.0)
    q.add_argument("--expand", action="store_true")
    q.add_argument("--strict-filters", action="store_true")
    q.add_argument("--context", action="store_true", help="print the context for a language model")
    a = p.parse_args(argv)
    if a.command == "index":
        check_sizes(a.chunk_size, a.chunk_overlap, a.batch_size)
    engine = Engine(get_spark(), a.store)
    if a.command == "index":
        print(json.dumps(engine.index(a.repo_path, a.chunk_size, a.chunk_overlap, a.batch_size, a.dry_run)))
        return
    found = engine.search(a.question, a.mode, a.top_k, a.language, a.file_pattern, a.min_score, expand=a.expand, strict_filters=a.strict_filters)
    if a.context and a.mode != "graph":
        print(engine.context(found))
    else:
        for r in found.collect():  # at most top_k
            print(json.dumps({k: v for k, v in r.asDict(recursive=True).items() if k != "embedding"}, default=str))


if __name__ == "__main__":
    main()
