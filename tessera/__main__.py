"""``python -m tessera``: runs commands from standard input on the cluster program and prints what they give."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .cluster import program
from .plans.commands import Interpreter
from .plans.session import Session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("--delta", action="store_true", help="print the changes of every commit")
    parser.add_argument("--init-snapshot", action="store_true", help="print the output relations before the first command")
    parser.add_argument("--workers", type=int, default=0, help="local threads; 0: all cores, or the cluster that Spark is set to")
    parser.add_argument("--record", metavar="FILE", help="write the commands that succeeded to a file")
    options = parser.parse_args(argv)
    builder = SparkSession.builder.config("spark.ui.showConsoleProgress", "false")
    spark = (builder.master(f"local[{options.workers}]") if options.workers else builder).getOrCreate()
    record = open(options.record, "a", encoding="utf-8") if options.record else None  # noqa: SIM115
    interpreter = Interpreter(Session(spark, program()), sys.stdin.isatty(), (lambda text: print(text, file=record, flush=True)) if record else None)
    if options.init_snapshot:
        print(*interpreter.run("dump;"), sep="\n", flush=True)
    pending = ""
    for line in sys.stdin:  # a command may span lines; it ends with a semicolon at a line's end
        pending += line
        if line.rstrip().endswith(";"):
            text = pending.replace("commit;", "commit dump_changes;") if options.delta else pending
            failed = False
            for out in interpreter.run(text):
                print(out, flush=True)
                failed = failed or out.startswith("error: ")
            if (failed and not interpreter.interactive) or "exit;" in text:
                return
            pending = ""
    if pending.strip():
        print(*interpreter.run(pending), sep="\n", flush=True)


if __name__ == "__main__":
    main()
