"""``python -m graftline``: the operators on a file or standard input.

The last action wins; without one, documents are flattened. With ``--lines``
every line is a document and Spark works on the file; otherwise the input is one
document.
"""

from __future__ import annotations

import argparse
import sys

from .functions import columns, jsontext, values


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"{self.prog}: {message}\n")


def _action(name: str, count: int):
    class Choose(argparse.Action):
        def __call__(self, parser, namespace, given, option=None):
            namespace.action = (name, list(given) if count else [])

    return {"action": Choose, "nargs": count, "dest": "action"}


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="graftline", description=__doc__)
    p.add_argument("-f", "--flatten", **_action("flatten", 0))
    p.add_argument("-s", "--schema", **_action("schema", 0))
    p.add_argument("-e", "--remove-empty", **_action("remove_empty", 0))
    p.add_argument("-n", "--remove-nulls", **_action("remove_nulls", 0))
    p.add_argument("-r", "--replace-keys", **_action("replace_keys", 2), metavar=("PATTERN", "NAME"))
    p.add_argument("-v", "--replace-values", **_action("replace_values", 2), metavar=("PATTERN", "VALUE"))
    p.add_argument("--paths", **_action("paths", 0), help="paths with types")
    p.add_argument("-t", "--threads", type=int, default=0, help="tasks at a time, 0 for one a core")
    p.add_argument("-p", "--pretty", action="store_true", help="for filters and replacements; the others are pretty anyhow")
    p.add_argument("-o", "--output", help="file to write, or folder with --lines")
    p.add_argument("--lines", action="store_true", help="a document a line, on Spark")
    p.add_argument("input", nargs="?", default="-")
    return p


def _step(action: str, given: list[str]):
    return {
        "flatten": columns.flatten_step,
        "paths": columns.paths_step,
        "remove_empty": columns.remove_empty_strings_step,
        "remove_nulls": columns.remove_nulls_step,
        "replace_keys": columns.replace_keys_step,
        "replace_values": columns.replace_values_step,
    }[action](*given)


def _on_lines(args, action: str, given: list[str]) -> str | None:
    from pyspark.sql import SparkSession

    from .operators import schema
    from .sources import files

    threads = min(max(args.threads, 0), 128)
    spark = SparkSession.builder.master(f"local[{threads or '*'}]").getOrCreate()
    df = files.line_files(spark, args.input)
    if action == "schema":
        return schema.batch_schema(files.numbered_lines(spark, args.input), "json", "position", pretty=True)
    out = df.select(columns.pipeline("json", [_step(action, given)]).alias("json"))
    if args.output:
        files.write_lines(out, args.output)
        return None
    for row in out.toLocalIterator():  # as it comes, a partition at a time
        print(row[0])
    return None


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    action, given = args.action or ("flatten", [])
    try:
        if args.lines:
            text = _on_lines(args, action, given)
            if text is None:
                return 0
        else:
            source = sys.stdin if args.input == "-" else open(args.input, encoding="utf-8")  # noqa: SIM115
            with source:
                value = jsontext.parse(source.read())
            pretty = args.pretty or action in ("flatten", "paths")
            text = jsontext.dump(values.schema_of(value), True) if action == "schema" else jsontext.dump(_step(action, given)(value), pretty)
    except (OSError, ValueError) as e:
        print(f"graftline: {e}", file=sys.stderr)
        return 1
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)
    return 0
