"""python -m gleaner init|index|search|get|add|eval: exit code 0, 1 for errors, 2 for no hits or not found."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .sources.output import hit_json, hit_lines, json_array
from .workspace import Workspace


MODES = ("hybrid", "vector", "text")
#: The flags of each command (all take --db), and how many arguments it takes.
COMMANDS = {
    "init": ((), (0, 1)),
    "index": (("include-code!", "prune!"), (1, None)),
    "search": (("mode", "k#", "tag*", "json!", "expand-top#", "expand-budget#"), (1, 1)),
    "get": (("lines", "para#", "context#"), (1, 1)),
    "add": (("tag*",), (1, 1)),
    "eval": (("mode", "k#"), (1, 1)),
}
USAGE = "usage: gleaner " + "|".join(COMMANDS) + " [flags] [arguments]\n" + "".join(f"  {c}: --db " + " ".join("--" + f.rstrip("!#*") for f in flags) + "\n" for c, (flags, _) in COMMANDS.items())


class Arguments(argparse.ArgumentParser):
    """Flags and arguments of one command, in any order; -- ends the flags; what is wrong is an exception, not an exit."""

    def __init__(self, command: str) -> None:
        super().__init__(f"gleaner {command}", add_help=False, allow_abbrev=False)
        flags, (least, most) = COMMANDS[command]
        self.add_argument("-h", "-help", "--help", dest="help", action="store_true")
        self.add_argument("-db", "--db")
        for f in flags:
            name = f.rstrip("!#*")
            dest = {"dest": name.replace("-", "_")}
            both = (f"-{name}", f"--{name}")
            if f.endswith("!"):
                self.add_argument(*both, action="store_true", **dest)
            elif f.endswith("#"):
                self.add_argument(*both, type=int, default={"k": 10, "para": None}.get(name, 0), **dest)
            elif f.endswith("*"):
                self.add_argument(*both, action="append", default=[], **dest)
            else:
                self.add_argument(*both, default="hybrid" if name == "mode" else None, **dest)
        self.add_argument("args", nargs="*")
        self.command, self.least, self.most = command, least, most

    def error(self, message: str) -> None:
        raise ValueError(message)

    def of(self, argv: list[str]) -> argparse.Namespace:
        cut = argv.index("--") if "--" in argv else len(argv)
        a = self.parse_intermixed_args(argv[:cut])
        a.args += argv[cut + 1 :]
        if not a.help and not self.least <= len(a.args) <= (self.most or len(a.args)):
            raise ValueError(f"{self.command}: wrong number of arguments")
        return a


def run(argv: list[str], spark: SparkSession | None = None, stdin=None) -> int:
    if argv and argv[0] in ("-h", "-help", "--help"):
        print(USAGE, end="", file=sys.stderr)
        return 0
    if not argv or argv[0] not in COMMANDS:
        print(USAGE, end="", file=sys.stderr)
        return 1
    command, a = argv[0], Arguments(argv[0]).of(argv[1:])
    if a.help:
        print(USAGE, end="", file=sys.stderr)
        return 0
    if command == "init":
        print(Workspace.init(*a.args or ["."]))
        return 0
    if command in ("search", "eval") and a.mode not in MODES:
        raise ValueError(f"unknown mode {a.mode!r}")
    if command == "search":
        if a.expand_top < 0 or a.expand_budget < 0:
            raise ValueError("expand-top and expand-budget must not be negative")
        if (a.expand_top == 0) != (a.expand_budget == 0):
            raise ValueError("expansion needs both expand-top and expand-budget")
        if a.expand_top and not a.json:
            raise ValueError("expansion needs --json")
    if command == "add" and os.path.exists(a.args[0]):
        raise FileExistsError(a.args[0])
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    ws = Workspace(spark, a.db)
    if command == "index":
        say = lambda what, text: print(f"pruned {text}") if what == "pruned" else print(text, file=sys.stderr)
        print(", ".join(f"{n} {what}" for what, n in ws.index(a.args, a.include_code, a.prune, say).items()))
    elif command == "search":
        hits = ws.search(a.args[0], a.mode, a.k, a.tag, a.expand_top, a.expand_budget)
        rows = hits.orderBy("rank").select("stale", hit_json(hits).alias("json"), hit_lines(hits).alias("text")).collect()  # k rows
        if not rows:
            print("no hits", file=sys.stderr)
            return 2
        if n := sum(r.stale for r in rows):
            print(f"warning: {n} of the hits are of files that have changed since they were indexed; index them again", file=sys.stderr)
        print(json_array([r.json for r in rows]) if a.json else "\n".join(r.text for r in rows))
    elif command == "get":
        span = tuple(map(int, a.lines.split("-"))) if a.lines else None
        got = ws.get(a.args[0], span, a.para, a.context)
        if got is None:
            print("not found", file=sys.stderr)
            return 2
        print(got)
    elif command == "add":
        text = (stdin or sys.stdin).read()
        ws.add(os.path.relpath(os.path.abspath(a.args[0]), ws.root), text, a.tag)
    elif command == "eval":
        recall, hits, cases, missed = ws.eval(a.args[0], a.mode, a.k)
        for query, doc, para in missed:
            print(f"miss: {query} -> {doc}" + (f"#{para}" if para is not None else ""))
        print(f"recall@{a.k}: {recall:.3f} ({hits}/{cases})")
    return 0


def main() -> int:
    try:
        return run(sys.argv[1:])
    except Exception as e:  # noqa: BLE001  any failure is exit code 1 with its message
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
