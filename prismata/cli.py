"""Command line: ``python -m prismata.cli VERB ...``."""

from __future__ import annotations

import argparse
import json
import sys

from . import PrismataError, __version__, ask, clean, compare, fix, merge, ml_ready, profile, report, scan, validate, warnings
from .sources.readers import info


def _rules(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.lower().endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise PrismataError("YAML rules need PyYAML; use JSON") from e
        return yaml.safe_load(text)
    return json.loads(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("prismata")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *positional: str, **options):
        p = verbs.add_parser(name)
        for x in positional:
            p.add_argument(x, nargs="+" if x == "paths" else None)
        for k, kind in options.items():
            flag = "--" + k.replace("_", "-")
            p.add_argument(flag, **({"action": "store_true"} if kind is bool else {"type": kind}))
        return p

    verb("run", "path", out=str, cols=str)
    verb("profile", "path", sample_size=int)
    verb("scan", "path", json=bool, sample_size=int, correlate=bool)
    verb("compare", "path_a", "path_b", sample_size=int)
    verb("info", "path")
    verb("version")
    verb("fix", "path", apply=bool, output=str)
    verb("ml-ready", "path", target=str)
    verb("report", "path", output=str)
    verb("clean", "path", output=str, undo=bool)
    verb("merge", "paths", output=str)
    verb("warnings", "path", show_fixes=bool)
    verb("ask", "path", "question")
    verb("validate", "path", "rules", json=bool)
    return top


def run(args: argparse.Namespace) -> int:
    v = args.verb
    if v == "version":
        print(__version__)
    elif v == "info":
        for k, x in info(args.path).items():
            print(f"{k}: {x}")
    elif v == "run":
        found = scan(args.path)
        if args.cols:
            chosen = [c.strip() for c in args.cols.split(",")]
            found.columns = [c for c in found.columns if c.name in chosen]
        from .render import terminal_report

        print(terminal_report(found))
        if args.out:
            print(report(found, args.out))
    elif v == "profile":
        profile(args.path, args.sample_size)
    elif v == "scan":
        found = scan(args.path, args.sample_size, correlate=args.correlate)
        print(found.to_json(indent=2) if args.json else found)
    elif v == "compare":
        return int(compare(args.path_a, args.path_b, args.sample_size).verdict == "FAIL")
    elif v == "fix":
        done = fix(args.path, apply=args.apply)
        if done is not None and args.output:
            from .sources.sinks import write_table

            print(write_table(done, args.output))
    elif v == "ml-ready":
        ml_ready(args.path, args.target)
    elif v == "report":
        print(report(args.path, args.output))
    elif v == "clean":
        print(clean.undo(args.path)) if args.undo else clean(args.path, args.output)
    elif v == "merge":
        merge(args.paths, args.output or "combined.csv")
    elif v == "warnings":
        warnings(args.path, show_fixes=args.show_fixes)
    elif v == "ask":
        ask(args.path, args.question)
    elif v == "validate":
        found = validate(args.path, _rules(args.rules))
        if args.json:
            print(json.dumps({"passed": found.passed, "total_rules": found.total_rules, "failed_rules": found.failed_rules, "breaches": [b.__dict__ for b in found.all_breaches()]}))
        else:
            print(found)
        return int(found.failed)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except PrismataError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
