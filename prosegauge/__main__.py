"""Command line. Exit 0: done; 1: failed; 2: wrong usage, before anything is read or written.

python -m prosegauge corpus FOLDER [--json FILE] [--out FOLDER]
python -m prosegauge text TARGET [--project FOLDER] [--json FILE]
python -m prosegauge evidence FOLDER [--json FILE]
python -m prosegauge maturity ANSWERS [--json FILE]
python -m prosegauge report FINDINGS EVIDENCE MATURITY [--state FILE] [--out FILE]

A folder alone is audited as a corpus.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("prosegauge", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter, allow_abbrev=False)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *targets: str, **options: str) -> None:
        one = commands.add_parser(name, allow_abbrev=False)
        for target in targets:
            one.add_argument(target)
        for option in options:
            one.add_argument(f"--{option}")

    command("corpus", "folder", json="", out="")
    command("text", "target", project="", json="")
    command("evidence", "folder", json="")
    command("maturity", "answers", json="")
    command("report", "findings", "evidence", "maturity", state="", out="")
    return parser


def _write(path: str | None, value: object) -> None:
    if path:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(value, f, indent=2, ensure_ascii=False)


def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def run(a: argparse.Namespace, now: str) -> None:
    from prosegauge.plans import entries

    if a.command == "report":  # from files of earlier runs; no Spark
        state = _load(a.state)["snapshots"] if a.state and os.path.exists(a.state) else []
        text, snapshots = entries.gap_report(_load(a.findings)["totals"], _load(a.evidence), _load(a.maturity), state, now)
        if a.state:
            _write(a.state, {"snapshots": snapshots})
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("prosegauge").getOrCreate()
    if a.command == "evidence":
        found = entries.evidence(spark, a.folder)
        _write(a.json, found)
        print("| Category | Found | Paths |\n|---|---|---|")
        for c, x in found["artefacts"].items():
            print(f"| {c} | {'yes' if x['found'] else 'no'} | {len(x['paths'])} |")
    elif a.command == "maturity":
        levels = entries.maturity(spark, a.answers)
        _write(a.json, levels)
        print("| Dimension | Level | Missing |\n|---|---|---|")
        for d, x in levels["dimensions"].items():
            print(f"| {d} | {x['level']} | {', '.join(x['missing']) or '-'} |")
        print(f"Overall: {levels['overall']}")
    else:
        text = a.command == "text"
        one = entries.Audit(spark, a.target if text else a.folder, (a.project or os.getcwd()) if text else None)
        for r in one.skipped.orderBy("path").toLocalIterator():
            print(f"skipped {r.path}: {r.reason}", file=sys.stderr)
        if a.json:
            entries.findings_file(one, a.json)
        if not text and a.out:
            entries.write_findings(one, a.out)
        if text:
            for row in one.table():
                print(row)
        else:
            totals = one.totals()
            print("| Rule | Violations |\n|---|---|")
            for rule, n in totals:
                print(f"| {rule} | {n} |")
            print(f"{sum(n for _, n in totals)} findings in {one.corpus.count()} files")
        one.close()


def main(args: list[str], now: str | None = None) -> int:
    if args and args[0] not in ("corpus", "text", "evidence", "maturity", "report") and not args[0].startswith("-"):
        args = ["corpus", *args]
    try:
        parsed = arguments().parse_args(args)
    except SystemExit as stop:
        return int(stop.code or 0)
    try:
        run(parsed, now or datetime.now(timezone.utc).isoformat())
    except Exception as e:
        print(f"{parsed.command} failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
