"""Map every SURVEY §2 operator id to the functions that implement it.

Usage: python tools/coverage_map.py > COVERAGE.md
An id counts as implemented by a function when it is named in that function's
docstring or body (ranges such as ``W3-W8`` expand to every id in between).
Also lists, per id, the registered driver queries that exercise it
(``pondflow.plans.catalog.QUERY_IDS``).
"""

from __future__ import annotations

import ast
import os
import re
import sys
from collections import defaultdict

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

GROUPS = {"S": 10, "K": 6, "P": 17, "J": 5, "A": 11, "W": 13, "O": 5, "U": 1, "F": 25, "M": 17, "Q": 11}
ID = re.compile(r"\b([SKPJAWOUFMQ])(\d{1,2})(?:\s*[-–]\s*\1?(\d{1,2}))?\b")


def ids_in(text: str) -> set[str]:
    out = set()
    for g, a, b in ID.findall(text):
        lo, hi = int(a), int(b) if b else int(a)
        if g in GROUPS and 1 <= lo <= hi <= GROUPS[g]:
            out |= {f"{g}{i}" for i in range(lo, hi + 1)}
    return out


def scan() -> dict[str, set[str]]:
    where: dict[str, set[str]] = defaultdict(set)
    pkg = os.path.join(ROOT, "pondflow")
    for dirpath, _, files in os.walk(pkg):
        for f in files:
            if not f.endswith(".py") or f == "catalog.py":
                continue
            path = os.path.join(dirpath, f)
            mod = os.path.relpath(path, ROOT)[:-3].replace(os.sep, ".")
            src = open(path).read()
            lines = src.splitlines()
            tree = ast.parse(src)
            spans = []
            for node in ast.walk(tree):
                if isinstance(node, (ast.FunctionDef, ast.ClassDef)) and not node.name.startswith("_"):
                    spans.append((node.lineno, node.end_lineno, node.name))
            spans.sort(key=lambda s: s[1] - s[0])     # innermost first
            for i, line in enumerate(lines, 1):
                for id_ in ids_in(line):
                    owner = next((n for a, b, n in spans if a <= i <= b), None)
                    where[id_].add(f"{mod}.{owner}" if owner else mod)
    return where


def main() -> None:
    where = scan()
    from pondflow.plans.catalog import QUERIES, QUERY_IDS
    unknown = set(QUERY_IDS) ^ set(QUERIES)
    if unknown:
        raise SystemExit(f"QUERY_IDS and the registered queries differ: {sorted(unknown)}")
    qids: dict[str, set[str]] = defaultdict(set)
    for name, ids in QUERY_IDS.items():
        for i in ids.split():
            qids[i].add(name)
    print("# SURVEY §2 coverage\n")
    print("Generated by `tools/coverage_map.py`: for every operator id, the functions naming it and")
    print("the registered driver queries exercising it (`catalog.QUERY_IDS`).\n")
    print("| id | implemented in | driver queries |")
    print("|---|---|---|")
    missing = []
    for g, n in GROUPS.items():
        for i in range(1, n + 1):
            k = f"{g}{i}"
            fns = ", ".join(f"`{x}`" for x in sorted(where.get(k, ()))) or "—"
            qs = ", ".join(sorted(qids.get(k, ()))) or "—"
            if not where.get(k):
                missing.append(k)
            print(f"| {k} | {fns} | {qs} |")
    print(f"\nIds without an implementing function: {', '.join(missing) if missing else 'none'}.")


if __name__ == "__main__":
    main()
