"""``python -m tessera NAME [ROOT]``: files of this name under a folder, or suggestions with their matches coloured."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators.heatmap import BRIGHT, CYAN, GRAY, RESET, YELLOW
from tessera.sources.files import file_tree, find_files

LEGEND = ((BRIGHT, "in place"), (YELLOW, "in a block"), (CYAN, "by itself"), (GRAY, "not matched"))


def report(rows: list) -> str:
    """Paths of exact files, or suggestions from the best on."""
    if not rows:
        return "No files."
    if rows[0].score is None:
        return "\n".join([f"{len(rows)} of this name:", *(f"  {r.path}" for r in rows)])
    lines = [f"None of this name; {len(rows)} suggestions:", "  ".join(f"{colour}#{RESET} {what}" for colour, what in LEGEND)]
    return "\n".join(lines + [f"  {r.shown} ({r.score:.4f})\n    {r.path}" for r in rows])


def main(args: list[str]) -> int:
    if not 1 <= len(args) <= 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    print(report(find_files(file_tree(spark, args[1] if len(args) > 1 else "."), args[0]).orderBy(F.desc("score"), "path").collect()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
