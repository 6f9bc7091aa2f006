"""Unified diffs as rows of changed files and changed lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.documents import each_text
from docloom.session import stored

_HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _path(name: str) -> str | None:
    name = name.split("\t")[0].strip()
    return None if name == "/dev/null" else name.split("/", 1)[-1] if name[:2] in ("a/", "b/") else name


def parsed(text: str) -> Iterator[tuple[str, str, str, int | None, str]]:
    """(path, status, sign, line, text) of the added and removed lines of a diff, line in the new file, null for removed
    ones; a file without any has one row with an empty sign. status: A, D, R (the new name counts) or M. What a hunk holds is
    counted off from its head, so a line of the file that looks like a head of the diff isn't taken for one."""
    old = new = moved = None
    rows: list[tuple[str, int | None, str]] = []
    left, right, at = 0, 0, 0

    def told() -> Iterator[tuple[str, str, str, int | None, str]]:
        path = new or old
        if path:
            status = "R" if moved else "A" if old is None else "D" if new is None else "M"
            yield from ((path, status, *r) for r in rows or [("", None, "")])

    for line in text.split("\n"):
        if left or right:
            if line.startswith("+"):
                rows.append(("+", at, line[1:]))
                right, at = right - 1, at + 1
            elif line.startswith("-"):
                rows.append(("-", None, line[1:]))
                left -= 1
            elif not line.startswith("\\"):
                left, right, at = left - 1, right - 1, at + 1
        elif line.startswith("diff --git "):
            yield from told()
            rows, moved = [], False
            # Names of a file without hunks; those of --- and +++ take their place.
            names = line.removeprefix("diff --git ").split(" b/", 1)
            old, new = _path(names[0]), names[1] if len(names) > 1 else None
        elif line.startswith("new file"):
            old = None
        elif line.startswith("deleted file"):
            new = None
        elif line.startswith("rename to "):
            new, moved = line.removeprefix("rename to "), True
        elif line.startswith("--- "):
            old = _path(line[4:])
        elif line.startswith("+++ "):
            new = _path(line[4:])
        elif m := _HUNK.match(line):
            left, right, at = int(m[1] or 1), int(m[3] or 1), int(m[2])
    yield from told()


def diff_tables(diffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The changes (diff, path, status) and the lines (diff, path, sign, line, text) of diffs (diff, text), as the operators
    on documents take them. Null texts have none."""
    kind = diffs.schema["diff"].dataType.simpleString()
    rows = stored(each_text(diffs.filter("text is not null"), ["diff", "text"], f"diff {kind}, path string, status string, sign string, line int, text string", lambda d, t: [(d, *r) for r in parsed(t)]))
    return rows.select("diff", "path", "status").distinct(), rows.filter(F.col("sign") != "").select("diff", "path", "sign", "line", "text")
