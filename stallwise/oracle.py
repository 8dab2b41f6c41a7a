"""Check SQL of the registered queries, kept in ``oracle/*.sql``.

A file holds several statements, each under a line ``-- key: <name>``.
"""

from __future__ import annotations

from pathlib import Path

FOLDER = Path(__file__).resolve().parent.parent / "oracle"
MARK = "-- key:"


def statements() -> dict[str, str]:
    found: dict[str, str] = {}
    for path in sorted(FOLDER.glob("*.sql")):
        for block in path.read_text(encoding="utf-8").split(MARK)[1:]:
            name, _, sql = block.partition("\n")
            found[name.strip()] = sql.strip().rstrip(";")
    return found
