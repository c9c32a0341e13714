"""A line client: ``python -m brindle.cli HOST PORT``.

SQL, or ``\\explain SQL``, ``\\timing``, ``\\queries``, ``\\cancel N``, ``\\status``, ``\\q``.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterable

from .server import Client, Kind, RequestError


def shown(said: dict) -> str:
    if "columns" in said:
        return "\n".join(["\t".join(said["columns"]), *["\t".join(r) for r in said["rows"]], f"({len(said['rows'])} rows)"])
    if "plan" in said:
        return said["plan"]
    return ", ".join(f"{k}: {v}" for k, v in said.items())


def run(client: Client, lines: Iterable[str], write=print) -> None:
    timing = False
    for line in lines:
        text = line.strip()
        if text == "\\q":
            return
        if text == "\\timing":
            timing = not timing
            write(f"timing {'on' if timing else 'off'}")
            continue
        if not text:
            continue
        command, _, rest = text.partition(" ")
        kinds = {"\\explain": Kind.EXPLAIN, "\\queries": Kind.ACTIVE_STATEMENTS, "\\cancel": Kind.CANCEL_STATEMENT, "\\status": Kind.ADMIN_STATUS}
        began = time.perf_counter()
        try:
            write(shown(client.request(kinds[command], rest) if command in kinds else client.sql(text)))
        except RequestError as e:
            write(f"error {e.code}: {e}")
        if timing:
            write(f"{1000 * (time.perf_counter() - began):.0f} ms")


if __name__ == "__main__":
    run(Client((sys.argv[1], int(sys.argv[2]))), sys.stdin)
