"""Checks of settings and bundles for support, without a Spark session.

``python -m brindle.admin config check [--config FILE]`` prints the settings in
force. ``... diagnostics bundle [--config FILE] [--root FOLDER] [--output FOLDER]
[--logs FOLDER] [--max-log-bytes N]`` makes a folder of them, of what lies in the
store's folder and of the ends of logs, with checksums. Values of secrets are
left out of both. Exit codes: 0 fine, 2 failed, 64 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import os
import platform
import re
import sys
import time
import zlib
from pathlib import Path

import pyspark

from . import config
from .errors import EngineError

SECRET = re.compile(r"password|secret|token|credential|(api|private|access)_?key", re.IGNORECASE)
HIDDEN = "<hidden>"
#: In logs: what follows the name of a secret, up to the end of the line.
IN_LOG = re.compile(rf"((?:{SECRET.pattern})\w*\s*[=:]\s*).*", re.IGNORECASE)


def shown(settings: config.Config) -> dict[str, object]:
    """Settings by name, secrets hidden."""
    return {name: HIDDEN if SECRET.search(name.rsplit(".", 1)[-1]) else value for name, value in config.flat(settings).items()}


def check(path: Path) -> dict[str, object]:
    """The settings in force with a file; what is wrong in it is an error."""
    try:
        settings = config.load(str(path))
    except OSError as e:
        raise config.ConfigError(f"{path} can't be read: {e.strerror}") from e
    for name in (settings.security.tls.cert, settings.security.tls.key):
        if name and not os.access(name, os.R_OK):
            raise config.ConfigError(f"security.tls: {name} can't be read")
    return shown(settings)


def folders(root: Path) -> dict[str, dict[str, int]]:
    """Number of files and bytes of each folder under ``root``."""
    out: dict[str, dict[str, int]] = {}
    for folder, _, names in os.walk(root):
        part = Path(folder).relative_to(root).parts
        held = out.setdefault(part[0] if part else ".", {"files": 0, "bytes": 0})
        for name in names:
            held["files"] += 1
            held["bytes"] += (Path(folder) / name).stat().st_size
    return out


def tails(logs: Path, into: Path, most: int) -> dict[str, int]:
    """The ends of all logs, newest first, of at most ``most`` bytes together; secrets hidden."""
    into.mkdir()
    found = sorted((p for p in logs.iterdir() if p.is_file()), key=lambda p: (-p.stat().st_mtime, p.name))
    out = {}
    for path in found:
        taken = min(most, path.stat().st_size)
        if taken <= 0:
            continue
        with path.open("rb") as f:
            f.seek(-taken, os.SEEK_END)
            text = f.read(taken).decode("utf-8", "replace")
        (into / path.name).write_text(IN_LOG.sub(rf"\1{HIDDEN}", text), encoding="utf-8")
        out[path.name] = taken
        most -= taken
    return out


def bundle(settings: Path, root: Path, output: Path, logs: Path | None, max_log_bytes: int) -> Path:
    """A new folder under ``output``; what can't be had is a warning in its manifest."""
    made = int(time.time())
    folder = output / f"bundle-{made}-{os.getpid()}"
    folder.mkdir(parents=True)
    said: dict[str, object] = {"made": made, "python": platform.python_version(), "spark": pyspark.__version__, "system": platform.platform()}
    warnings = []
    for name, work in (
        ("settings", lambda: check(settings)),
        ("storage", lambda: folders(root) or warnings.append(f"storage: {root} is not there")),
        ("logs", lambda: tails(logs, folder / "logs", max_log_bytes) if logs else {}),
    ):
        try:
            said[name] = work()
        except (EngineError, OSError) as e:
            warnings.append(f"{name}: {e}")
    (folder / "manifest.json").write_text(json.dumps(said | {"warnings": warnings}, indent=1, sort_keys=True), encoding="utf-8")
    sums = [f"{zlib.crc32(p.read_bytes()):08x}  {p.relative_to(folder)}" for p in sorted(folder.rglob("*")) if p.is_file()]
    (folder / "checksums.crc32").write_text("\n".join(sums) + "\n", encoding="utf-8")
    return folder


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(64, f"{message}\n")


def main(args: list[str] | None = None) -> int:
    parser = _Parser(prog="python -m brindle.admin")
    what = parser.add_subparsers(dest="what", required=True, parser_class=_Parser)
    checks = what.add_parser("config").add_subparsers(dest="verb", required=True, parser_class=_Parser).add_parser("check")
    bundles = what.add_parser("diagnostics").add_subparsers(dest="verb", required=True, parser_class=_Parser).add_parser("bundle")
    for p in (checks, bundles):
        p.add_argument("--config", type=Path, default=Path("brindle.toml"))
    bundles.add_argument("--root", type=Path, default=Path("data"))
    bundles.add_argument("--output", type=Path, default=Path("diagnostics"))
    bundles.add_argument("--logs", type=Path)
    bundles.add_argument("--max-log-bytes", type=int, default=1 << 20)
    said = parser.parse_args(args)
    try:
        if said.what == "config":
            for name, value in check(said.config).items():
                print(f"{name} = {value}")
        else:
            print(bundle(said.config, said.root, said.output, said.logs, said.max_log_bytes))
    except (EngineError, OSError) as e:
        print(f"failed: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
