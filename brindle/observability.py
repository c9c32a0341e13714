"""Logging as the environment asks for.

``BRINDLE_LOG`` is a list like ``info,brindle.server=debug``: a level for all of
the library, and levels by logger. ``BRINDLE_LOG_TARGET=0`` leaves the logger's
name out of the lines.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping

from .config import ConfigError

LEVELS = {"off": logging.CRITICAL + 1, "error": logging.ERROR, "warn": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG, "trace": 5}
ROOT = "brindle"


def levels(text: str) -> dict[str, int]:
    """Levels by logger; the library's is ``info`` unless stated."""
    out = {ROOT: logging.INFO}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, equals, level = part.rpartition("=")
        name = name.strip() if equals else ROOT
        if not name or level.strip().lower() not in LEVELS:
            raise ConfigError(f"BRINDLE_LOG: {part!r} is neither a level nor logger=level")
        out[name] = LEVELS[level.strip().lower()]
    return out


def init_logging(env: Mapping[str, str] | None = None) -> dict[str, int]:
    """Set the levels and one handler on standard error; calling it again sets them anew."""
    env = os.environ if env is None else env
    found = levels(env.get("BRINDLE_LOG", ""))
    shows = env.get("BRINDLE_LOG_TARGET", "1").strip().lower() not in ("0", "false", "no", "off")
    top = logging.getLogger(ROOT)
    for handler in [h for h in top.handlers if h.get_name() == ROOT]:
        top.removeHandler(handler)
    handler = logging.StreamHandler()
    handler.set_name(ROOT)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s " + ("%(name)s: " if shows else "") + "%(message)s"))
    top.addHandler(handler)
    top.propagate = False
    for name, level in found.items():
        logging.getLogger(name).setLevel(level)
    return found
