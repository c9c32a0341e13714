"""Settings from TOML. What is not known is an error, and so is what doesn't fit together."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_args, get_origin, get_type_hints

from .errors import EngineError
from .governance import Limits


class ConfigError(EngineError):
    """A setting that is unknown, of the wrong type or out of range."""


@dataclass(frozen=True)
class Storage:
    buffer_bytes: int = 64 << 20
    sync: str = "on_commit"
    flush_timeout_ms: int = 60_000


@dataclass(frozen=True)
class Wal:
    segment_bytes: int = 64 << 20


@dataclass(frozen=True)
class Runs:
    #: Bytes of a row group of a run, and how often its Bloom filter may be wrong.
    block_bytes: int = 128 << 20
    bloom_fpr: float = 0.01
    #: Compare the checksums of all runs when a log is opened.
    verify: bool = True


@dataclass(frozen=True)
class Leveled:
    l0_files: int = 4
    base_bytes: int = 64 << 20
    multiplier: int = 10
    max_level: int = 6


@dataclass(frozen=True)
class Tiered:
    max_per_tier: int = 4


@dataclass(frozen=True)
class Compaction:
    strategy: str = "leveled"
    leveled: Leveled = field(default_factory=Leveled)
    tiered: Tiered = field(default_factory=Tiered)


@dataclass(frozen=True)
class Server:
    statements: int = 64
    timeout_ms: int | None = None
    scan_rows: int = 10_000
    sort_rows: int = 10_000
    join_rows: int = 10_000
    result_rows: int = 10_000
    result_bytes: int = 4 << 20
    connections: int = 128
    request_bytes: int = 1 << 20
    memory_intensive: int = 16
    queries_per_identity: int | None = None

    def limits(self) -> Limits:
        return Limits(self.scan_rows, self.sort_rows, self.join_rows, self.result_rows, self.result_bytes, self.statements, self.timeout_ms)


@dataclass(frozen=True)
class User:
    name: str = ""
    password: str = field(default="", repr=False)
    role: str = "reader"


@dataclass(frozen=True)
class Token:
    name: str = ""
    token: str = field(default="", repr=False)
    role: str = "reader"


@dataclass(frozen=True)
class Tls:
    mode: str = "disabled"
    cert: str = ""
    key: str = ""


@dataclass(frozen=True)
class Security:
    auth: str = "disabled"
    users: tuple[User, ...] = ()
    tokens: tuple[Token, ...] = ()
    tls: Tls = field(default_factory=Tls)

    def check(self) -> None:
        def distinct(values: list[str], what: str) -> None:
            if not all(v.strip() for v in values) or len(set(values)) < len(values):
                raise ConfigError(f"security: each {what} must be given, once")

        if self.auth not in ("disabled", "password", "token"):
            raise ConfigError("security.auth must be disabled, password or token")
        if self.tls.mode not in ("disabled", "required"):
            raise ConfigError("security.tls.mode must be disabled or required")
        known = {"password": self.users, "token": self.tokens}.get(self.auth)
        if known is not None:
            if not known:
                raise ConfigError(f"security.auth = {self.auth!r} needs at least one identity")
            if self.tls.mode != "required":
                raise ConfigError("authentication needs security.tls.mode = 'required'")
        distinct([u.name for u in self.users], "user's name")
        distinct([t.name for t in self.tokens], "token's name")
        distinct([t.token for t in self.tokens], "token")
        if not all(u.password for u in self.users):
            raise ConfigError("security: each user needs a password")
        if bad := {i.role for i in (*self.users, *self.tokens)} - {"admin", "writer", "reader"}:
            raise ConfigError(f"security: unknown role {sorted(bad)[0]!r}")
        if self.tls.mode == "required" and not (self.tls.cert and self.tls.key):
            raise ConfigError("security.tls needs cert and key")


@dataclass(frozen=True)
class Config:
    storage: Storage = field(default_factory=Storage)
    wal: Wal = field(default_factory=Wal)
    runs: Runs = field(default_factory=Runs)
    security: Security = field(default_factory=Security)
    compaction: Compaction = field(default_factory=Compaction)
    server: Server = field(default_factory=Server)

    def check(self) -> Config:
        def positive(part: Any, path: str) -> None:
            for f in fields(part):
                value = getattr(part, f.name)
                if is_dataclass(value):
                    positive(value, f"{path}{f.name}.")
                elif isinstance(value, (int, float)) and not isinstance(value, bool) and value <= 0:
                    raise ConfigError(f"{path}{f.name} must be > 0")

        positive(self, "")
        if self.storage.sync not in ("never", "on_commit", "always"):
            raise ConfigError("storage.sync must be never, on_commit or always")
        if self.compaction.strategy not in ("leveled", "tiered"):
            raise ConfigError("compaction.strategy must be leveled or tiered")
        if self.compaction.leveled.multiplier < 2:
            raise ConfigError("compaction.leveled.multiplier must be >= 2")
        if self.runs.bloom_fpr >= 1:
            raise ConfigError("runs.bloom_fpr must be < 1")
        self.security.check()
        return self


def _made(kind: type, said: dict, path: str) -> Any:
    hints = get_type_hints(kind)
    unknown = sorted(set(said) - set(hints))
    if unknown:
        raise ConfigError(f"unknown setting {path}{unknown[0]}")
    out = {}
    for name, value in said.items():
        wanted = hints[name]
        if is_dataclass(wanted):
            if not isinstance(value, dict):
                raise ConfigError(f"{path}{name} must be a table")
            out[name] = _made(wanted, value, f"{path}{name}.")
        elif get_origin(wanted) is tuple:
            if not isinstance(value, list) or not all(isinstance(v, dict) for v in value):
                raise ConfigError(f"{path}{name} must be a list of tables")
            out[name] = tuple(_made(get_args(wanted)[0], v, f"{path}{name}.") for v in value)
        else:
            takes = {str: (str,), bool: (bool,), float: (float, int)}.get(wanted, (int,))
            if not isinstance(value, takes) or (isinstance(value, bool) and wanted is not bool):
                raise ConfigError(f"{path}{name} has the wrong type")
            out[name] = value
    return kind(**out)


def from_toml(text: str) -> Config:
    """Settings from a TOML document; what it leaves out has its default."""
    try:
        said = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"not TOML: {e}") from e
    return _made(Config, said, "").check()


def flat(part: Any, path: str = "") -> dict[str, Any]:
    """Settings by their dotted names."""
    out: dict[str, Any] = {}
    for f in fields(part):
        value, name = getattr(part, f.name), path + f.name
        if is_dataclass(value):
            out |= flat(value, f"{name}.")
        elif isinstance(value, tuple):
            for k, v in enumerate(value):
                out |= flat(v, f"{name}.{k}.")
        else:
            out[name] = value
    return out


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return from_toml(f.read())
