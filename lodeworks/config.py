"""Settings of the engine, read from a mapping such as the environment and checked."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from urllib.parse import urlsplit

MIN_RATE = 0.01
#: Names that were settings once, and what took their place.
REMOVED = {
    "MAX_CONCURRENCY": "one request at a time for each host",
    "MAX_CONCURRENCY_CEILING": "nothing",
    "MAX_REQUESTS_PER_SECOND": "REQUESTS_PER_SECOND_PER_DOMAIN",
    "MAX_REQUESTS_PER_SECOND_CEILING": "nothing",
}


class ConfigError(ValueError):
    """A setting that can't be used; the message names it."""


def _number(name: str, text: str, least: float) -> float:
    try:
        value = float(text)
    except ValueError:
        raise ConfigError(f"{name}: {text!r} is no number") from None
    if not math.isfinite(value) or value <= 0 or value < least:
        raise ConfigError(f"{name}: {text!r} has to be finite, above 0 and {least} at least")
    return value


def _whole(name: str, text: str, least: float) -> int:
    try:
        return int(text)
    except ValueError:
        raise ConfigError(f"{name}: {text!r} is no whole number") from None


def origin(url: str) -> str:
    """Scheme, host and port of a URL, which holds nothing else."""
    parts = urlsplit(url.strip())
    if parts.scheme not in ("http", "https") or not parts.hostname or parts.path not in ("", "/") or parts.query or parts.fragment or parts.username or parts.password:
        raise ConfigError(f"not an origin: {url!r}")
    try:
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        raise ConfigError(f"not an origin: {url!r}") from None
    return f"{parts.scheme}://{parts.hostname}{port}"


def _origins(name: str, text: str, least: float) -> tuple[str, ...]:
    out = tuple(map(origin, text.split(",")))
    for url in out:
        if out.count(url) > 1:
            raise ConfigError(f"{name}: {url} is listed more than once")
    return out


def _plain(name: str, text: str, least: float) -> str:
    return text


def _setting(name: str, default, read=_whole, least: float = 0.0, also: str = ""):
    return field(default=default, metadata={"name": name, "read": read, "least": least, "also": also})


@dataclass(frozen=True)
class EngineConfig:
    """Each field's setting, its default, and how it is read. Settings without a value have their default."""

    hosts: tuple[str, ...] = _setting("BASE_URLS", (), _origins, also="BASE_URL")
    site_zone: str = _setting("SITE_TZ", "UTC", _plain)
    backfill_days: int = _setting("BACKFILL_DAYS", 30)
    rate: float = _setting("REQUESTS_PER_SECOND_PER_DOMAIN", 1.0, _number, MIN_RATE)
    cooldown: float = _setting("BLOCK_COOLDOWN_SECONDS", 60.0, _number)
    timeout: float = _setting("REQUEST_TIMEOUT_SECONDS", 15.0, _number)
    lookahead: int = _setting("FRONTIER_LOOKAHEAD", 500)
    dry_streak: int = _setting("FRONTIER_DRY_STREAK", 200)
    chunk: int = _setting("BACKFILL_CHUNK_SIZE", 500)
    confirm_window: int = _setting("BACKFILL_CONFIRM_WINDOW", 100)
    safety_margin: int = _setting("BACKFILL_SAFETY_MARGIN_IDS", 200)
    retry_batch: int = _setting("RETRY_BATCH_SIZE", 200)
    refresh_batch: int = _setting("REFRESH_BATCH_SIZE", 200)
    cycle_seconds: int = _setting("CYCLE_INTERVAL", 60)
    match_batch: int = _setting("MATCH_BATCH_SIZE", 25)

    @classmethod
    def from_mapping(cls, env: Mapping[str, str]) -> "EngineConfig":
        for name, instead in REMOVED.items():
            if env.get(name):
                raise ConfigError(f"{name} is no longer a setting; in its place: {instead}")
        values = {}
        for f in fields(cls):
            how = f.metadata
            text = env.get(how["name"]) or env.get(how["also"])
            if text:
                values[f.name] = how["read"](how["name"], text, how["least"])
        return cls(**values)

    @property
    def gap(self) -> float:
        """Seconds between two requests of a host."""
        return 1 / self.rate
