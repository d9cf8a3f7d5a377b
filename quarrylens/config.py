"""Settings of endpoints and display as YAML, with a default in place of every unusable value."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path

# Default endpoints and display settings, and the accepted names.
COLORS = ("GREEN_BRIGHT", "RED_BRIGHT", "YELLOW_BRIGHT", "CYAN_BRIGHT", "MAGENTA_BRIGHT", "BLUE_BRIGHT", "WHITE_BRIGHT")
DENSITIES = ("COMPACT", "COMFORTABLE", "LARGE")


@dataclass(frozen=True)
class Endpoint:
    host: str
    port: int

    def state(self) -> str | None:
        """INVALID for an endpoint that can't be tried."""
        return None if self.host.strip() and 1 <= self.port <= 65535 else "INVALID"


@dataclass(frozen=True)
class VectorStore:
    host: str
    httpPort: int
    grpcPort: int


@dataclass(frozen=True)
class Theme:
    onlineColor: str = "GREEN_BRIGHT"
    offlineColor: str = "RED_BRIGHT"
    invalidColor: str = "YELLOW_BRIGHT"


@dataclass(frozen=True)
class Display:
    mouseEnabled: bool = True
    density: str = "COMFORTABLE"


@dataclass(frozen=True)
class Settings:
    neo4j: Endpoint = Endpoint("localhost", 7687)
    qdrant: VectorStore = VectorStore("localhost", 6333, 6334)
    mongodb: Endpoint = Endpoint("localhost", 27017)
    theme: Theme = field(default_factory=Theme)
    ui: Display = field(default_factory=Display)


def _usable(name: str, value, default):
    """One field: the value if it can be used, else the default."""
    if name.lower().endswith("port"):
        return value if isinstance(value, int) and not isinstance(value, bool) and 0 < value <= 65535 else default
    if name == "mouseEnabled":
        return value if isinstance(value, bool) else False  # a section without the flag has it off
    text = value.strip() if isinstance(value, str) else ""
    if name == "host":
        return text or default
    known = DENSITIES if name == "density" else COLORS
    return text.upper() if text.upper() in known else default


def normalized(given: dict | None) -> Settings:
    """Field by field: blank hosts, ports out of range and unknown names give way to defaults; a
    section that is missing is the default one."""
    given, parts = given if isinstance(given, dict) else {}, {}
    for name, default in vars(Settings()).items():
        own = given.get(name)
        parts[name] = type(default)(**{k: _usable(k, own.get(k), v) for k, v in vars(default).items()}) if isinstance(own, dict) else default
    return Settings(**parts)


def _scalar(text: str):
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    text = text.split(" #")[0].strip()
    if text in ("true", "false"):
        return text == "true"
    return int(text) if text.removeprefix("-").isdigit() else None if text in ("", "null", "~") else text


def parsed(text: str) -> dict:
    """Sections of ``name: value`` lines, the part of YAML that settings use."""
    out, section = {}, None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        name, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"no setting: {line!r}")
        if line[0] in " \t":
            if section is None:
                raise ValueError(f"in no section: {line!r}")
            section[name.strip()] = _scalar(value)
        else:
            section = out[name.strip()] = {}
            if value.strip():
                out[name.strip()], section = _scalar(value), None
    return out


def load(path: str | Path) -> Settings:
    """Settings of a YAML file; defaults if it is missing or can't be read."""
    try:
        return normalized(parsed(Path(path).read_text(encoding="utf-8")))
    except (OSError, ValueError):
        return Settings()


def save(settings: Settings, path: str | Path) -> None:
    """Writes what ``normalized`` makes of the settings."""
    lines = []
    for name, own in asdict(normalized(asdict(settings))).items():
        lines.append(f"{name}:")
        for k, v in own.items():
            shown = str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else '"' + v + '"'
            lines.append(f"  {k}: {shown}")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")
