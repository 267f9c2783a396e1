"""Configuration: immutable values on the driver, from defaults, a ``.env`` file and the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace
from datetime import timedelta
from enum import Enum
from pathlib import Path
from typing import Any

#: Prefix of environment variables, e.g. EVENTLOOM_GAP_MINUTES=30.
PREFIX = "EVENTLOOM_"


class Mode(Enum):
    """What happens to inbox files: copied, moved, or nothing (dry run)."""

    COPY = 1
    MOVE = 2
    NOP = 3


class Representative(Enum):
    """Which member's date names a new event."""

    RANDOM = 1
    MEDIAN = 2


class Grouping(Enum):
    """How files are grouped into events."""

    TIME_GAP = 1


class Status(Enum):
    """State of a media file during an import."""

    UNKNOWN = 0
    NEW_CLUSTER = 1
    EXISTING_CLUSTER = 2
    DUPLICATE = 3


# File types, catalogue file name.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".dng", ".cr2", ".tif", ".tiff", ".heic")
VIDEO_EXTENSIONS = (".mp4", ".3gp", "mov")
INI_NAME = ".cluster.ini"
#: Default folders: (system, development?) to inbox, outbox, libraries.
FOLDERS = {
    ("nt", False): ("C:\\Media\\inbox", "C:\\Media\\events", ("C:\\Media\\library",)),
    ("nt", True): (".\\inbox", ".\\events", (".\\library",)),
    ("posix", False): ("/srv/media/inbox", "/srv/media/events", ("/srv/media/library",)),
    ("posix", True): ("./inbox", "./events", ("./library",)),
}


@dataclass(frozen=True)
class Config:
    """All settings of an import."""

    inbox: str
    outbox: str
    libraries: tuple[str, ...] = ()
    image_extensions: tuple[str, ...] = IMAGE_EXTENSIONS
    video_extensions: tuple[str, ...] = VIDEO_EXTENSIONS
    gap: timedelta = timedelta(minutes=60)
    representative: Representative = Representative.MEDIAN
    grouping: Grouping = Grouping.TIME_GAP
    mode: Mode = Mode.MOVE
    deep_scan: bool = False
    use_existing: bool = False
    skip_duplicates: bool = False
    restore_names: bool = False
    seed: int = 0
    #: Folder of the table of library summaries; None: ini files only.
    catalogue: str | None = None

    @property
    def extensions(self) -> tuple[str, ...]:
        return self.image_extensions + self.video_extensions

    def __getitem__(self, name: str) -> Any:
        if name not in {f.name for f in fields(self)}:
            raise KeyError(name)
        return getattr(self, name)

    def __setitem__(self, name: str, value: Any) -> None:
        self[name]
        object.__setattr__(self, name, value)

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)

    def validated(self) -> "Config":
        """Itself, if duplicates and existing events have a library to look in."""
        if (self.skip_duplicates or self.use_existing) and not self.libraries:
            raise ValueError("duplicate detection and existing events need at least one library folder")
        return self


def _environment(env_file: str | None) -> dict[str, str]:
    found: dict[str, str] = {}
    if env_file and os.path.isfile(env_file):
        for line in Path(env_file).read_text().splitlines():
            name, eq, value = line.strip().partition("=")
            if eq and not name.startswith("#"):
                found[name.strip()] = value.strip().strip("'\"")
    found.update(os.environ)
    return {k[len(PREFIX) :].lower(): v for k, v in found.items() if k.startswith(PREFIX)}


def _flag(value: str) -> bool:
    if value.strip().lower() in ("1", "true", "yes", "on"):
        return True
    if value.strip().lower() in ("0", "false", "no", "off"):
        return False
    raise ValueError(f"not a flag: {value!r}")


def _words(value: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in value.strip("[]").replace('"', "").split(",") if x.strip())


#: Names in the environment to field and parser.
_PARSERS = {
    "inbox": ("inbox", str),
    "outbox": ("outbox", str),
    "libraries": ("libraries", _words),
    "image_extensions": ("image_extensions", lambda v: tuple(x.lower() for x in _words(v))),
    "video_extensions": ("video_extensions", lambda v: tuple(x.lower() for x in _words(v))),
    "gap_minutes": ("gap", lambda v: timedelta(minutes=float(v))),
    "representative": ("representative", lambda v: Representative[v.upper()]),
    "mode": ("mode", lambda v: Mode[v.upper()]),
    "deep_scan": ("deep_scan", _flag),
    "use_existing": ("use_existing", _flag),
    "skip_duplicates": ("skip_duplicates", _flag),
    "restore_names": ("restore_names", _flag),
    "seed": ("seed", int),
    "catalogue": ("catalogue", str),
}


def load(development: bool = False, system: str | None = None, env_file: str | None = ".env") -> Config:
    """Defaults of the system (``nt`` or any other) and mode, overridden by the environment.

    Development copies, production moves.
    """
    key = ("nt" if (system or os.name) == "nt" else "posix", development)
    inbox, outbox, libraries = FOLDERS[key]
    config = Config(inbox=inbox, outbox=outbox, libraries=libraries, mode=Mode.COPY if development else Mode.MOVE)
    changes = {field: parse(value) for name, value in _environment(env_file).items() if name in _PARSERS for field, parse in [_PARSERS[name]]}
    return replace(config, **changes)


def override(
    config: Config,
    *,
    inbox: str | os.PathLike | None = None,
    outbox: str | os.PathLike | None = None,
    libraries: list | tuple | None = None,
    deep_scan: bool | None = None,
    no_operation: bool | None = None,
    copy: bool | None = None,
    skip_duplicates: bool | None = None,
    use_existing: bool | None = None,
    restore_names: bool | None = None,
    **others: Any,
) -> Config:
    """A changed copy; None keeps a value, no_operation wins over copy, unknown names are left out."""
    named: Mapping[str, Any] = {
        "inbox": None if inbox is None else os.fspath(inbox),
        "outbox": None if outbox is None else os.fspath(outbox),
        "libraries": None if libraries is None else tuple(os.fspath(x) for x in libraries),
        "deep_scan": deep_scan,
        "skip_duplicates": skip_duplicates,
        "use_existing": use_existing,
        "restore_names": restore_names,
    }
    known = {f.name for f in fields(config)}
    changes = {k: v for k, v in {**others, **named}.items() if v is not None and k in known}
    if copy:
        changes["mode"] = Mode.COPY
    if no_operation:
        changes["mode"] = Mode.NOP
    return replace(config, **changes).validated()


def library_arguments(value: None | list | tuple) -> list[str]:
    """Library folders as given on a command line; anything but None or a list is an error."""
    if value is None:
        return []
    if not isinstance(value, (list, tuple)):
        raise TypeError(f"library folders must be a list, not {type(value).__name__}")
    return list(value)


def get_default_config() -> Config:
    return load(False)


def get_development_config(os_name: str = os.name) -> Config:
    return load(True, os_name)


def get_proper_mode_config(is_development_mode: bool) -> Config:
    return load(is_development_mode)


#: Parameters of override_config_with_cli_params that ``override`` names otherwise.
_OTHER_NAMES = {
    "inbox_dir": "inbox", "output_dir": "outbox", "watch_dir_list": "libraries", "force_deep_scan": "deep_scan", "copy_mode": "copy",
    "drop_duplicates": "skip_duplicates", "use_existing_clusters": "use_existing", "restore_original_names": "restore_names",
}


def override_config_with_cli_params(config: Config, **values: Any) -> Config:
    """``override`` by the older names of its parameters."""
    return override(config, **{_OTHER_NAMES.get(name, name): value for name, value in values.items()})
