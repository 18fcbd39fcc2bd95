"""Exclusive runs: a lock file with the owner's process id, and checks before a run."""

from __future__ import annotations

import contextlib
import glob
import os
from collections.abc import Iterator
from pathlib import Path


class Locked(RuntimeError):
    """Another live process holds the lock."""


def alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


@contextlib.contextmanager
def exclusive(path: str | Path, break_stale: bool = False) -> Iterator[None]:
    """Hold the lock file; one left by a crash stays a lock unless ``break_stale`` and its process is gone."""
    path = Path(path)
    for _ in range(2):
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            owner = path.read_text().strip()
            if not (break_stale and owner.isdigit() and not alive(int(owner))):
                raise Locked(f"{path} is held by {owner or 'an unknown process'}") from None
            path.unlink(missing_ok=True)
    else:
        raise Locked(str(path))
    with os.fdopen(handle, "w") as f:
        f.write(str(os.getpid()))
    try:
        yield
    finally:
        path.unlink(missing_ok=True)


# How a backup of a file may be called, by the file's name and its name without the suffix.
BACKUP_NAMES = ("{name}.backup", "{name}.backup-*", "{name}.backup.*", "{name}.*.backup", "{stem}-*.backup")


class NotReady(RuntimeError):
    """A run must not start."""


def backups(database: str | Path) -> list[Path]:
    """DML-27: non-empty, readable backups beside ``database``, by the order of the names and then sorted."""
    database = Path(database)
    found: dict[Path, None] = {}
    for pattern in BACKUP_NAMES:
        shape = pattern.format(name=glob.escape(database.name), stem=glob.escape(database.stem))
        found |= dict.fromkeys(sorted(database.parent.glob(shape)))
    return [p for p in found if p.is_file() and p.stat().st_size and os.access(p, os.R_OK)]


def backed_up(database: str | Path) -> Path:
    """DML-21: the first backup; raises ``NotReady`` without one."""
    found = backups(database)
    if not found:
        raise NotReady(f"no readable backup of {database}")
    return found[0]
