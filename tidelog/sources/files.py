"""Atomic files, fault hooks and the exclusive lock. The control plane is on a local file system; data files are Spark's."""

from __future__ import annotations

import fcntl
import os
from collections.abc import Callable
from pathlib import Path

from tidelog.errors import Locked

#: Test hooks by place; a hook that raises stands for a failure there.
FAULTS: dict[str, Callable[[], None]] = {}


def fault(place: str) -> None:
    if place in FAULTS:
        FAULTS[place]()


def sync_folder(path: Path) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def replace(path: Path, data: bytes, place: str) -> None:
    """Writes a file so that it is either the old or the new one: temporary file, sync, rename, sync of the folder."""
    temporary = path.with_name(path.name + ".tmp")
    with open(temporary, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    fault(f"{place}.before_rename")
    os.replace(temporary, path)
    fault(f"{place}.after_rename")
    sync_folder(path.parent)


class Lock:
    """One store to a folder, by whatever path it is named."""

    def __init__(self, folder: Path):
        self.file = open(folder.resolve() / "LOCK", "w")  # noqa: SIM115
        try:
            fcntl.flock(self.file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            self.file.close()
            raise Locked(str(folder)) from e

    def release(self) -> None:
        self.file.close()
