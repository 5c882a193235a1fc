"""Files below a path on any file system, and manifests that say which of them count."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyarrow import fs


class Storage:
    """A folder on a local mount or in a store that ``pyarrow.fs`` opens by its address (``s3://``, ``gs://``, ``abfs://``, ``hdfs://``)."""

    def __init__(self, path: str) -> None:
        url = urlparse(path)
        if url.scheme in ("", "file"):
            self.fs, self.root = fs.LocalFileSystem(), os.path.abspath(unquote(url.path) if url.scheme else path)
        else:
            self.fs, self.root = fs.FileSystem.from_uri(path)
        self.root = self.root.rstrip("/") or "/"

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def list(self, name: str = "") -> list[tuple[str, int]]:
        """``(name, bytes)`` of the files in a folder by name, or of the one file there; nothing where there is none. One listing, no file is opened."""
        info = self.fs.get_file_info(self.at(name))
        if info.type == fs.FileType.File:
            return [(name, info.size)]
        found = self.fs.get_file_info(fs.FileSelector(self.at(name), allow_not_found=True))
        return sorted((f"{name}/{x.base_name}" if name else x.base_name, x.size) for x in found if x.type == fs.FileType.File)

    def open(self, name: str):
        """For reads of byte ranges."""
        return self.fs.open_input_file(self.at(name))

    def create(self, name: str):
        """A stream to a new file; stores show it when it is closed."""
        self.folder(os.path.dirname(name))
        return self.fs.open_output_stream(self.at(name), compression=None)

    def folder(self, name: str) -> None:
        if isinstance(self.fs, fs.LocalFileSystem):
            os.makedirs(self.at(name), exist_ok=True)

    def remove(self, name: str) -> None:
        if self.fs.get_file_info(self.at(name)).type == fs.FileType.File:
            self.fs.delete_file(self.at(name))

    def put_new(self, name: str, data: bytes) -> bool:
        """Whole file at once, and False where ``name`` is taken.

        A local mount gets it by a hard link, which one of several writers makes; a store shows an object when it is whole,
        and there the last of two writers that meet within the same instant stands.
        """
        if not isinstance(self.fs, fs.LocalFileSystem):
            if self.fs.get_file_info(self.at(name)).type != fs.FileType.NotFound:
                return False
            with self.create(name) as f:
                f.write(data)
            return True
        self.folder(os.path.dirname(name))
        own = f"{os.path.dirname(self.at(name))}/.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.write(data)
        try:
            os.link(own, self.at(name))
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(own)


class Manifests:
    """Commits of a folder, numbered from 0: each names the files that a write added, and whether it replaces those before it.

    A file counts once a manifest names it, so a write that was killed leaves nothing that a reader sees, and nothing is
    renamed. A write has an id: a second commit under the same id changes nothing.
    """

    FOLDER = "_manifest"

    def __init__(self, storage: Storage) -> None:
        self.storage, self._known = storage, {}

    def _names(self) -> list[str]:
        return [name for name, _ in self.storage.list(self.FOLDER) if name.endswith(".json") and not os.path.basename(name).startswith(".")]

    def _all(self) -> list[dict]:
        """A manifest never changes, so each is read once."""
        names = self._names()
        for name in names:
            if name not in self._known:
                with self.storage.open(name) as f:
                    self._known[name] = json.loads(f.read())
        return [self._known[name] for name in names]

    def any(self) -> bool:
        return bool(self._names())

    def commits(self) -> list[dict]:
        """Commits that count, in order: from the last one that replaces all before it."""
        found = self._all()
        last = max((i for i, m in enumerate(found) if m["replaces"]), default=0)
        return found[last:]

    def next(self) -> int:
        return len(self._names())

    def commit(self, write: str, files: list[dict], replaces: bool = False, about: dict | None = None) -> bool:
        """Make ``files`` count; False if this write did so before."""
        while True:
            found = self._all()
            if any(m["write"] == write for m in found):
                return False
            data = {"write": write, "replaces": replaces, "files": files, "about": about or {}}
            if self.storage.put_new(f"{self.FOLDER}/{len(found):010d}.json", json.dumps(data).encode()):
                return True
