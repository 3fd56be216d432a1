"""Files of the corpus writers: temporary names, renames and manifests on any store that Arrow opens."""

from __future__ import annotations

import json
import uuid

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class TempFile:
    """A file written under a temporary name of its own and renamed when whole.

    What a task writes is a function of its input alone, so a second attempt
    at the same file replaces it by the same bytes.
    """

    def __init__(self, folder: str, name: str) -> None:
        self.fs, self.folder = opened(folder)
        self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)
        self.uri, self.to = f"{folder}/{name}", f"{self.folder}/{name}"
        self.temp = f"{self.folder}/_temporary/{name}-{uuid.uuid4().hex}"
        self.out, self.size = self.fs.open_output_stream(self.temp, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.to)

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temp)


def write_manifest(folder: str, rows: list[dict], kind: str) -> None:
    """The commit point of a write: readers take the files that the manifest names and no others."""
    out = TempFile(folder, "_MANIFEST.json")
    out.write(json.dumps({"kind": kind, "files": rows}, sort_keys=True).encode())
    out.commit()


def read_manifest(folder: str) -> list[dict]:
    fs, path = opened(folder)
    with fs.open_input_stream(f"{path}/_MANIFEST.json") as f:
        return json.loads(f.read())["files"]
