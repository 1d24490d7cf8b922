"""Files opened by their Spark path, in tasks: any store that pyarrow knows (local disks, HDFS, S3, GCS, ABFS)."""

from __future__ import annotations

from urllib.parse import quote

from pyarrow.fs import FileSystem, LocalFileSystem


def located(path: str) -> tuple[FileSystem, str]:
    """The file system of a path as Spark prints it, and the path there."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return LocalFileSystem(), path
    if scheme == "file":
        return LocalFileSystem(), "/" + rest.lstrip("/")
    return FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")
