"""Small files in a shared folder, by path or URI, from the driver and from tasks: written whole or not at all."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def put(path: str, content: bytes) -> None:
    """A file of this content, which replaces one of that name: it is written beside it, then moved."""
    system, at = store(path)
    system.create_dir(posixpath.dirname(at), recursive=True)
    beside = posixpath.join(posixpath.dirname(at), f".{uuid.uuid4().hex}")
    with system.open_output_stream(beside) as out:
        out.write(content)
    system.move(beside, at)


def get(path: str) -> bytes | None:
    """The content of a file, None if there is none."""
    system, at = store(path)
    if system.get_file_info(at).type != fs.FileType.File:
        return None
    with system.open_input_stream(at) as file:
        return file.read()


def move(path: str, to: str) -> None:
    system, at = store(path)
    target = store(to)[1]
    system.create_dir(posixpath.dirname(target), recursive=True)
    system.move(at, target)


def drop(path: str) -> None:
    """Without a file of that name, if there was one."""
    system, at = store(path)
    if system.get_file_info(at).type == fs.FileType.File:
        system.delete_file(at)


def names(path: str) -> list[str]:
    """What is in a folder, sorted; hidden names left out. A folder that is not there is empty."""
    system, at = store(path)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(x.base_name for x in found if not x.base_name.startswith((".", "_")))
