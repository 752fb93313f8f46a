"""Files on any file system that pyarrow opens by its address; a plain path is a local one."""

from __future__ import annotations

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def open_file(path: str, mode: str = "r"):
    """A file to read (with seek) or to write; folders above a new file are made."""
    system, inner = _at(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    if mode == "w":
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(inner)
    return system.open_input_file(inner)


def listing(path: str, ending: str, missing_ok: bool = False) -> list[tuple[str, int]]:
    """(path, bytes) of the files with an ending at or below a path, by name; hidden ones are left out."""
    system, inner = _at(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        if missing_ok:
            return []
        raise FileNotFoundError(path)
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    host = path[len(scheme) :].split("/", 1)[0] if scheme and scheme != "file://" else ""
    found = [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and f.base_name.endswith(ending) and not f.base_name.startswith(".")]
    return [(f"{scheme}{host}{f.path}" if scheme else f.path, f.size) for f in sorted(found, key=lambda f: f.path)]


def rename(old: str, new: str) -> None:
    system, inner = _at(old)
    system.move(inner, _at(new)[1])


def remove(path: str) -> None:
    system, inner = _at(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        system.delete_file(inner)
