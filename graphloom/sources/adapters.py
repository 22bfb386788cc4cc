"""Where repositories come from: adapters by kind, which give a path that Spark can read. Others may be added."""

from __future__ import annotations

import os
from collections.abc import Callable

Adapter = Callable[[dict], str]


def local(spec: dict) -> str:
    """The folder of spec["path"]; an error if there is none. A URL of another file system is taken as it is, since only Spark reads it."""
    path = spec["path"]
    if "://" in path and not path.startswith("file://"):
        return path
    bare = os.path.abspath(path.removeprefix("file://"))
    if not os.path.isdir(bare):
        raise FileNotFoundError(f"{path} isn't a folder")
    return f"file://{bare}"


ADAPTERS: dict[str, Adapter] = {"local": local}


def prepare(spec: dict) -> str:
    """The path of a repository of spec["kind"]."""
    if spec.get("kind") not in ADAPTERS:
        raise ValueError(f"no adapter for {spec.get('kind')!r}")
    return ADAPTERS[spec["kind"]](spec)
