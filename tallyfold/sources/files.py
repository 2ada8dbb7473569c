"""Settings and job files: small JSON files that one process reads and writes, apart from tables."""

from __future__ import annotations

import json
import os
import time
import uuid
from copy import deepcopy


def file_system(path: str):
    """(pyarrow file system, path in it) of a path or URI."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))
    return (fs.LocalFileSystem(), path.removeprefix("file://")) if path.startswith("file://") else fs.FileSystem.from_uri(path)


def merged(base: dict, over: dict) -> dict:
    """base with over's values laid over it, level by level."""
    out = deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def load_settings(path: str, defaults: dict) -> dict:
    """The file's settings over the defaults; the defaults alone where it is missing or isn't an object in JSON."""
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
    except (OSError, ValueError):
        return deepcopy(defaults)
    return merged(defaults, got) if isinstance(got, dict) else deepcopy(defaults)


def _put(path: str, value: dict) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    hidden = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{uuid.uuid4().hex}.tmp")
    with open(hidden, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True)
    os.replace(hidden, path)
    return path


def save_settings(path: str, settings: dict) -> None:
    """Settings as JSON with sorted keys; a reader sees the old file or the new one."""
    _put(path, settings)


def _stands(folder: str, name: str, aside: bool) -> bool:
    for sub in ("", "processed", "failed"):
        at = os.path.join(folder, sub)
        names = os.listdir(at) if os.path.isdir(at) else []
        if any(n == name or aside and n.startswith(f"{name}.") for n in names):
            return True
    return False


def enqueue(folder: str, campaign_id: str, campaign_name: str, aside: bool = True) -> str | None:
    """Write a campaign's job unless one waits, was done or failed; aside counts files that were renamed on a clash too."""
    name = f"campaign_{campaign_id}.json"
    if _stands(folder, name, aside):
        return None
    made = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    return _put(os.path.join(folder, name), {"campaign_id": str(campaign_id), "campaign_name": campaign_name, "created_at": made})


def move_job(path: str, folder: str) -> str:
    """Move a job file; where its name is taken, the time in seconds is added."""
    os.makedirs(folder, exist_ok=True)
    to = os.path.join(folder, os.path.basename(path))
    if os.path.exists(to):
        to = f"{to}.{int(time.time())}"
    os.replace(path, to)
    return to
