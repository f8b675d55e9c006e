"""Numpy arrays in files of the shared folder, memory-mapped where the store allows it."""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

import numpy as np
from pyarrow import fs

_HEAD = 4096


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray], facts: dict) -> str:
    """Write a new file and return its path; a task that runs again writes another one."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    at, places, parts = _HEAD, {}, []
    for key, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        places[key] = (a.dtype.str, at, len(a))
        parts.append(raw + b"\0" * (-len(raw) % 8))
        at += len(parts[-1])
    head = json.dumps({"arrays": places, "facts": facts}).encode()
    file = f"{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{root}/{file}") as out:
        out.write(head.ljust(_HEAD))
        for raw in parts:
            out.write(raw)
    return f"{folder}/{file}"


@lru_cache(maxsize=4096)
def read_arrays(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """Arrays and facts of a file: views of a memory map, or of its bytes in a store that has no local path."""
    store, place = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        raw = np.memmap(place, np.uint8, mode="r")
    else:
        with store.open_input_file(place) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    head = json.loads(bytes(raw[:_HEAD]))
    cut = {k: raw[at : at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, at, n) in head["arrays"].items()}
    return {k: v.view(np.ndarray) for k, v in cut.items()}, head["facts"]
