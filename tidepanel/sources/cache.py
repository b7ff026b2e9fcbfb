"""A cache of payloads in a shared folder: entries appear whole or not at all."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyarrow import fs


class PayloadCache:
    """JSON payloads by the hash of their key's parts, in any folder that pyarrow's file systems reach.

    An entry is written under a name of its own and moved to its place, so readers never see half of one, and two tasks that
    write one entry leave one of both. Without a folder nothing is kept.
    """

    def __init__(self, folder: str | None):
        self.folder = folder
        if folder:
            self.files, self.root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
            self.files.create_dir(self.root, recursive=True)

    def _place(self, parts: tuple[str, ...]) -> str:
        return f"{self.root}/{hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:32]}.json"

    def get(self, *parts: str):
        """The payload, or None where there is none."""
        if not self.folder or self.files.get_file_info(self._place(parts)).type == fs.FileType.NotFound:
            return None
        with self.files.open_input_stream(self._place(parts)) as f:
            return json.loads(f.read())["payload"]

    def put(self, payload, *parts: str) -> None:
        if not self.folder:
            return
        place = self._place(parts)
        own = f"{place}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(own) as f:
            f.write(json.dumps({"key": parts, "payload": payload}).encode())
        self.files.move(own, place)
