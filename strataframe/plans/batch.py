"""Batches of tiles: a manifest of records by tile, merged and replaced as a whole."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame


def merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New records, and old ones whose key has none."""
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"))


def expand_inputs(paths: list[str], suffixes: tuple[str, ...] = (".las", ".parquet")) -> list[str]:
    """Files, the files below folders and those that patterns match, each once, in the order found."""
    found: dict[str, None] = {}
    for p in paths:
        if any(c in p for c in "*?["):
            anchor = Path(p).anchor or "."
            hits = sorted(Path(anchor).glob(str(Path(p).relative_to(anchor)) if Path(p).is_absolute() else p))
        else:
            hits = sorted(x for s in suffixes for x in Path(p).rglob(f"*{s}")) if Path(p).is_dir() else [Path(p)]
        found |= dict.fromkeys(str(h) for h in hits if h.is_file())
    return list(found)


class Manifest:
    """Records by tile in a JSON file that is replaced whole, so that a reader never sees half of one."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.records: dict[str, dict] = json.loads(self.path.read_text()) if self.path.exists() else {}

    def put(self, tile: str, record: dict) -> None:
        self.records[tile] = record
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps(self.records, indent=1, sort_keys=True))
        os.replace(part, self.path)

    def todo(self, tiles: list[str]) -> list[str]:
        """Tiles that are not done, or whose result is gone."""
        done = {t for t, r in self.records.items() if r.get("status") == "done" and (not r.get("output") or os.path.exists(r["output"]))}
        return [t for t in tiles if t not in done]


def run_batch(tiles: dict[str, int], work: Callable[[str], dict], manifest: Manifest, progress: Callable[[str, str, float], None] | None = None) -> dict[str, dict]:
    """Run ``work`` on every tile left to do, the largest first (``tiles``: sizes by name). A failed tile is recorded and
    the others go on; Spark distributes the work within each tile."""
    left = sorted(manifest.todo(list(tiles)), key=lambda t: (-tiles[t], t))
    for i, t in enumerate(left):
        if progress:
            progress("tile", t, i / len(left))
        try:
            manifest.put(t, {"status": "done", **work(t)})
        except Exception as error:  # noqa: BLE001 - recorded, and shown by the manifest
            manifest.put(t, {"status": "failed", "error": f"{type(error).__name__}: {error}"})
    return manifest.records
