"""Sessions and jobs: small files on the driver. A session is written as JSON, which is YAML too; YAML is read where a parser is installed."""

from __future__ import annotations

import copy
import json
import os
import re
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.config import migrate, update

try:
    import yaml
except ImportError:
    yaml = None

STATES = ("queued", "running", "done", "failed", "cancelled")


def _write(path: Path, value: dict) -> None:
    """All or nothing: a reader sees the old or the new file."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(f".{uuid.uuid4().hex}.part")
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1)
        f.flush()
        os.fsync(f.fileno())
    part.replace(path)


class Sessions:
    def __init__(self, folder: str):
        self.folder = Path(folder)

    def _path(self, name: str) -> Path:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", name) or name.startswith("."):
            raise ValueError(f"no name of a session: {name!r}")
        return self.folder / f"{name}.yaml"

    def exists(self, name: str) -> bool:
        return self._path(name).exists()

    def list(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.yaml"))

    def get(self, name: str) -> dict:
        text = self._path(name).read_text(encoding="utf-8")
        try:
            value = json.loads(text)
        except json.JSONDecodeError:
            if yaml is None:
                raise
            value = yaml.safe_load(text)
        return migrate(value)

    def save(self, name: str, config: dict) -> dict:
        out = copy.deepcopy(config)
        out["meta"] = (out.get("meta") or {}) | {"session_id": name}
        _write(self._path(name), out)
        return out

    def create(self, name: str, config: dict) -> dict:
        if self.exists(name):
            raise FileExistsError(name)
        return self.save(name, config)

    def update(self, name: str, dotted: dict) -> dict:
        return self.save(name, update(self.get(name), dotted))

    def fork(self, name: str, new: str, dotted: dict | None = None) -> dict:
        return self.create(new, update(self.get(name), {"meta.forked_from": name, **(dotted or {})}))

    def delete(self, name: str) -> None:
        self._path(name).unlink()


class Jobs:
    """Jobs with a state each; a job ends once."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def submit(self, session_id: str) -> dict:
        job = {"job_id": uuid.uuid4().hex[:8], "session_id": session_id, "state": "queued", "created_at": time.time(), "result_path": None}
        _write(self.folder / f"{job['job_id']}.json", job)
        return job

    def get(self, job_id: str) -> dict:
        return json.loads((self.folder / f"{job_id}.json").read_text(encoding="utf-8"))

    def set(self, job_id: str, state: str, **fields) -> dict:
        if state not in STATES:
            raise ValueError(f"no state {state!r}")
        job = self.get(job_id)
        if job["state"] in STATES[2:]:
            raise ValueError(f"job {job_id} is {job['state']}")
        job |= fields | {"state": state, "updated_at": time.time()}
        _write(self.folder / f"{job_id}.json", job)
        return job

    def list(self) -> list[dict]:
        """Newest first, by the time they were made."""
        return sorted((json.loads(p.read_text(encoding="utf-8")) for p in self.folder.glob("*.json")), key=lambda j: -j["created_at"])


def latest_result(jobs: DataFrame, session_id: str) -> DataFrame:
    """The newest job of a session with a result, as one row or none."""
    return jobs.filter((F.col("session_id") == session_id) & F.col("result_path").isNotNull()).orderBy(F.desc("created_at"), "job_id").limit(1)
