"""Episodes in ``.npz`` files (state, optional action, lang, image.<camera>) as a Spark data source.

``spark.dataSource.register(NpzSource)``, then
``spark.read.format("npz").load(folder)``: one row per step, one partition per
group of files.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, frame bigint, n bigint, state array<float>, action array<float>, lang string"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def steps(path: str) -> Iterator[tuple]:
    """Rows of one file; a missing action is null, states of one dim are vectors of one."""
    with np.load(path, allow_pickle=False) as data:
        state = np.asarray(data["state"], np.float32)
        state = state.reshape(len(state), -1)
        action = np.asarray(data["action"], np.float32).reshape(len(data["action"]), -1) if "action" in data.files else None
        lang = str(data["lang"]) if "lang" in data.files else ""
        n = len(state) if action is None else min(len(state), len(action))
        for i in range(n):
            yield path, i, n, state[i].tolist(), None if action is None else action[i].tolist(), lang


class NpzReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.each = options["path"], int(options.get("filespartition", 64))

    def partitions(self):
        paths = sorted(os.path.join(d, f) for d, _, names in os.walk(self.folder) for f in names if f.endswith(".npz"))
        return [Files(paths[i : i + self.each]) for i in range(0, len(paths), self.each)] or [Files([])]

    def read(self, partition):
        for path in partition.paths:
            yield from steps(path)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class NpzWriter(DataSourceWriter):
    """Writes rows (path, frame, state, ...) to files named by the last part of ``path``; a task holds whole episodes."""

    def __init__(self, options):
        self.folder = options["path"]

    def write(self, rows):
        episodes: dict[str, list] = {}
        for r in rows:
            episodes.setdefault(os.path.basename(r["path"]), []).append(r)
        os.makedirs(self.folder, exist_ok=True)
        files = []
        for name, steps_ in episodes.items():
            steps_.sort(key=lambda r: r["frame"])
            data = {"state": np.array([r["state"] for r in steps_], np.float32), "lang": np.array(steps_[0]["lang"] or "")}
            if steps_[0]["action"] is not None:
                data["action"] = np.array([r["action"] for r in steps_], np.float32)
            target = os.path.join(self.folder, name if name.endswith(".npz") else f"{name}.npz")
            with open(f"{target}.{os.getpid()}.tmp", "wb") as file:
                np.savez(file, **data)
            os.replace(file.name, target)
            files.append(target)
        return Written(files)

    def abort(self, messages):
        pass


class NpzSource(DataSource):
    @classmethod
    def name(cls):
        return "npz"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return NpzReader(self.options)

    def writer(self, schema, overwrite):
        return NpzWriter(self.options)
