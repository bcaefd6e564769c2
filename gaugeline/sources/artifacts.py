"""Files of runs as a sink that shows all of a job's files or none.

    register(spark)
    rows.write.format("artifacts").mode("append").save(folder)

Rows have run_id, name and content (binary or string); each becomes the file
folder/run_id/name.  Tasks write into a folder of the job that begins with a
dot, each attempt into one of its own.  When all tasks have ended, the files of
the attempts that count are moved to their places, one by one, and a list of
them is written last: a reader that waits for ``_committed-<job>.json`` sees a
whole job.  When a task fails for good nothing has moved, and the job's folder
is removed; what an attempt left that did not count goes with it.

``mode("overwrite")`` replaces the runs that the job writes, and no others.
Two rows of one name are an error.  Folders are opened by path, so they must lie
on storage that all executors mount.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _checked(part: str) -> str:
    """A run or a file name: one step of a path."""
    if not part or part in (".", "..") or "/" in part or part.startswith((".", "_committed-")):
        raise ValueError(f"{part!r} is no name of a run or a file")
    return part


@dataclass
class Written(WriterCommitMessage):
    """Where an attempt put its files, and which they are."""

    folder: str
    files: list[tuple[str, str]]


class ArtifactWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self._folder, self._overwrite, self._job = Path(folder), overwrite, uuid.uuid4().hex[:12]

    @property
    def _staging(self) -> Path:
        return self._folder / f".job-{self._job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        task = TaskContext.get()
        own, files = self._staging / f"{task.partitionId()}-{task.taskAttemptId()}", []
        for row in iterator:
            run, name = _checked(str(row["run_id"])), _checked(row["name"])
            content = row["content"]
            place = own / run / name
            place.parent.mkdir(parents=True, exist_ok=True)
            with place.open("xb") as f:  # a second row of one name is an error
                f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            files.append((run, name))
        return Written(str(own), files)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        names = [f for m in done for f in m.files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"files written twice: {sorted({'/'.join(f) for f in names if names.count(f) > 1})[:10]}")
        if self._overwrite:
            for run in {run for run, _ in names}:
                if (self._folder / run).exists():
                    os.replace(self._folder / run, self._staging / f"replaced-{run}")
        for m in done:
            for run, name in m.files:
                (self._folder / run).mkdir(parents=True, exist_ok=True)
                os.replace(Path(m.folder) / run / name, self._folder / run / name)
        self._folder.mkdir(parents=True, exist_ok=True)
        listed = self._folder / f".listed-{self._job}"
        listed.write_text(json.dumps({"files": ["/".join(f) for f in sorted(names)]}))
        os.replace(listed, self._folder / f"_committed-{self._job}.json")
        shutil.rmtree(self._staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self._staging, ignore_errors=True)


class ArtifactSink(DataSource):
    """Option: ``path``, the folder of all runs."""

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def writer(self, schema, overwrite: bool) -> ArtifactWriter:
        if lost := {"run_id", "name", "content"} - set(schema.names):
            raise ValueError(f"missing columns: {sorted(lost)}")
        return ArtifactWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArtifactSink)


def committed(folder: str) -> list[str]:
    """Files of whole jobs, as run/name; of an overwritten run the files of its last job."""
    listed = sorted(Path(folder).glob("_committed-*.json"), key=lambda p: p.stat().st_mtime_ns)
    return sorted({f for p in listed for f in json.loads(p.read_text())["files"] if (Path(folder) / f).exists()})
