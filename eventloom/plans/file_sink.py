"""File operations as a Spark sink with a journal: tasks place files, a commit closes the run.

A file is placed under its name by a hard link from a finished temporary file (or from its source),
which the file system refuses if the name is taken: nothing is overwritten, and of two tasks
with the same work one places the file and the other one finds it placed.  A source goes after its
destination is there.  So a task may be killed anywhere, doubled or run again.

The journal holds the operations from before the first one until all are done; what it still
holds after a crash is carried out by ``resume``.
"""

from __future__ import annotations

import errno
import filecmp
import json
import os
import shutil
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from eventloom.runtime import scratch, ship

JOURNAL = ".eventloom-journal"
#: Failures that a task names; more are only counted.
NAMED = 100


@dataclass
class Outcome(WriterCommitMessage):
    """Files placed, files that were placed before, and operations that could not be done."""

    done: int = 0
    before: int = 0
    failed: int = 0
    failures: list[tuple[str, str]] = field(default_factory=list)

    def add(self, other: "Outcome") -> None:
        self.done, self.before, self.failed = self.done + other.done, self.before + other.before, self.failed + other.failed
        self.failures += other.failures[: max(0, NAMED - len(self.failures))]


def _same(a: str, b: str) -> bool:
    return os.path.samefile(a, b) or (os.path.getsize(a) == os.path.getsize(b) and filecmp.cmp(a, b, shallow=False))


def _link(part: str, target: str) -> None:
    """Give a finished file its name unless the name is taken."""
    try:
        os.link(part, target)
    except OSError as e:
        if e.errno not in (errno.EPERM, errno.ENOTSUP, errno.EMLINK):
            raise
        # no hard links here: reserve the name, then replace what reserves it
        os.close(os.open(target, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        os.replace(part, target)


def _copied(source: str, target: str) -> None:
    part = f"{target}.part-{uuid.uuid4().hex}"
    try:
        shutil.copy2(source, part)
        with open(part, "rb") as f:
            os.fsync(f.fileno())
        _link(part, target)
    finally:
        if os.path.lexists(part):
            os.unlink(part)


def place(op: str, source: str, target: str) -> str:
    """Carry out one copy or move: ``done``, ``before`` (an earlier or a parallel try did it) or what is wrong."""
    result = "done"
    try:
        if op == "copy":
            _copied(source, target)
        else:
            _moved_to(source, target)
    except FileExistsError:
        try:
            if not _same(source, target):
                return "destination exists"
        except FileNotFoundError:  # a parallel move has ended
            return "before"
        result = "before"
    except FileNotFoundError:
        if os.path.lexists(source):  # it's the folder that isn't there
            raise
        return "before" if op == "move" and os.path.lexists(target) else "source is missing"
    if op == "move":
        try:
            os.unlink(source)
        except FileNotFoundError:
            result = "before"
    return result


def _moved_to(source: str, target: str) -> None:
    """Place a file under a second name, over file systems too; the first one stays."""
    try:
        os.link(source, target)
    except OSError as e:
        if e.errno not in (errno.EXDEV, errno.EPERM, errno.ENOTSUP, errno.EMLINK):
            raise
        _copied(source, target)


class _Writer(DataSourceWriter):
    def __init__(self, journal: str):
        self.journal = journal

    def write(self, iterator) -> Outcome:
        out = Outcome()
        for r in iterator:
            try:
                found = place(r["op"], r["src"], r["dst"])
            except OSError as e:
                found = str(e)
            if found in ("done", "before"):
                setattr(out, found, getattr(out, found) + 1)
            else:
                out.add(Outcome(failed=1, failures=[(r["dst"], found)]))
        return out

    def commit(self, messages) -> None:
        total = Outcome()
        for m in messages:
            if m is not None:
                total.add(m)
        part = f"{self.journal}/outcome.part"
        with open(part, "w") as f:
            json.dump(vars(total), f)
        os.replace(part, f"{self.journal}/outcome.json")

    def abort(self, messages) -> None:
        """Nothing to undo: what was placed stays, and the journal stays open for ``resume``."""


class FileSink(DataSource):
    """``df.write.format("media_file_operations").option("journal", folder)``: rows (op, src, dst)."""

    @classmethod
    def name(cls) -> str:
        return "media_file_operations"

    def schema(self):
        return "op string, src string, dst string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["journal"])


def _run(operations: DataFrame, journal: str) -> Outcome:
    spark = operations.sparkSession
    ship(spark)
    spark.dataSource.register(FileSink)
    operations.select("op", "src", "dst").write.format("media_file_operations").option("journal", journal).mode("append").save()
    with open(f"{journal}/outcome.json") as f:
        found = json.load(f)
    return Outcome(found["done"], found["before"], found["failed"], [tuple(x) for x in found["failures"]])


def carry_out(operations: DataFrame, folder: str | None = None) -> Outcome:
    """Copy and move (op, src, dst); the journal is kept in ``folder`` meanwhile (else in the shared scratch folder)."""
    spark = operations.sparkSession
    base = folder or scratch(spark, "journals").removeprefix("file://")
    journal = os.path.join(base, JOURNAL, uuid.uuid4().hex)
    os.makedirs(journal)
    operations.select("op", "src", "dst").write.parquet(f"file://{os.path.abspath(journal)}/operations")
    open(f"{journal}/begun", "w").close()
    return _finished(spark, journal)


def _finished(spark: SparkSession, journal: str) -> Outcome:
    out = _run(spark.read.schema("op string, src string, dst string").parquet(f"file://{os.path.abspath(journal)}/operations"), journal)
    shutil.rmtree(journal)
    if not os.listdir(os.path.dirname(journal)):
        os.rmdir(os.path.dirname(journal))
    return out


def resume(spark: SparkSession, folder: str) -> Outcome:
    """Carry out what the journals in ``folder`` still hold; those that had not begun are dropped."""
    total, top = Outcome(), os.path.join(folder, JOURNAL)
    for name in sorted(os.listdir(top)) if os.path.isdir(top) else []:
        journal = os.path.join(top, name)
        if os.path.exists(f"{journal}/begun"):
            total.add(_finished(spark, journal))
        else:
            shutil.rmtree(journal)
    return total
