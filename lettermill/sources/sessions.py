"""Captured server sessions as a data source: a table with pushed filters, and a stream that polls folders.

A folder of sessions holds files ``<folder>/<epoch>/<first>-<last>.session`` with the responses to a fetch of the uids
first to last; a file is moved into place when it is complete and never changes. The table also reads files of other
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from lettermill.sources.mail import fetched, streamed
from lettermill.sources.shared import small_batches

SCHEMA = "folder string, epoch long, file string, seq long, uid long, flags array<string>, internalDate timestamp, size long, raw string"
_NAMED = re.compile(r"(?:.*/)?([^/]+)/(\d+)/(\d+)-(\d+)\.session\Z")
_TESTS = {
    EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, In: lambda v, x: v in x, IsNotNull: lambda v, x: True,
}


def received(value: str | None) -> datetime | None:
    """The server's date of a response, None if it has none that can be read."""
    try:
        return datetime.strptime((value or "").strip(), "%d-%b-%Y %H:%M:%S %z")
    except ValueError:
        return None


def _aware(x):
    return x.replace(tzinfo=UTC) if isinstance(x, datetime) and x.tzinfo is None else x


@dataclass
class Session(InputPartition):
    """One file, and which uids of it count."""

    path: str
    folder: str | None = None
    epoch: int | None = None
    first: int = 0
    last: int = 1 << 62
    after: int = 0
    upto: int = 1 << 62


def _rows(part: Session, wanted=lambda uid, date: True) -> Iterator[tuple]:
    """Rows of a session file; what isn't wanted is told by uid and date alone, its text isn't decoded."""
    files, path = fs.FileSystem.from_uri(part.path)
    with files.open_input_stream(path) as f:
        for response in streamed(f.read):
            row = fetched(response, lambda uid, date: uid is not None and part.after < uid <= part.upto and wanted(uid, received(date)))
            if row:
                yield (part.folder, part.epoch, part.path, row["seq"], row["uid"], row["flags"], received(row["received"]), row["size"], row["raw"])


def _sessions(path: str) -> list[Session]:
    """The files under a folder (or the one file), by their names; only names are read."""
    files, root = fs.FileSystem.from_uri(path)
    info = files.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else [f for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    scheme = path.split("://")[0] + "://" if "://" in path else "file://"
    out = []
    for f in sorted(found, key=lambda f: f.path):
        if f.base_name.startswith((".", "_")):
            continue
        named = _NAMED.match(f.path)
        out.append(Session(scheme + f.path, named[1], *map(int, named.groups()[1:])) if named else Session(scheme + f.path))
    return out


class SessionReader(DataSourceReader):
    """A partition for each file; comparisons of uid and internalDate are pushed, and files whose names rule them out aren't read."""

    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("uid",), ("internalDate",)):
                value = tuple(map(_aware, f.value)) if isinstance(f, In) else _aware(getattr(f, "value", None))
                self.tests.append((f.attribute[0], type(f), value))
            else:
                yield f

    def _may_have(self, s: Session) -> bool:
        for column, kind, x in self.tests:
            if column != "uid" or kind is IsNotNull:
                continue
            low, high = (min(x, default=1), max(x, default=0)) if kind is In else (x, x)
            if kind in (EqualTo, In, GreaterThan, GreaterThanOrEqual) and s.last < low or kind is GreaterThan and s.last <= low:
                return False
            if kind in (EqualTo, In, LessThan, LessThanOrEqual) and s.first > high or kind is LessThan and s.first >= high:
                return False
        return True

    def partitions(self):
        return [s for s in _sessions(self.path) if self._may_have(s)] or [Session("")]

    def read(self, partition):
        def wanted(uid, date):
            return all((v := uid if column == "uid" else date) is not None and _TESTS[kind](v, x) for column, kind, x in self.tests)

        return _rows(partition, wanted) if partition.path else iter(())


class FolderPoller(DataSourceStreamReader):
    """What folders got since the last poll. The offset is, for each folder, its epoch and the last uid.

    A folder whose epoch changed begins anew: all of its uids come again, under the new epoch.
    """

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self):
        return {}

    def latestOffset(self):
        seen: dict[str, list[int]] = {}
        for s in _sessions(self.path):
            if s.folder is not None:
                seen[s.folder] = max(seen.get(s.folder, [0, 0]), [s.epoch, s.last])
        return seen

    def partitions(self, start, end):
        out = []
        for s in _sessions(self.path):
            epoch, upto = end.get(s.folder, (None, 0))
            before = start.get(s.folder, (None, 0))
            after = before[1] if before[0] == epoch else 0
            if s.folder is not None and s.epoch == epoch and s.last > after and s.first <= upto:
                s.after, s.upto = after, upto
                out.append(s)
        return out

    def read(self, partition):
        return _rows(partition)


class MailSessions(DataSource):
    """``spark.read.format("mail_sessions").load(path)``, or ``readStream``."""

    @classmethod
    def name(cls):
        return "mail_sessions"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SessionReader(self.options["path"])

    def streamReader(self, schema):
        return FolderPoller(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known to the session and let filters reach it."""
    small_batches(spark)
    spark.dataSource.register(MailSessions)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
