"""A streaming source that follows growing files line by line."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_STEP = 1 << 16


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _sizes(path: str, suffix: str) -> dict[str, int]:
    from pyarrow import fs

    store, root = _store(path)
    return {f.path: f.size for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file and f.path.endswith(suffix)}


def is_whole(line: bytes) -> bool:
    """Whether a last line without its end is taken: only a JSON object can be told to be all there."""
    text = line.strip()
    if not (text.startswith(b"{") and text.endswith(b"}")):
        return False
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def _readable_end(path: str, file: str, start: int, size: int) -> int:
    """How far lines can be read in [start, size): to its end if the last line has one or is whole without it, else to the last line end.

    The file is read from the back in small steps. A rest that begins where reading
    stopped before may be the end of a line that was taken without it: it is then only a
    line end, which a later call passes.
    """
    store, _ = _store(path)
    with store.open_input_file(file) as f:
        end, rest = size, b""
        while end > start:
            begin = max(start, end - _STEP)
            rest = f.read_at(end - begin, begin) + rest
            at = rest.rfind(b"\n", 0, end - begin)
            if at >= 0:
                last = rest[at + 1 :]
                return size if not last or is_whole(last) else begin + at + 1
            end = begin
    return size if is_whole(rest) else start


@dataclass
class FileRange(InputPartition):
    file: str
    start: int
    end: int


class TailReader(DataSourceStreamReader):
    """Offsets are the bytes of each file that whole lines cover; each file that grew is a partition of its own.

    A last line without its end is taken once it is a whole JSON object, and once only:
    the offset then stands behind it, and what comes next (its line end) gives no line.
    A file that is shorter than before is read from its start.
    """

    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        now = {}
        for file, size in _sizes(self.path, self.suffix).items():
            start = self.seen.get(file, 0)
            if size < start:  # cut or written anew
                start = 0
            now[file] = _readable_end(self.path, file, start, size) if size > start else start
        self.seen = now
        return {"files": json.dumps(now, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        ranges = [FileRange(f, old.get(f, 0) if n >= old.get(f, 0) else 0, n) for f, n in sorted(new.items())]
        return [r for r in ranges if r.end > r.start]

    def read(self, partition: FileRange):
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as f:
            at, rest = partition.start, b""
            while at < partition.end:
                data = rest + f.read_at(min(1 << 22, partition.end - at), at)
                place = at - len(rest)
                at += len(data) - len(rest)
                *lines, rest = data.split(b"\n")
                for line in lines:
                    if line.strip():
                        yield partition.file, place, line.decode("utf-8", "replace")
                    place += len(line) + 1
            if rest.strip():  # whole without a line end; what is written behind it begins where this range stops
                yield partition.file, at - len(rest), rest.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        self.seen = json.loads(end["files"])


class TailSource(DataSource):
    """spark.readStream.format("tail").option("path", folder): (file, offset, line) of each whole line that was added."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def read_tail(spark, path: str, suffix: str = ".jsonl"):
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", path).option("suffix", suffix).load()


def route(path):
    """What a changed file is, by its path: session, subagent, memory, todo or other."""
    from pyspark.sql import functions as F

    return (
        F.when(path.rlike(r"/subagents/agent-[^/]+\.jsonl$"), "subagent").when(path.rlike(r"/memory/.*\.md$"), "memory").when(path.rlike(r"/todos/[^/]+\.json$"), "todo").when(path.rlike(r"\.jsonl$"), "session").otherwise("other")
    )
