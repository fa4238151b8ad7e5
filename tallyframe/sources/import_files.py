"""Import files (S2) as a Spark data source: ``spark.read.format("import_files")`` and ``spark.readStream``.

A file is cut into byte ranges, a task each. A range owns the records that begin on its lines (ended by line feeds), reads on to
the end of the last one, and takes names from its own file's header, so files of any layouts go together.

Quoting is that of RFC 4180 as a pandas reader has it: a quote counts only at the start of a field, ``""`` inside
quotes is one, text after a closing quote is kept, commas and line breaks inside quotes belong to the field; records end with
``\\n``, ``\\r\\n`` or ``\\r``; blank lines are no records; a byte-order mark is dropped.

Whether a range's first line is inside quotes depends on all ranges before it. So a range is read for both cases in its
one pass (without quotes in it the second gives nothing), and its mark tells for each how many records it has and whether
it ends inside quotes. ``resolved`` composes the marks along a file and keeps the case that holds: record numbers are
exact and nothing is read before the read. Files of one range need none of this.

Rows of the source (``SCHEMA``): records (``ends`` null) with ``cells`` by name, and marks (``ends`` set), a range and case each, with
the digest of the range's bytes.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

SCHEMA = ("file string, file_no long, part int, state int, seq long, cells map<string,string>, problem string, "
          "ends int, n long, digest string")
#: Bytes of a range, of a read past its end, and of a record at most.
RANGE_BYTES, STEP_BYTES, RECORD_BYTES = 64 << 20, 1 << 16, 64 << 20
#: Rows of a batch handed to Spark.
BATCH_ROWS = 10_000
#: ``row_order`` is file_no times this plus the record's number.
FILE_STRIDE = 1 << 40

UNCLOSED = "Unclosed quote"
_QUOTED = re.compile(rb'"([^"]*(?:""[^"]*)*)("?)([^,\r\n]*)')
_PLAIN = re.compile(rb"[^,\r\n]*")
_INSIDE = re.compile(rb'[^"]*(?:""[^"]*)*')
_BLANK = re.compile(rb"[ \t]*(?:\r\n|\n|\r|$)")


# ---- stores ------------------------------------------------------------------------------

def open_store(path: str) -> tuple[pa.fs.FileSystem, str, str]:
    """(file system, path in it, prefix that makes a path in it a name again). Names are taken as they are, blanks and
    percent signs included."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pa.fs.LocalFileSystem(), path, "file://"
    if scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file://"
    if scheme in ("s3a", "s3n"):
        scheme = "s3"
    bucket, _, key = rest.lstrip("/").partition("/")
    store, root = pa.fs.FileSystem.from_uri(f"{scheme}://{bucket}")
    root = root.rstrip("/")
    return store, f"{root}/{key}" if root else key, f"{scheme}://" + ("" if root else bucket)


def list_files(paths: list[str]) -> list[tuple[str, int]]:
    """(name, bytes) of the files that ``paths`` name: files, folders (names that start with ``_`` or ``.`` are left
    out) or patterns, in order of their names, each once."""
    found: dict[str, int] = {}
    for path in paths:
        store, at, prefix = open_store(path)
        wild = re.search(r"[*?\[]", at)
        top = at[: at.rfind("/", 0, wild.start())] if wild else at
        info = store.get_file_info(top or "/")
        if info.type == pa.fs.FileType.File:
            infos = [info]
        elif info.type == pa.fs.FileType.Directory:
            infos = store.get_file_info(pa.fs.FileSelector(top or "/", recursive=True))
        else:
            raise FileNotFoundError(f"No import file at {path}")
        steps = at.split("/")
        for f in infos:
            inner = f.path[len(top) :] if info.type == pa.fs.FileType.Directory else ""
            hidden = any(p.startswith(("_", ".")) for p in inner.split("/"))
            named = f.path.split("/")  # a pattern matches step by step; what is below a folder that matches belongs to it
            matches = not wild or len(named) >= len(steps) and all(map(fnmatch.fnmatchcase, named, steps))
            if f.type == pa.fs.FileType.File and not hidden and matches:
                found[prefix + f.path] = f.size
    return sorted(found.items())


class _Bytes:
    """A file's bytes from a place on, read as they are asked for."""

    def __init__(self, file, size: int, start: int, stop: int):
        self.file, self.size, self.start = file, size, start
        self.data = file.read_at(max(0, min(stop, size) - start), start)

    def more(self) -> bool:
        """Reads on; False at the end of the file."""
        at = self.start + len(self.data)
        step = min(max(STEP_BYTES, len(self.data) // 2), self.size - at)
        if step <= 0:
            return False
        self.data += self.file.read_at(step, at)
        return True

    def body_start(self) -> int:
        """The place after a byte-order mark."""
        while len(self.data) < 3 and self.more():
            pass
        return 3 if self.data.startswith(b"\xef\xbb\xbf") else 0

    def line_start(self, at: int) -> int:
        """The first place >= ``at`` at which a line starts (the size, if none)."""
        if at <= 0:
            return 0
        k = max(0, at - 1 - self.start)
        while (found := self.data.find(b"\n", k)) < 0:
            k = len(self.data)
            if not self.more():
                return self.size
        return self.start + found + 1


# ---- records -----------------------------------------------------------------------------

def _field(data: bytes, k: int, inside: bool) -> tuple[bytes, int, bool]:
    """(value, place after it, closed) of the field at ``k``; ``inside``: its opening quote is before ``k``."""
    if inside:
        m = _INSIDE.match(data, k)
        if m.end() == len(data):
            return m.group(), m.end(), False
        tail = _PLAIN.match(data, m.end() + 1)
        return m.group().replace(b'""', b'"') + tail.group(), tail.end(), True
    if data[k : k + 1] == b'"':
        m = _QUOTED.match(data, k)
        return m.group(1).replace(b'""', b'"') + m.group(3), m.end(), bool(m.group(2))
    m = _PLAIN.match(data, k)
    return m.group(), m.end(), True


def _fields(b: _Bytes, pos: int, inside: bool = False, limit: int | None = None) -> tuple[list[bytes], int, bool]:
    """(fields, place after the record, closed) of the record at ``pos``; ``inside``: it starts in quotes.

    With ``limit`` the record is another range's: nothing is read for it, and if it goes on beyond that place it is not closed.
    """
    out: list[bytes] = []
    k = pos - b.start
    while True:
        start = k
        while True:
            value, k, closed = _field(b.data, start, inside and not out)
            # What ends with the data may go on: a quote there may be the first of two, a \r the first of \r\n.
            if k < len(b.data) - 1 or limit is not None and b.start + len(b.data) >= limit:
                break
            if len(b.data) - (pos - b.start) > RECORD_BYTES or not b.more():
                break
        if not closed or limit is not None and b.start + k >= limit:
            return [*out, value], b.start + len(b.data), False
        out.append(value)
        end = b.data[k : k + 1]
        k += 2 if b.data[k : k + 2] == b"\r\n" else 1
        if end != b",":
            return out, b.start + min(k, len(b.data)), True


def read_records(b: _Bytes, pos: int, limit: int, inside: bool) -> Iterator[tuple[int, int, list[str], bool]]:
    """(start, end, fields, closed) of the records that start in [pos, limit); with ``inside`` the record that is open at
    ``pos`` comes first, as one that starts before it. A record that goes on beyond ``limit`` ends after it."""
    if inside:
        if b.data.find(b'"', pos - b.start, limit - b.start) < 0:
            yield pos - 1, limit + 1, [], False
            return
        _, end, closed = _fields(b, pos, True, limit)
        end = end if closed else limit + 1
        yield pos - 1, end, [], closed
        pos = end
    while pos < limit:
        k = pos - b.start
        blank = _BLANK.match(b.data, k)
        while blank and blank.end() == len(b.data) and b.more():
            blank = _BLANK.match(b.data, k)
        if blank:
            pos = b.start + blank.end()
            continue
        stop = b.data.find(b"\n", k)
        line = b.data[k:stop] if stop >= 0 else b""
        if stop < 0 or b'"' in line or b"\r" in line[:-1]:
            fields, end, closed = _fields(b, pos)
        else:
            fields, end, closed = line.removesuffix(b"\r").split(b","), b.start + stop + 1, True
        yield pos, end, [f.decode("utf-8", "replace") for f in fields], closed
        pos = end


def column_names(fields: list[str]) -> list[str]:
    """The names of a header as a pandas reader gives them: a repeated name keeps its first place and is numbered after it, one
    that is empty is named by its place."""
    out: list[str] = []
    for k, name in enumerate(fields):
        name = name or f"Unnamed: {k}"
        given, n = name, 0
        while given in out:
            n += 1
            given = f"{name}.{n}"
        out.append(given)
    return out


def read_header(file, size: int) -> tuple[list[str], int]:
    """(names, place after the header) of a file; no names where it has no record."""
    b = _Bytes(file, size, 0, STEP_BYTES)
    for _, end, fields, _ in read_records(b, b.body_start(), size, False):
        return column_names(fields), end
    return [], size


# ---- the source --------------------------------------------------------------------------

class Range(InputPartition):
    """Bytes [start, stop) of a file of ``size`` bytes."""

    def __init__(self, file: str, file_no: int, part: int, start: int, stop: int, size: int):
        super().__init__(None)
        self.file, self.file_no, self.part, self.start, self.stop, self.size = file, file_no, part, start, stop, size


def ranges_of(files: list[tuple[str, int]], range_bytes: int, first_no: int = 0) -> list[Range]:
    out = []
    for no, (name, size) in enumerate(files, first_no):
        parts = max(1, -(-size // range_bytes))
        out += [Range(name, no, k, k * range_bytes, min(size, (k + 1) * range_bytes), size) for k in range(parts)]
    return out


_ARROW = pa.schema([("file", pa.string()), ("file_no", pa.int64()), ("part", pa.int32()), ("state", pa.int32()), ("seq", pa.int64()),
                    ("cells", pa.map_(pa.string(), pa.string())), ("problem", pa.string()), ("ends", pa.int32()), ("n", pa.int64()),
                    ("digest", pa.string())])


def _batch(r: Range, state: int, names: list[str], seq: int, rows: list[list[str]], problems: list[str | None]) -> pa.RecordBatch:
    m, n = len(names), len(rows)
    keys = pa.array(names, pa.string()).take(pa.array(list(range(m)) * n, pa.int64()))
    values = pa.array([v for row in rows for v in (row + [None] * (m - len(row)))[:m]], pa.string())
    cells = pa.MapArray.from_arrays(pa.array(range(0, m * n + 1, m) if m else [0] * (n + 1), pa.int32()), keys, values)
    return pa.RecordBatch.from_arrays(
        [pa.array([r.file] * n, pa.string()), pa.array([r.file_no] * n, pa.int64()), pa.array([r.part] * n, pa.int32()),
         pa.array([state] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()), cells, pa.array(problems, pa.string()),
         pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], schema=_ARROW)


def _mark(r: Range, state: int, ends: int, n: int, digest: str) -> pa.RecordBatch:
    row = {"file": r.file, "file_no": r.file_no, "part": r.part, "state": state, "ends": ends, "n": n, "digest": digest}
    return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def read_range(r: Range) -> Iterator[pa.RecordBatch]:
    """The records and marks of a range, for both states its first line may be in (the first range has one)."""
    store, path, _ = open_store(r.file)
    with store.open_input_file(path) as file:
        names, after_header = read_header(file, r.size)
        b = _Bytes(file, r.size, max(0, r.start - 1), r.stop)
        digest = hashlib.sha256(b.data[r.start - b.start :]).hexdigest()  # before anything is read on
        first = b.line_start(r.start) if r.start else b.body_start()
        limit = b.line_start(r.stop) if r.stop < r.size else r.size
        for state in (0, 1) if r.part else (0,):
            n, last = 0, first
            rows: list[list[str]] = []
            problems: list[str | None] = []
            for start, end, fields, closed in read_records(b, first, limit, state == 1) if first < limit else ():
                last = end
                if start < max(first, after_header):
                    continue
                rows.append(fields)
                problems.append(UNCLOSED if not closed else
                                f"Expected {len(names)} fields, saw {len(fields)}" if len(fields) > len(names) else None)
                n += 1
                if len(rows) == BATCH_ROWS:
                    yield _batch(r, state, names, n - len(rows), rows, problems)
                    rows, problems = [], []
            if rows:
                yield _batch(r, state, names, n - len(rows), rows, problems)
            yield _mark(r, state, state if first >= limit else int(last > limit), n, digest)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.range_bytes = json.loads(options["paths"]), int(options.get("range_bytes", RANGE_BYTES))
        self.heads = options.get("heads", "false") == "true"

    def partitions(self):
        files = list_files(self.paths)
        if self.heads:  # a task for every so many files
            return [InputPartition(files[k : k + 256]) for k in range(0, len(files), 256)]
        return ranges_of(files, self.range_bytes)

    def read(self, partition):
        if isinstance(partition, Range):
            yield from read_range(partition)
            return
        for name, size in partition.value or ():
            store, path, _ = open_store(name)
            with store.open_input_file(path) as file:
                names, _ = read_header(file, size)
            yield _batch(Range(name, 0, 0, 0, size, size), 0, names, 0, [[]], [None])


class _StreamReader(DataSourceStreamReader):
    """Files in the order in which they are first seen, so many a batch.

    Which files a batch has is written below ``log`` before Spark is told of it, one entry a batch: a batch that is run
    again after a failure has the same files, whatever else has been dropped since.
    """

    def __init__(self, options):
        self.paths, self.range_bytes = json.loads(options["paths"]), int(options.get("range_bytes", RANGE_BYTES))
        self.per_batch = int(options.get("files_per_batch", 1000))
        self.store, self.log, _ = open_store(options["log"])
        self.entries: list[dict] | None = None

    def _load(self) -> list[dict]:
        if self.entries is None:
            self.store.create_dir(self.log, recursive=True)
            names = sorted(f.path for f in self.store.get_file_info(pa.fs.FileSelector(self.log)) if f.path.endswith(".json"))
            self.entries = [self._entry(k) for k in range(len(names))]
        return self.entries

    def _path(self, k: int) -> str:
        return f"{self.log}/{k:012d}.json"

    def _entry(self, k: int) -> dict:
        with self.store.open_input_stream(self._path(k)) as f:
            return json.loads(f.read())

    def initialOffset(self):
        return {"batches": 0}

    def latestOffset(self):
        entries = self._load()
        seen = {name for e in entries for name, _ in e["files"]}
        try:
            fresh = [f for f in list_files(self.paths) if f[0] not in seen][: self.per_batch]
        except FileNotFoundError:
            fresh = []
        if fresh:
            entry = {"first_no": entries[-1]["first_no"] + len(entries[-1]["files"]) if entries else 0, "files": fresh}
            draft = f"{self.log}/{uuid.uuid4().hex}.draft"
            with self.store.open_output_stream(draft) as f:
                f.write(json.dumps(entry).encode())
            self.store.move(draft, self._path(len(entries)))
            entries.append(entry)
        return {"batches": len(entries)}

    def partitions(self, start, end):
        out = []
        for k in range(start["batches"], end["batches"]):
            e = self._load()[k]
            out += ranges_of([tuple(f) for f in e["files"]], self.range_bytes, e["first_no"])
        return out

    def read(self, partition):
        yield from read_range(partition)

    def commit(self, end):
        pass


class ImportFiles(DataSource):
    """Options: ``paths`` (a JSON list), ``range_bytes``, ``heads`` (one row a file with its names, nothing else is read); for streams
    also ``log`` (a shared folder of the stream's own) and ``files_per_batch``."""

    @classmethod
    def name(cls):
        return "import_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))

    def streamReader(self, schema):
        return _StreamReader(dict(self.options))


# ---- DataFrames ------------------------------------------------------------------------------

def register(spark: SparkSession) -> SparkSession:
    """``spark`` with the source known to it and this package at hand in its tasks."""
    from ..session import ship_package

    ship_package(spark)
    spark.dataSource.register(ImportFiles)
    return spark


def _as_list(path: str | list[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def header_names(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The names of all files' columns, in the order of files and headers. Only the first record of each file is read."""
    heads = register(spark).read.format("import_files").option("paths", json.dumps(_as_list(path))).option("heads", "true").load()
    named = heads.select("file", F.posexplode(F.map_keys("cells")).alias("at", "name"))
    first = named.groupBy("name").agg(F.min(F.struct("file", "at")).alias("first")).orderBy("first")
    return [r["name"] for r in first.collect()]


def resolved(raw: DataFrame) -> DataFrame:
    """The records of written rows of the source: (file, file_no, record, cells, problem), ``record`` counting from 0.

    A range is a function of the state it starts in: constant (0 or 1), the identity or a swap. The state before a range is
    that of the last constant one, swapped as often as ranges since then swap: two windows over one row a range.
    """
    at = ["file_no", "part"]
    marks = raw.where("ends IS NOT NULL").groupBy(*at).agg(
        F.max(F.expr("CASE WHEN state = 0 THEN ends END")).alias("e0"), F.max(F.expr("CASE WHEN state = 1 THEN ends END")).alias("e1"),
        F.max(F.expr("CASE WHEN state = 0 THEN n END")).alias("n0"), F.max(F.expr("CASE WHEN state = 1 THEN n END")).alias("n1"))
    marks = marks.withColumn("e1", F.coalesce("e1", "e0"))  # the first range starts outside quotes
    file = Window.partitionBy("file_no").orderBy("part")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.sum(F.expr("CAST(e0 = 1 AND e1 = 0 AS INT)")).over(file.rowsBetween(Window.unboundedPreceding, 0))
    marks = marks.withColumn("swaps", swaps).withColumn("const", F.expr("CASE WHEN e0 = e1 THEN named_struct('to', e0, 'swaps', swaps) END"))
    marks = marks.withColumn("last", F.last("const", True).over(before)).withColumn("since", F.max("swaps").over(before) - F.col("last.swaps"))
    marks = marks.withColumn("starts", F.coalesce(F.pmod(F.col("last.to") + F.col("since"), F.lit(2)), F.lit(0)).cast("int"))
    marks = marks.withColumn("of", F.expr("CASE WHEN starts = 0 THEN n0 ELSE n1 END"))
    marks = marks.select(*at, F.col("starts").alias("state"), F.coalesce(F.sum("of").over(before), F.lit(0)).alias("before"))
    rows = raw.where("ends IS NULL").join(marks, [*at, "state"])
    return rows.select("file", "file_no", (F.col("before") + F.col("seq")).alias("record"), "cells", "problem")


def numbered(records: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(file, row_id, row_order, cells, problem): ``row_id`` is the file's own column of that name where its header has
    one, else the record's number in the file (the header is 1, so the first is 2); ``row_order`` is unique, in order of
    (file, record)."""
    own = F.when(F.map_contains_key("cells", row_id), F.col("cells")[row_id].try_cast("long")).otherwise(F.col("record") + 2)
    return records.select("file", own.alias(row_id), (F.col("file_no") * FILE_STRIDE + F.col("record")).alias("row_order"), "cells", "problem")


def read_records_of(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES, row_id: str = "row_id") -> DataFrame:
    """The records of import files as ``numbered`` gives them. Lazy where every file is one range; where one has more, the
    rows are written once below ``spark.checkpoint.dir``, so that files are read once."""
    from ..session import materialized

    paths = _as_list(path)
    raw = register(spark).read.format("import_files").option("paths", json.dumps(paths)).option("range_bytes", range_bytes).load()
    if all(size <= range_bytes for _, size in list_files(paths)):
        return numbered(raw.where("ends IS NULL").withColumn("record", F.col("seq")), row_id)
    return numbered(resolved(materialized(raw, "import-files")), row_id)


def cells_as_columns(records: DataFrame, names: list[str]) -> DataFrame:
    """The cells of ``names`` as columns beside the others; a file without a column has nulls there."""
    kept = [c for c in records.columns if c != "cells"]
    return records.select(*kept, *[F.col("cells")[n].alias(n) for n in names if n not in kept])
