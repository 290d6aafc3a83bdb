"""Readers of landed log files: what changed since the last scan, and the lines that came.

Files are listed by Spark. Everything after that runs where the rows of the listing are: a
task opens a file itself, reads the few bytes that tell an appended file from a rewritten
one, and the range of it that is new. No file is read whole for its first bytes, no content
passes a limit of a cell, and no list of names goes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import ship

HEAD = 256
PIECE = 32 << 20  # bytes of a file that a task reads as one piece
STEP = 4 << 20  # bytes that it asks for at a time
SEEN = "file string, size long, mtime timestamp, head string, done long, lines long"


def opened(file: str):
    """(size, a function that reads `n` bytes from `offset`) of a file by its URI, in the process that calls: local paths, or any store that Arrow knows."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(file) if "://" in file or file.startswith("file:/") else (fs.LocalFileSystem(), file)
    handle = store.open_input_file(path)

    def read(offset: int, n: int) -> bytes:
        handle.seek(offset)
        return handle.read(n)

    return handle.size(), read


def listing(spark: SparkSession, paths: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """(file, size, mtime) of each file, from the listing alone: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)
    name = F.regexp_replace("path", "^file:/+", "/")  # one spelling of a local path
    return files.select(name.alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


_MARKS = "file string, size long, mtime timestamp, head string, done long, lines long, rewritten boolean, stop long, known boolean"


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Opens each file for its first bytes, the byte before the place to go on from, and its end."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            size, read = opened(r["file"])
            size = min(size, r["size"])  # what came since the listing waits for the next scan
            head = lambda n: hashlib.sha256(read(0, n)).hexdigest()
            known, done = r["o_size"] is not None, r["o_done"] or 0
            rewritten = known and (size < r["o_size"] or head(min(HEAD, r["o_size"])) != r["o_head"] or (done > 0 and read(done - 1, 1) != b"\n"))
            stop = _last_line_end(read, size)
            rows.append({"file": r["file"], "size": r["size"], "mtime": r["mtime"], "head": head(min(HEAD, r["size"])), "done": 0 if rewritten else done, "lines": 0 if rewritten else r["o_lines"] or 0, "rewritten": rewritten, "stop": stop, "known": known})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("size", pa.int64()), ("mtime", batch.schema.field("mtime").type), ("head", pa.string()), ("done", pa.int64()), ("lines", pa.int64()), ("rewritten", pa.bool_()), ("stop", pa.int64()), ("known", pa.bool_())]))


def _last_line_end(read, size: int) -> int:
    """The byte after the last newline: a last line without an end waits for the next scan."""
    at, step = size, 1 << 16
    if size and read(size - 1, 1) == b"\n":
        return size
    while at > 0:
        start = max(0, at - step)
        found = read(start, at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at, step = start, min(step * 4, STEP)
    return 0


def changed(now: DataFrame, seen: DataFrame) -> DataFrame:
    """New files, and those whose size or time changed, with where to read on: (file, size, mtime, head, done, lines, rewritten, stop, known).

    `seen` has what the last scan left (SEEN). A file that grew and still has its first bytes
    and a line's end where the last scan stopped is read from there (`done` bytes, `lines`
    lines are known); one that shrank, or has other bytes there, is `rewritten` and read from
    its start. `stop` is the end of its last finished line.
    """
    ship(now.sparkSession)
    old = seen.select("file", *[F.col(c).alias(f"o_{c}") for c in ("size", "mtime", "head", "done", "lines")])
    both = now.join(old, "file", "left")
    both = both.where(F.col("o_size").isNull() | (F.col("size") != F.col("o_size")) | (F.col("mtime") != F.col("o_mtime")))
    return both.drop("o_mtime").mapInArrow(_marked, _MARKS)


def _pieces(files: DataFrame, keep: list[str]) -> DataFrame:
    starts = F.expr(f"explode(sequence(done, stop - 1, cast({PIECE} as bigint)))")
    return files.where("stop > done").select("file", *keep, "done", "stop", F.col("lines"), starts.alias("a")).withColumn("b", F.least("stop", F.col("a") + PIECE)).repartition("file", "a")


def _lines_in(read, a: int, b: int, first: int, stop: int) -> Iterator[bytes]:
    """Lines that start in [a, b); the first piece starts a line at its own start."""
    at, rest, skip = (a, b"", False) if a == first else (a - 1, b"", True)
    start = at  # of what is in rest
    while start < b:
        if at >= stop and not rest:
            return
        data = read(at, min(STEP, stop - at)) if at < stop else b""
        at += len(data)
        parts = (rest + data).split(b"\n")
        rest = parts.pop()
        for line in parts:
            if skip:
                skip = False
            elif start < b:
                yield line
            else:
                return
            start += len(line) + 1
        if not data:
            return


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        n = [sum(1 for _ in _lines_in(opened(r["file"])[1], r["a"], r["b"], r["done"], r["stop"])) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("a"), pa.array(n, pa.int64())], ["file", "a", "n"])


def _read(keep: list[str], types: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(r, first, lines):
            n = len(lines)
            text = pa.array([x.decode("utf-8", "replace").removesuffix("\r") for x in lines], pa.string())
            return pa.RecordBatch.from_arrays([*[pa.array([r[k]] * n, t) for k, t in zip(keep, types)], pa.array(range(first, first + n), pa.int64()), text], [*keep, "line_no", "line"])

        for batch in batches:
            for r in batch.to_pylist():
                held, size, number = [], 0, r["lines"] + r["ahead"] + 1
                for line in _lines_in(opened(r["file"])[1], r["a"], r["b"], r["done"], r["stop"]):
                    held.append(line)
                    size += len(line)
                    if size > STEP or len(held) >= 10_000:
                        yield out(r, number, held)
                        number, held, size = number + len(held), [], 0
                if held:
                    yield out(r, number, held)

    return run


def new_lines(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file, *keep, line_no, line) of what `changed` says is new, numbered from `lines` on.

    Files of one piece are read once. Longer ones are cut into pieces that are read apart;
    their lines are counted first, so that each piece knows its first number.
    """
    ship(files.sparkSession)
    names = ["file", *[k for k in keep if k != "file"]]
    pieces = _pieces(files, names[1:])
    counts = pieces.where(F.col("stop") - F.col("done") > PIECE).select("file", "a", "b", "done", "stop").mapInArrow(_counted, "file string, a long, n long")
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("a").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = pieces.join(ahead, ["file", "a"], "left").withColumn("ahead", F.coalesce("ahead", F.lit(0)))
    fields = [numbered.schema[n] for n in names]
    from pyspark.sql.pandas.types import to_arrow_type

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return numbered.mapInArrow(_read(names, [to_arrow_type(f.dataType) for f in fields]), f"{schema}, line_no long, line string")


def read_lines(spark: SparkSession, paths: str | list[str], account_id: str | Column, glob: str = "*.jsonl") -> DataFrame:
    """(account_id, file, line_no, line) of all finished lines of files, or of files below folders; `account_id` is a name or an expression over `file`."""
    account = F.lit(account_id) if isinstance(account_id, str) else account_id
    files = changed(listing(spark, paths, glob), spark.createDataFrame([], SEEN)).withColumn("account_id", account)
    return new_lines(files, ("account_id",)).select("account_id", "file", "line_no", "line")
