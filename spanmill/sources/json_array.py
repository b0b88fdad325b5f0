"""A JSON file that holds one large array, read in many tasks.

The array is the file itself, or the member of a name (such as "samples") of one top-level object. A file is cut into ranges of bytes, and
where a range starts is told in passes over all ranges at once:

1. Without knowing whether it starts inside a string, each range tells how many quotes it holds and how the depth of brackets changes
   outside and inside of strings. These few numbers a range, put together in order, give the true state at each start.
2. With it, each range finds the wrapper's key (if there is one), then its separators: the opening bracket and the commas of the array.
3. Each range reads the elements that follow its separators, past its end if it must, and numbers them from the counts of the earlier ones.

Elements are read whole: what has to fit into memory is a range or one element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range, at most and at least. A task works on one range at a time, in some twenty times its bytes.
RANGE, LEAST = 2 << 20, 1 << 14
#: Bytes looked at before a range for backslashes that belong to its first quote, at a time.
BACK = 1 << 10
QUOTE, SLASH, OPEN, CLOSE, COMMA = 34, 92, (91, 123), (93, 125), 44


def _opened(path: str):
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    else:
        fs, inner = pyarrow.fs.LocalFileSystem(), path
    return fs.open_input_file(inner)


def _slashes_before(f, start: int) -> int:
    """How many backslashes end right before this place."""
    n = 0
    while start > 0:
        size = min(BACK, start)
        b = f.read_at(size, start - size)
        m = size - len(b.rstrip(b"\\"))
        n += m
        if m < size:
            break
        start -= size
    return n


def quotes(b: np.ndarray, before: int = 0) -> np.ndarray:
    """Places of the quotes that no backslash escapes; before: how many backslashes end right before b."""
    at = np.flatnonzero(b == QUOTE)
    if not len(at):
        return at
    slashes = np.flatnonzero(b == SLASH)
    starts = slashes[np.concatenate([[True], np.diff(slashes) != 1])] if len(slashes) else slashes
    run = np.zeros(len(at), np.int64)
    if len(slashes):
        follows = (at > 0) & (b[at - 1] == SLASH)
        first = starts[np.searchsorted(starts, at[follows] - 1, "right") - 1]
        run[follows] = at[follows] - first + np.where(first == 0, before, 0)
    if at[0] == 0:
        run[0] = before
    return at[run % 2 == 0]


def structure(b: np.ndarray, inside: bool, before: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places and depth changes of the brackets outside of strings (commas change nothing); inside: whether b starts in a string."""
    q = quotes(b, before)
    at = np.flatnonzero(np.isin(b, (*OPEN, *CLOSE, COMMA)))
    out = (np.searchsorted(q, at, "left") + inside) % 2 == 0
    at = at[out]
    c = b[at]
    return at, np.isin(c, OPEN).astype(np.int64) - np.isin(c, CLOSE).astype(np.int64)


def _scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            with _opened(r.path) as f:
                before = _slashes_before(f, r.start)
                b = np.frombuffer(f.read_at(r.stop - r.start, r.start), np.uint8)
            odd = len(quotes(b, before)) % 2
            rows.append((r.path, r.number, odd, *[int(structure(b, i, before)[1].sum()) for i in (False, True)]))
        yield pd.DataFrame(rows, columns=["path", "number", "odd", "out", "inside"])


def _located(wrapper: str):
    """For each range where the array opens: right behind the file's first bracket, or the wrapper's key."""
    key = re.compile(rb'"' + re.escape(wrapper.encode()) + rb'"\s*:\s*\[')

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                with _opened(r.path) as f:
                    head = f.read_at(64, r.first)
                    raw = f.read_at(r.stop - r.start + 4 * len(wrapper) + 256, r.start)
                    before = _slashes_before(f, r.start)
                if head.removeprefix(b"\xef\xbb\xbf").lstrip()[:1] == b"[":
                    if r.start <= (at := r.first + head.index(b"[")) < r.stop:
                        rows.append((r.path, at, 1))
                    continue
                b = np.frombuffer(raw, np.uint8)
                q = quotes(b, before)
                at, change = structure(b, r.inside, before)
                depth = r.depth + np.cumsum(change)
                for m in key.finditer(raw):
                    i, bracket = m.start(), m.end() - 1
                    # a key opens a string at depth 1, in this range
                    known = np.searchsorted(at, i, "right") - 1
                    if i < r.stop - r.start and i in q and (np.searchsorted(q, i) + r.inside) % 2 == 0 and (depth[known] if known >= 0 else r.depth) == 1:
                        rows.append((r.path, r.start + bracket, 2))
                        break
            yield pd.DataFrame(rows, columns=["path", "opens", "base"])

    return run


def _separators(b: np.ndarray, r, before: int) -> tuple[np.ndarray, int]:
    """Places in the file of the array's opening bracket and commas in this range, and of its closing bracket (-1: elsewhere)."""
    at, change = structure(b, r.inside, before)
    depth = r.depth + np.cumsum(change)
    place = at + r.start
    ends = place[(depth == r.base - 1) & (change < 0) & (place > r.opens)]
    commas = place[(change == 0) & (depth == r.base) & (place > r.opens)]
    end = int(ends[0]) if len(ends) else -1
    if end >= 0:
        commas = commas[commas < end]
    if r.start <= r.opens < r.stop:
        commas = np.concatenate([[r.opens], commas])
    return commas, end


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            with _opened(r.path) as f:
                before = _slashes_before(f, r.start)
                b = np.frombuffer(f.read_at(r.stop - r.start, r.start), np.uint8)
            commas, end = _separators(b, r, before)
            rows.append((r.path, r.number, len(commas), end))
        yield pd.DataFrame(rows, columns=["path", "number", "n", "end"])


def _element(f, start: int) -> bytes:
    """The text from right behind a separator up to the next one of the same depth, piece by piece."""
    held, depth, inside, at, before = [], 0, False, start, 0
    while True:
        raw = f.read_at(1 << 16, at)
        if not raw:
            return b"".join(held)
        b = np.frombuffer(raw, np.uint8)
        places, change = structure(b, inside, before)
        level = depth + np.cumsum(change)
        ends = places[((change == 0) & (level == 0)) | (level < 0)]
        if len(ends):
            return b"".join([*held, raw[: ends[0]]])
        held.append(raw)
        inside ^= bool(len(quotes(b, before)) % 2)
        depth += int(change.sum())
        tail = len(raw) - len(raw.rstrip(b"\\"))
        before = before + tail if tail == len(raw) else tail
        at += len(raw)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "position", "element"]
    for batch in batches:
        for r in batch.to_pandas().itertuples(index=False):
            with _opened(r.path) as f:
                before = _slashes_before(f, r.start)
                raw = f.read_at(r.stop - r.start, r.start)
                commas, end = _separators(np.frombuffer(raw, np.uint8), r, before)
                stops = [*commas[1:].tolist(), end if end >= 0 else None] if len(commas) else []
                texts = []
                for a, z in zip(commas.tolist(), stops, strict=True):
                    own = raw[a + 1 - r.start : z - r.start] if z is not None else _element(f, a + 1)
                    texts.append(own.strip())
            keep = [i for i, t in enumerate(texts) if t or len(texts) > 1 or r.whole > 1]  # [ ] has no element
            for at in range(0, len(keep), 1000):
                few = keep[at : at + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([r.path] * len(few)), pa.array([r.earlier + i for i in few], pa.int64()), pa.array([texts[i].decode("utf-8", "replace") for i in few])], names=names)


def _size(total: int, cores: int) -> int:
    """Bytes of a range of files with this many bytes."""
    return min(RANGE, max(LEAST, total // (4 * cores)))


def _tasks(ranges: int, cores: int) -> int:
    """A task for each range of few, and for some of many small ones: a task costs more than such a range."""
    return max(1, min(ranges, 8 * cores), ranges // 64)


RANGES = "path string, number long, first long, start long, stop long"


def elements(spark: SparkSession, path: str | list[str], wrapper: str = "samples", size: int | None = None) -> DataFrame:
    """path, position (from 0, in its file) and element (JSON text) of the arrays in the files at path (a file or a folder).

    Files in UTF-8, with or without a byte order mark. An empty array, an empty file and an object without the wrapper's key give no rows.
    Ranges are of `size` bytes; without it of RANGE, or of less where that gives no range to some of the cores. What comes to the driver is a few numbers a range.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    cores = spark.sparkContext.defaultParallelism
    if size is None:
        total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
        size = _size(total, cores)
    ranges = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}"))).alias("number"))
    ranges = ranges.select("path", "number", (F.col("number") * size).alias("start"), F.least((F.col("number") + 1) * size, F.col("length")).alias("stop"))
    found = ranges.repartition(_tasks(ranges.count(), cores)).mapInPandas(_scanned, "path string, number long, odd int, out long, inside long").join(ranges, ["path", "number"]).orderBy("path", "number").collect()
    if not found:
        return spark.createDataFrame([], "path string, position long, element string")
    heads, rows, inside, depth = {}, [], False, 0
    for r in found:
        if r["number"] == 0:
            inside, depth = False, 0
            heads[r["path"]] = 0
        rows.append((r["path"], r["number"], heads[r["path"]], r["start"], r["stop"], inside, depth))
        depth += r["inside"] if inside else r["out"]
        inside ^= bool(r["odd"])
    known = spark.createDataFrame(rows, RANGES + ", inside boolean, depth long")
    spread = known.withColumn("first", F.lit(0).cast("long")).repartition(_tasks(len(rows), cores))
    located = spread.mapInPandas(_located(wrapper), "path string, opens long, base long").orderBy(F.col("opens").desc()).collect()  # one a file
    opens = {r["path"]: (r["opens"], r["base"]) for r in located}
    rows = [(*r, *opens[r[0]]) for r in rows if r[0] in opens]
    if not rows:
        return spark.createDataFrame([], "path string, position long, element string")
    schema = RANGES + ", inside boolean, depth long, opens long, base long"
    counts = {(r["path"], r["number"]): (r["n"], r["end"]) for r in spark.createDataFrame(rows, schema).repartition(_tasks(len(rows), cores)).mapInPandas(_counted, "path string, number long, n long, end long").collect()}
    whole: dict[str, int] = {}
    told, over = [], set()
    for r in rows:
        n, end = counts[r[0], r[1]]
        if r[0] not in over and r[4] > r[7]:
            told.append((*r, whole.get(r[0], 0)))
            whole[r[0]] = whole.get(r[0], 0) + n
        if end >= 0:
            over.add(r[0])
    plan = spark.createDataFrame([(*r, whole[r[0]]) for r in told], schema + ", earlier long, whole long")
    return plan.repartition(_tasks(len(told), cores)).mapInArrow(_read, "path string, position long, element string")


def read_array(spark: SparkSession, path: str | list[str], schema: str, wrapper: str = "samples", size: int | None = None) -> DataFrame:
    """The elements as columns of the schema, with position. Elements that are no objects of that form have nulls."""
    read = elements(spark, path, wrapper, size).select("position", F.from_json("element", schema).alias("e"))
    return read.select("position", "e.*")


def by_id(df: DataFrame, *names: str) -> DataFrame:
    """df with key: the first of these columns that is not null or empty, else the position as text."""
    ids = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names]
    return df.withColumn("key", F.coalesce(*ids, F.col("position").cast("string")))


def write_arrays(df: DataFrame, path: str) -> None:
    """df as JSON arrays, one a task, without gathering rows: a folder of files that elements() reads."""
    lines = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for b in batches:
            if b.num_rows:
                texts = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([lead + texts[0], *[", " + t for t in texts[1:]]])], names=["value"])
                lead = ", "
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], names=["value"])

    lines.mapInArrow(run, "value string").write.text(path)
