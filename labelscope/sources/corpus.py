"""Corpus file scans and layouts (tasks or the binaryFile source, text sink).

A collection is a tree of files. Where its store is a mounted file system, tasks
list and read it and the list is a stored table, so the driver holds no names;
in other stores Spark's binaryFile source does, whose list the driver holds. Usually an item is a file and its label the
folder it lies in. Spark names its output files itself, so items that Spark
writes lie in a folder each, ``label=<label>/name=<file name>/``; with
``layout="folder"`` the scans take such folders for the files.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from labelscope.functions.fixed_values import SOURCE_EXTENSIONS
from labelscope.functions.text import basename, decode_source_bytes, ends_with_any, parent_dir
from labelscope.session import scratch_path
from labelscope.sources.paths import exists, mounted

_FILES = "path string, below string, filename string, gold_label string, length long"


def _glob(extensions: Sequence[str]) -> str:
    exts = [e.lstrip(".") for e in extensions]
    return "*." + (exts[0] if len(exts) == 1 else "{" + ",".join(exts) + "}")


def _below(path: Column, root: str) -> Column:
    """The part of a path below the root, with its leading '/'."""
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root).rstrip("/")
    return F.substring(path, F.instr(path, plain) + len(plain), F.lit(1 << 30))


_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _listed(reader: DataFrameReader, spark: SparkSession, root: str) -> DataFrame:
    """``load``, with the folders listed by a few tasks for each core. Spark
    alone starts a task for each folder, up to 10,000."""
    before = spark.conf.get(_LISTING_TASKS, None)
    try:
        tasks = 4 * spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - a Spark Connect session has no SparkContext
        return reader.load(root)
    spark.conf.set(_LISTING_TASKS, min(tasks, int(before or tasks)))
    try:
        return reader.load(root)
    finally:
        spark.conf.unset(_LISTING_TASKS) if before is None else spark.conf.set(_LISTING_TASKS, before)


#: Names that a task meets below a folder before it leaves its subfolders to others.
_MOST_MET = 10_000


def _walked(spark: SparkSession, base: str, start: str, ends: Sequence[str]) -> DataFrame:
    """path and length of the files below a mounted folder, those that Spark
    finds too, as a stored table. A task goes down from its folder until it has
    met many names; the folders that it leaves are dealt out in a next round."""
    store, tasks = scratch_path(spark, "listing"), 4 * spark.sparkContext.defaultParallelism
    schema, rounds = "path string, length long", []
    folders = spark.range(0, 1, 1, 1).select(F.lit(base).alias("path"))
    while True:
        rounds.append(f"{store}/{len(rounds)}")
        # Not compressed: joins take the size of the files for that of the rows.
        folders.mapInArrow(_walker(start, tuple(ends), _MOST_MET), schema).write.option("compression", "none").parquet(rounds[-1])
        left = spark.read.schema(schema).parquet(rounds[-1]).where("length IS NULL").select("path")
        if left.isEmpty():
            break
        folders = left.repartition(tasks)
    return spark.read.schema(schema).parquet(*rounds).where("length IS NOT NULL").select(
        F.concat(F.lit("file:"), "path").alias("path"), "length")


def _walker(start: str, ends: tuple[str, ...], most: int):
    """Folders to the files below them and, without a length, the folders left."""
    def walk(batches):
        import errno
        import os
        import pyarrow as pa

        def hidden(name):                              # Spark's rule
            return name.startswith(".") or (name.startswith("_") and "=" not in name)

        def kept(name):
            return name.startswith(start) and name.endswith(ends) and not hidden(name) and not name.endswith("._COPYING_")

        def entered(name):
            return name.startswith(("_metadata", "_common_metadata")) or not (hidden(name) or name.endswith("._COPYING_"))

        def listing(folder):
            try:
                with os.scandir(folder) as entries:
                    yield from entries
            except FileNotFoundError:                  # gone meanwhile
                return

        def below(top):
            if os.path.isfile(top):
                if kept(os.path.basename(top)) and os.path.getsize(top):
                    yield top, os.path.getsize(top)
                return
            waiting, met = [top], 0
            while waiting:
                folder = waiting.pop()
                if met > most:
                    yield folder, None
                    continue
                for e in listing(folder):
                    met += 1
                    try:
                        e.name.encode()
                        if e.is_dir():
                            if entered(e.name) and met > most:
                                yield e.path, None
                            elif entered(e.name):
                                waiting.append(e.path)
                        elif kept(e.name) and (length := e.stat().st_size):
                            yield e.path, length
                    except UnicodeEncodeError:         # the JVM can't open such names
                        continue
                    except OSError as x:
                        if x.errno not in (errno.ENOENT, errno.ELOOP):
                            raise

        def table(rows):
            paths, lengths = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], ["path", "length"])

        rows = []
        for batch in batches:
            for top in batch.column(0).to_pylist():
                for row in below(top):
                    rows.append(row)
                    if len(rows) == 5000:
                        yield table(rows)
                        rows = []
        if rows:
            yield table(rows)

    return walk


def _file_reader(most: int, together: int = 1 << 22):
    """(path, file) to (path, content); files that can't be read, have grown
    beyond ``most`` bytes or differ from their checksums are left out."""
    def read(batches):
        import os
        import zlib
        import pyarrow as pa

        def intact(content, file):
            """By Hadoop's checksums, which lie beside files that Spark wrote;
            like there, a damaged list of them counts as none."""
            folder, name = os.path.split(file)
            try:
                with open(f"{folder}/.{name}.crc", "rb") as f:
                    sums = f.read()
            except OSError:
                return True
            if sums[:4] != b"crc\0" or len(sums) < 8:
                return True
            size = int.from_bytes(sums[4:8], "big", signed=True)
            return size > 0 and len(sums) % 4 == 0 and all(
                sums[at:at + 4] == zlib.crc32(content[i:i + size]).to_bytes(4, "big")
                for at, i in zip(range(8, 8 + len(content) * 4, 4), range(0, len(content), size)))

        def opened(file):
            if ":" in os.path.basename(file):
                raise OSError("Hadoop can't open such names")
            return open(file, "rb")

        def table(paths, contents):
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

        paths, contents, held = [], [], 0
        for batch in batches:
            for path, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = file.removeprefix("file:")
                try:
                    with opened(file) as f:
                        content = f.read(most + 1)
                except OSError:
                    continue
                if len(content) > most or not intact(content, file):
                    continue
                if paths and held + len(content) > together:
                    yield table(paths, contents)
                    paths, contents, held = [], [], 0
                paths.append(path)
                contents.append(content)
                held += len(content)
        if paths:
            yield table(paths, contents)

    return read


def _scan(spark: SparkSession, root: str, extensions: Sequence[str], layout: str) -> DataFrame:
    """path (of the item), below, filename, gold_label, length and the file's
    path (``file``) or, where Spark reads it, its ``content``."""
    if layout not in ("file", "folder"):
        raise ValueError(f"unknown layout {layout}")
    base = mounted(spark, root)
    if base is not None:
        df = _walked(spark, base, *(("", ["." + e.lstrip(".") for e in extensions]) if layout == "file" else ("part-", [""])))
        df = df.withColumn("file", F.col("path"))
    else:
        # Unreadable files lose their content, not the job.
        df = _listed(spark.read.format("binaryFile").option("recursiveFileLookup", True)
                     .option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
                     .option("pathGlobFilter", _glob(extensions) if layout == "file" else "part-*"), spark, root)
    if layout == "file":
        below = _below(F.col("path"), root)
    else:
        df = df.withColumn("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
        # Folders are named key=value, the value with %XX for some characters.
        values = F.regexp_replace(_below(F.col("path"), root), r"/[^=/]*=", "/")
        below = F.url_decode(F.replace(values, F.lit("+"), F.lit("%2B")))
    df = df.withColumn("below", below).select(
        "path", "below", basename("below").alias("filename"), parent_dir("below").alias("gold_label"), "length",
        "content" if base is None else "file")
    return df if layout == "file" else df.where(ends_with_any("filename", extensions))


def scan_files(spark: SparkSession, root: str,
               extensions: Sequence[str] = SOURCE_EXTENSIONS, layout: str = "file") -> DataFrame:
    """Recursive listing of files with a kept extension (case-sensitive):
    path, below (the path below the root), filename, gold_label (parent
    folder), length. File bytes are not
    read (the scan is pruned to metadata). A missing root gives no rows; one
    that can't be looked at is an error."""
    if not exists(spark, root):
        return spark.createDataFrame([], _FILES)
    return _files(_scan(spark, root, extensions, layout))


def _files(scan: DataFrame) -> DataFrame:
    return scan.drop("content", "file")


def read_items(spark: SparkSession, root: str,
               extensions: Sequence[str] = SOURCE_EXTENSIONS, layout: str = "file") -> DataFrame:
    """Items with decoded text: path, below, filename, gold_label, content. A file
    that is listed but cannot be read keeps its row, with NULL content, so
    that it is counted (``run_metadata`` with ``items``) and can be reported.
    The listing reads no bytes; the texts are joined to it by path."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, below string, filename string, gold_label string, content string")
    scan = _scan(spark, root, extensions, layout)         # one listing serves both
    # Spark can't tell the size of texts that tasks read, and might broadcast them.
    return _files(scan).drop("length").join(_texts(scan).hint("merge"), "path", "left")


def read_texts(spark: SparkSession, root: str,
               extensions: Sequence[str] = SOURCE_EXTENSIONS, layout: str = "file") -> DataFrame:
    """path and decoded content of the files that can be read, in one scan.
    Files longer than a binary value may be are not opened."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, content string")
    return _texts(_scan(spark, root, extensions, layout))


def _texts(scan: DataFrame) -> DataFrame:
    spark = scan.sparkSession
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str((1 << 31) - 1)))
    short = scan.where(F.col("length") <= most)
    if "file" in scan.columns:
        short = short.select("path", "file").repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(
            _file_reader(most), "path string, content binary")
    return short.select("path", decode_source_bytes("content").alias("content"))


def write_items(items: DataFrame, root: str, name_col: str = "filename", label_cols: Sequence[str] = ("gold_label",),
                content_col: str = "content", mode: str = "overwrite") -> str:
    """Write each item as a text file in a folder of its own below its label's
    (``layout="folder"``). Each text ends with a new line.

    Where the store is a mounted file system, the tasks write their files
    themselves; Spark's partitioned writer, used elsewhere, takes many
    milliseconds there for a folder. The layout is the same."""
    spark = items.sparkSession
    folders = [*label_cols, "name"]
    named = items.select(*label_cols, F.col(name_col).alias("name"), F.col(content_col).alias("value"))
    base = mounted(spark, root)
    if base is None:
        named.write.mode(mode).partitionBy(*folders).text(root)
        return root
    if mode == "ignore" and exists(spark, root):
        return root
    # No rows: clears, makes or refuses the root, as the mode says.
    named.limit(0).write.mode(mode).partitionBy(*folders).text(root)
    (named.select(*[F.col(c).cast("string").alias(c) for c in folders], F.col("value").cast("binary").alias("value"))
        .sortWithinPartitions(*folders).foreachPartition(_file_writer(base, folders)))
    return root


def _file_writer(base: str, folders: Sequence[str]):
    """Writes the sorted rows of a task: (value of each folder, text). A file
    gets its name when it is whole, so a task may run again."""
    job = uuid.uuid4().hex

    def folder(key, value):
        import re
        if not value:
            return f"{key}=__HIVE_DEFAULT_PARTITION__"
        return key + "=" + re.sub(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value)

    def write(rows):
        import itertools
        import os
        import uuid
        from pyspark import TaskContext
        name = f"part-{TaskContext.get().partitionId():05d}-{job}"
        for values, group in itertools.groupby(rows, key=lambda r: tuple(r)[:-1]):
            place = "/".join([base, *map(folder, folders, values)])
            os.makedirs(place, exist_ok=True)
            unfinished = f"{place}/.{uuid.uuid4().hex}"
            with open(unfinished, "wb") as f:
                for row in group:
                    f.write(bytes(row[-1] or b"") + b"\n")
            os.replace(unfinished, f"{place}/{name}")

    return write
