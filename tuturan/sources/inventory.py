"""Inventory of files as a Spark job: folders are rows, executors list them, level by level.

Spark's own file index keeps the status of every file in the driver. Here a level's folders are dealt
out over tasks, each task asks the file system for the children of its folders, and what it finds is
written to the shared folder; folders found there are the rows of the next level. The driver only
ever holds the number of folders of a level.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from tuturan.session import store

LISTED = "path string, length bigint, is_folder boolean"
FOLDERS_A_TASK = 32
ROWS_A_BATCH = 10_000


def qualified(spark: SparkSession, folder: str) -> str:
    """A path as the readers write it, with scheme and without a last slash."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(path).toString().rstrip("/")


def path_exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _opened(uri: str):
    """File system and place of a URI that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def glob_pattern(pattern: str) -> str:
    r"""A file-name pattern (``*``, ``?``, ``[..]``, ``{a,b}``, ``\x``) as a regular expression."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i])
        elif close > 0:
            inner = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[^{inner[1:]}]" if inner[0] in "!^" else f"[{inner}]")
            i = close
        elif c == "{" and "}" in pattern[i:]:
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append({"*": ".*", "?": "."}.get(c) or (c if c.isalnum() else "\\" + c))
        i += 1
    return f"^(?s:{''.join(out)})$"


def _list_level(folders: DataFrame, open_root: Callable[[], tuple], root: str) -> DataFrame:
    """Children of every folder; paths keep the form of ``root``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = open_root()
        top = top.rstrip("/")
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                place = top + folder[len(root) :]
                found = system.get_file_info(fs.FileSelector(place or "/", recursive=False))
                for start in range(0, len(found), ROWS_A_BATCH):
                    part = found[start : start + ROWS_A_BATCH]
                    is_folder = [i.type == fs.FileType.Directory for i in part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([f"{folder}/{i.base_name}" for i in part], pa.string()),
                            pa.array([0 if d else i.size for i, d in zip(part, is_folder)], pa.int64()),
                            pa.array(is_folder, pa.bool_()),
                        ],
                        names=["path", "length", "is_folder"],
                    )

    return folders.mapInArrow(run, LISTED)


def list_files(
    spark: SparkSession,
    folder: str,
    pattern: str = "*",
    open_root: Callable[[], tuple] | None = None,
) -> DataFrame:
    """``path`` and ``length`` of every file below a folder whose name fits a pattern.

    As for Spark's readers, hidden names (beginning with a dot or, without an equals sign, an
    underscore) and empty files are left out. ``open_root`` is called in the tasks and gives the file
    system (pyarrow's) and the place of ``folder``; without it both come from the URI. A scheme that
    pyarrow does not know is listed by Spark's index, whose statuses fit the driver or not at all.
    """
    root = qualified(spark, folder)
    if open_root is None:
        try:
            # "file:/x" is a local path to Spark, "file:///x" to pyarrow
            uri = root.replace("file:/", "file:///", 1) if root.startswith("file:/") else root
            _opened(uri)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError):
            return _listed_by_spark(spark, folder, pattern)
        open_root = lambda: _opened(uri)
    name = F.substring_index("path", "/", -1)
    hidden = name.startswith(".") | (name.startswith("_") & ~F.contains(name, F.lit("=")))
    level, levels, folders = spark.createDataFrame([(root,)], "path string"), [], 1
    while folders:
        tasks = max(1, min(-(-folders // FOLDERS_A_TASK), 16 * spark.sparkContext.defaultParallelism))
        if folders > 1:  # one folder needs no dealing out
            level = level.repartition(max(tasks, min(folders, spark.sparkContext.defaultParallelism)))
        found = store(_list_level(level, open_root, root).where(~hidden), "listed")
        levels.append(found.where("NOT is_folder AND length > 0").select("path", "length"))
        level = found.where("is_folder").select("path")
        folders = level.count()
    return reduce(DataFrame.unionByName, levels).where(name.rlike(glob_pattern(pattern)))


def _listed_by_spark(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
    )
    return files.select("path", "length")


# As in functions/arrow: workers get these functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
