"""Files of any supported kind, in any store that Spark reads: listing, reading, inventory, and a write that is published at once."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CSV, JSON = ("csv", {"header": True, "inferSchema": True}), ("json", {"multiLine": True})
#: readers by extension
READERS = {".csv": CSV, ".json": JSON, ".jsonl": ("json", {}), ".parquet": ("parquet", {})}
INVENTORY = "path string, extension string, size_bytes long, rows long, column_count long, columns string, dtypes string, load_error string"


def store(spark: SparkSession, path: str):
    """The file system that holds a path, and the path as it names it."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, extension, size_bytes of every readable file below a folder; hidden ones and those in hidden folders are left out.
    A folder that doesn't exist has none."""
    fs, at = store(spark, folder)
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return spark.createDataFrame([], "path string, extension string, size_bytes long")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder)).select("path", "length")
    inside = F.expr(f"substr(path, {len(fs.resolvePath(at).toString()) + 1})")
    rows = found.filter(~inside.rlike(r"/\.")).select("path", extension(F.col("path")).alias("extension"), F.col("length").alias("size_bytes"))
    return rows.filter(F.col("extension").isin(*READERS)).orderBy("path")


def load_any_file(spark: SparkSession, path: str) -> DataFrame:
    kind = next((v for k, v in READERS.items() if str(path).lower().endswith(k)), None)
    if not kind:
        raise ValueError(f"Unsupported file type: {path}")
    return spark.read.format(kind[0]).options(**kind[1]).load(str(path))


#: files up to this many bytes are inspected whole by one task each; a larger one gets jobs of its own
WHOLE = 64 << 20


def _look(ending: str, content: bytes) -> tuple[int, list[str], list[str]]:
    """Rows, columns and their types of one file."""
    import pyarrow.csv
    import pyarrow.json
    import pyarrow.parquet
    from pyspark.sql.pandas.types import from_arrow_type

    data = pa.BufferReader(content)
    if ending == ".parquet":
        file = pyarrow.parquet.ParquetFile(data)
        rows, schema = file.metadata.num_rows, file.schema_arrow
    else:
        if ending == ".csv":
            table = pyarrow.csv.read_csv(data, parse_options=pyarrow.csv.ParseOptions(newlines_in_values=True))
        elif ending == ".jsonl":
            table = pyarrow.json.read_json(data)
        else:
            found = json.loads(bytes(content))
            table = pa.Table.from_pylist(found if isinstance(found, list) else [found])
        rows, schema = table.num_rows, table.schema
    return rows, schema.names, [from_arrow_type(t).simpleString() for t in schema.types]


def _described(path: str, ending: str, size: int, look: Callable[[], tuple[int, list[str], list[str]]], errors: type | tuple) -> tuple:
    try:
        rows, columns, types = look()
    except errors as error:
        return path, ending, size, None, None, None, None, (str(error).splitlines() or [type(error).__name__])[0]
    return path, ending, size, rows, len(columns), json.dumps(columns, ensure_ascii=False), json.dumps(types), None


def inspect_dataset(spark: SparkSession, folder: str, whole: int = WHOLE) -> DataFrame:
    """One row per file; a file that can't be read has its error instead of counts. One job inspects all files up to `whole` bytes, each
    in its task; a larger file is counted by Spark, in as many tasks as it fills. A file of JSON may hold a list or one object."""
    shape = [(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in INVENTORY.split(", "))]

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, ending, size, content in zip(*(batch.column(c) for c in ("path", "extension", "size_bytes", "content"))):
                look = partial(_look, ending.as_py(), content.as_buffer())
                row = _described(path.as_py(), ending.as_py(), size.as_py(), look, Exception)  # whatever a parser finds in a file
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, shape)], names=[n for n, _ in shape])

    files = raw_files(spark, folder)
    if files.isEmpty():
        return spark.createDataFrame([], INVENTORY)
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder)).filter(F.col("length") <= whole).select("path", "content")
    small = contents.join(F.broadcast(files.filter(F.col("size_bytes") <= whole)), "path").mapInArrow(inspect, INVENTORY)  # names are few
    batch, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(batch, "1")  # one file's content at a time
    try:
        small = written(small, "inventory")
    finally:
        spark.conf.set(batch, before)
    large = []
    for path, ending, size in map(tuple, files.filter(F.col("size_bytes") > whole).toLocalIterator()):
        def look(path: str = path) -> tuple[int, list[str], list[str]]:
            df = load_any_file(spark, path)
            return df.count(), df.columns, [t for _, t in df.dtypes]

        large.append(_described(path, ending, size, look, PySparkException))
    return small.union(spark.createDataFrame(large, INVENTORY)).orderBy("path")


def write_inventory(inventory: DataFrame, path: str) -> None:
    inventory.coalesce(1).write.mode("overwrite").option("header", True).csv(str(path))


def publish(df: DataFrame, path: str) -> None:
    """df as Parquet at path. It is written beside its place and moved in when complete, so that readers find the old table or
    the new one; the old one goes last, and comes back if the move fails."""
    fs, to = store(df.sparkSession, path)
    mark = uuid.uuid4().hex
    aside, old = (to.suffix(f".{what}-{mark}") for what in ("new", "old"))
    try:
        df.write.parquet(aside.toString())
        had = fs.exists(to) and fs.rename(to, old)
        if not fs.rename(aside, to):
            if had:
                fs.rename(old, to)
            raise OSError(f"can't publish {path}")
        fs.delete(old, True)
    finally:
        fs.delete(aside, True)


#: the scratch folder of each application
_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application's own, inside the one that the cluster names in spark.checkpoint.dir. Where it names none: inside
    a temporary folder if everything runs on this machine, the warehouse (which executors share) if not. It goes when the
    application ends."""
    application = spark.sparkContext.applicationId
    if application not in _folders:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            alone = spark.sparkContext.master.split("[")[0] == "local"
            top = tempfile.mkdtemp(prefix="spark-scratch-") if alone else spark.conf.get("spark.sql.warehouse.dir")
        folder = f"{top.rstrip('/')}/scratch-{application}-{uuid.uuid4().hex[:8]}"
        fs, at = store(spark, folder)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _folders[application] = folder
    return _folders[application]


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """df written to the shared folder and read again: what several plans read is computed once. partition_by: columns that lay out
    the table in folders, which filters on them prune."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.hint("rebalance", *partition_by) if partition_by else df).write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes what written() wrote for these tables, once nothing reads them any more."""
    for path in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        fs, at = store(spark, path)
        fs.delete(at, True)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """path and SHA-256 of each readable file. One file is held at a time."""
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder))
    return whole.select("path", F.sha2("content", 256).alias("sha256"))


def display_path(path: str, root: str) -> str:
    """path as it is shown: from the root on, if it lies there."""
    at = PurePosixPath(str(path))
    return str(at.relative_to(root)) if at.is_relative_to(root) else str(at)


def require(spark: SparkSession, path: str, what: str, hint: str) -> str:
    """path, if there is something; else an error that tells what to do first."""
    fs, at = store(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(f"Missing {what}: {path}. {hint}")
    return path


#: what each stage reads, and what to do where it is missing
INPUTS = {
    "features": ("clean alerts input", "Build the clean intervals first."),
    "metrics": ("required feature input", "Build the features first."),
    "timeseries": ("required metrics input", "Build the metrics first."),
}


def stage_input(spark: SparkSession, stage: str, path: str, columns: set[str]) -> DataFrame:
    """The table that a stage reads; an error if it isn't there or lacks a column."""
    what, hint = INPUTS[stage]
    return require_columns(spark.read.parquet(require(spark, path, what, hint)), columns, what)


def missing_columns(df: DataFrame, columns: set[str]) -> list[str]:
    return sorted(set(columns) - set(df.columns))


def has_columns(df: DataFrame, columns: set[str]) -> bool:
    return not missing_columns(df, columns)


def require_columns(df: DataFrame, columns: set[str], label: str) -> DataFrame:
    missing = missing_columns(df, columns)
    if missing:
        raise ValueError(f"Missing required columns in {label}: {', '.join(missing)}")
    return df


def file_status(spark: SparkSession, folder: str, names: list[str]) -> dict[str, dict]:
    out = {}
    for name in names:
        fs, at = store(spark, f"{folder}/{name}")
        there = fs.exists(at)
        out[name] = {"exists": there, "size_bytes": fs.getFileStatus(at).getLen() if there else None}
    return out


def missing_files(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    return [n for n, s in file_status(spark, folder, names).items() if not s["exists"]]


def build_manifest(spark: SparkSession, folder: str, names: list[str], before: dict, archive: dict | None = None) -> dict:
    """What is known of the archive (from now, or as the manifest had it) and the state of each expected file."""
    kept = {k: v for k, v in before.items() if k != "files"}
    return kept | (archive or {}) | {"files": file_status(spark, folder, names)}


def read_manifest(spark: SparkSession, path: str) -> dict:
    fs, at = store(spark, path)
    return json.loads(spark.read.text(str(path), wholetext=True).first()[0]) if fs.exists(at) else {}


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    fs, at = store(spark, path)
    out = fs.create(at, True)
    out.write(bytearray((json.dumps(manifest, ensure_ascii=False, indent=2) + "\n").encode()))
    out.close()


def load_tables(spark: SparkSession, folder: str, required: list[str], optional: list[str]) -> dict[str, DataFrame | None] | None:
    """Tables by name; None if a required one is missing, and None in place of an optional one that is."""
    there = {n: s["exists"] for n, s in file_status(spark, folder, [f"{x}.parquet" for x in (*required, *optional)]).items()}
    if not all(there[f"{n}.parquet"] for n in required):
        return None
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") if there[f"{n}.parquet"] else None for n in (*required, *optional)}

