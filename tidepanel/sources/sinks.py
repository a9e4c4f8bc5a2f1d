"""Write-once tables, evidence bundles and the append-only scoreboard."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.operators.contracts import ID_PATTERN, ContractError, require_columns


def _existing(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame | None:
    try:
        return spark.read.format(kind).options(**options).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_stable(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write once, sorted by keys; an existing table must have the same columns and rows."""
    old = _existing(df.sparkSession, path)
    if old is None:
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)
        return
    if old.columns != df.columns or old.exceptAll(df).limit(1).count() or df.exceptAll(old).limit(1).count():
        raise ContractError(f"{path} holds other rows")


def write_json_stable(df: DataFrame, path: str) -> None:
    """Write an audit row once as JSON; an existing one must be equal."""
    old = _existing(df.sparkSession, path, "json")
    if old is None:
        df.coalesce(1).write.json(path)
        return
    canonical = lambda x: {r[0] for r in x.select(F.to_json(F.struct(*sorted(x.columns)))).collect()}
    if canonical(old) != canonical(df):
        raise ContractError(f"{path} holds another audit row")


def write_bundle(tables: dict[str, DataFrame], root: str, run_id: str, manifest: DataFrame | None = None, required: tuple[str, ...] = ()) -> None:
    """Evidence tables as CSV for one run; each is read back in full before the manifest that exposes the run.

    The tables go to a folder of this attempt, which the manifest names.  An attempt that fails leaves no manifest,
    so no reader sees it and the next attempt goes through; a run that has a manifest is refused.
    ``manifest`` is one row of further columns.
    """
    if sorted(required or tables) != sorted(tables):
        raise ContractError(f"artifacts {sorted(tables)} are not the required {sorted(required)}")
    spark = next(iter(tables.values())).sparkSession
    home, attempt = f"{root}/run_id={run_id}", uuid.uuid4().hex
    if _existing(spark, f"{home}/manifest", "json") is not None:
        raise ContractError(f"run {run_id} is published already")
    for name, table in tables.items():
        path, seen = f"{home}/attempt={attempt}/{name}", Observation()
        table.observe(seen, F.count(F.lit(1)).alias("n")).write.csv(path, header=True)
        back = spark.read.csv(path, header=True, schema=table.schema, multiLine=True).count()
        if back != seen.get["n"]:
            raise ContractError(f"{name} has {back} rows where {seen.get['n']} were written")
    row = manifest if manifest is not None else spark.range(1).select(F.lit(run_id).alias("run_id"))
    row = row.withColumns({"artifacts": F.array(*map(F.lit, sorted(tables))), "attempt": F.lit(attempt)})
    row.coalesce(1).write.json(f"{home}/manifest", ignoreNullFields=False)


def read_artifact(spark: SparkSession, root: str, run_id: str, name: str, schema: T.StructType) -> DataFrame:
    """A table of a published run, by way of its manifest."""
    found = _existing(spark, f"{root}/run_id={run_id}/manifest", "json")
    row = found.select("artifacts", "attempt").first() if found is not None else None
    if row is None or name not in row.artifacts:
        raise ContractError(f"run {run_id} has not published {name}")
    return spark.read.csv(f"{root}/run_id={run_id}/attempt={row.attempt}/{name}", header=True, schema=schema, multiLine=True)


def refuse_known_runs(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Refuse rows that repeat a key, among themselves or in the scoreboard."""
    old = _existing(rows.sparkSession, path)
    if rows.groupBy(*keys).count().where("count > 1").limit(1).count() or (old is not None and rows.join(old.select(*keys), keys, "left_semi").limit(1).count()):
        raise ContractError("the scoreboard has this run already")


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty marker file if it is not there: of any number of writers one gets True.

    Creation is a single step of the file system: exclusive creation on a mounted folder, creation without overwriting elsewhere.
    """
    place, fs = _path(spark, path)
    fs.mkdirs(place.getParent())
    try:
        if fs.getScheme() == "file":
            java = spark.sparkContext._jvm.java
            java.nio.file.Files.createFile(java.io.File(place.toUri().getPath()).toPath(), spark.sparkContext._gateway.new_array(java.nio.file.attribute.FileAttribute, 0))
        else:
            fs.create(place, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def release(spark: SparkSession, path: str) -> None:
    """Give a claim back."""
    place, fs = _path(spark, path)
    fs.delete(place, False)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder."""
    place, fs = _path(spark, path)
    fs.delete(place, True)


def _add_file(rows: DataFrame, path: str) -> None:
    """Few rows as one more file of the table ``path``: written beside it, then renamed into it."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    staged = f"{path.rstrip('/')}_staged/{name}"
    try:
        rows.coalesce(1).write.parquet(staged)
        place, fs = _path(spark, staged)
        into, _ = _path(spark, path)
        fs.mkdirs(into)
        for k, found in enumerate(f.getPath() for f in fs.listStatus(place) if f.getPath().getName().startswith("part-")):
            if not fs.rename(found, _path(spark, f"{path.rstrip('/')}/part-{k:05d}-{name}.parquet")[0]):
                raise ContractError(f"{found.toString()} could not be moved to {path}")
    finally:
        remove(spark, staged)


def append_run(rows: DataFrame, path: str, keys: tuple[str, ...] = ("factor_id", "run_id")) -> None:
    """Append to the scoreboard; a (factor, run) that it has, or that another writer is adding, is refused.

    Each key is claimed by a marker beside the table before its row is written, so of several writers one adds it; rows come
    into the table as one file by a rename, as writers to one folder remove each other's unfinished files.  Claims of an append that fails are given back; those of a writer that dies stay until ``release``.
    """
    spark = rows.sparkSession
    refuse_known_runs(rows, path, list(keys))
    found = [tuple(r) for r in rows.select(*keys).collect()]  # a row per run that is appended now
    if any(not isinstance(x, str) or not re.match(ID_PATTERN, x) for k in found for x in k):
        raise ContractError(f"ids are letters, digits, underscores and hyphens: {found}")
    taken: list[str] = []
    try:
        for key in found:
            marker = f"{path.rstrip('/')}_claims/{'/'.join(key)}"
            if not claim(spark, marker):
                raise ContractError(f"another writer has claimed {'/'.join(key)}")
            taken.append(marker)
        _add_file(rows, path)
    except BaseException:
        for marker in taken:
            release(spark, marker)
        raise


def load_scoreboard(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The scoreboard with exactly this schema; empty if there is none."""
    old = _existing(spark, path)
    if old is None:
        return spark.createDataFrame([], schema)
    require_columns(old, schema.names, exact=True)
    return old.select(*schema.names)


def mirror(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The stored table under a name of the catalog, for SQL of every session that shares it; its rows stay where they are.

    The files are listed anew, so rows appended since are seen.  A name that stands for another place is refused.
    """
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=path, source="parquet")
    at = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()
    place, fs = _path(spark, path)
    if at is None or at.data_type.rstrip("/") != fs.makeQualified(place).toString().rstrip("/"):
        raise ContractError(f"{name} is another table")
    spark.catalog.refreshTable(name)
    return spark.table(name)


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidepanel-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a folder of our own serves a local master, whose executors are this very process; a cluster
    is refused, as its executors do not see such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ContractError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or _own_dir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    An empty frame keeps its schema.  The files stay until ``discard`` or the folder's end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(table: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing to come reads it."""
    remove(table.sparkSession, table.stored_at)
