"""Stored tables that survive a crash: versions behind a pointer, and logs of committed batches.

Everything goes through Spark and Hadoop's file systems, so a table can be wherever Spark reads.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; where that is unset and the master is local
    (tests) a temporary folder is made once and set as the checkpoint folder.
    """
    jsc = spark.sparkContext._jsc.sc()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = jsc.getCheckpointDir()
        if not held.isDefined() and not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="lodestone-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    Its files go once nothing refers to the result, if the session was started with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``; otherwise the checkpoint folder has to be emptied
    after the application.
    """
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """A side that a join meets by a shuffle, whatever size Catalyst takes it for.

    The size of what is derived from a file is taken to be the file's bytes by the share of columns that are left, so
    millions of rows of a well packed file pass for a few megabytes and would be broadcast through the driver.
    """
    return df.hint("merge")


def hadoop(spark: SparkSession, path: str):
    """(FileSystem, Path) of a path, through Hadoop's API as Spark uses it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write a small JSON file under a temporary name, then rename it over what is there."""
    _rename(spark, _written(spark, path, value), path, "OVERWRITE")


def place_new(spark: SparkSession, path: str, value: dict) -> bool:
    """Write a small JSON file that isn't there yet; False if it is, by whoever was first."""
    temp = _written(spark, path, value)
    try:
        _rename(spark, temp, path, "NONE")
    except Py4JJavaError:
        remove(spark, temp)
        if exists(spark, path):
            return False
        raise
    return True


def _written(spark: SparkSession, path: str, value: dict) -> str:
    fs, temp = hadoop(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temp, True)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    finally:
        out.close()
    return str(temp)


def _rename(spark: SparkSession, old: str, new: str, how: str) -> None:
    """Rename a file, over another or only to a free name (atomic where the file system's rename is)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    _, a = hadoop(spark, old)
    _, b = hadoop(spark, new)
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, how)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b, options)


def read_table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of a table that ``replace_table`` wrote; none where there is no table yet."""
    if not exists(spark, f"{path}/current.json"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{read_json(spark, f'{path}/current.json')['version']}")


def generation(spark: SparkSession, path: str) -> str | None:
    """Names the contents of a table since they were last replaced by others; None where there is no table."""
    if not exists(spark, f"{path}/current.json"):
        return None
    found = read_json(spark, f"{path}/current.json")
    return found.get("generation", found["version"])


def replace_table(df: DataFrame, path: str, same: str | None = None) -> None:
    """Replace a table in one step: a new version folder, then the pointer ``current.json``.

    ``same`` keeps the name of a generation: the rows are those of it, less some that were deleted.

    ``df`` may read the old version. Until the pointer is renamed the old version is the table, also
    after a crash; what a crashed run left goes with the next replacement. The version before stays for
    those who still read it.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    before = read_json(spark, f"{path}/current.json")["version"] if exists(spark, f"{path}/current.json") else None
    df.write.parquet(f"{path}/{version}")
    write_json(spark, f"{path}/current.json", {"version": version, "before": before, "generation": same or version})
    fs, at = hadoop(spark, path)
    for old in fs.listStatus(at):
        if old.isDirectory() and old.getPath().getName() not in (version, before):
            fs.delete(old.getPath(), True)


class BatchLog:
    """Rows that come in batches, each once, and a base that takes old batches in.

    Below the root folder there are

    - ``rows/<name>``: Parquet with the rows of one batch;
    - ``commits/<batch>.json``: names the rows of a batch. It comes by a rename that fails where the
      file is there, so of two writers of one batch id one commits, and a batch that is sent again
      after any failure changes nothing;
    - ``bases/<number>.json``: names a base. The base with the highest number counts; it too comes by
      such a rename, so of two compactions one counts;
    - ``base-<name>/rows``, ``base-<name>/batches``: Parquet with the merged rows of all batches that
      the base has taken in, and with the ids of these batches.

    A commit writes its own rows only, however large the table is.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema

    def _names(self, folder: str) -> list[str]:
        fs, at = hadoop(self.spark, f"{self.root}/{folder}")
        found = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(x.removesuffix(".json") for x in found if x.endswith(".json"))

    def _base(self) -> tuple[int, dict]:
        """(number, description) of the base that counts; (0, {}) before the first compaction."""
        numbers = self._names("bases")
        return (int(numbers[-1]), read_json(self.spark, f"{self.root}/bases/{numbers[-1]}.json")) if numbers else (0, {})

    def _since(self, names: list[str], base: dict) -> list[str]:
        """Of committed batches those that the base hasn't taken in: few, if compactions keep up."""
        if not base or not names:
            return names
        taken = self.spark.read.parquet(f"{self.root}/base-{base['name']}/batches").where(F.col("batch").isin(names)).collect()
        return sorted({*names} - {r.batch for r in taken})

    def _state(self) -> tuple[int, dict, dict[str, str]]:
        """(number of the base, its description, rows' names by batch since), as they stood together at one time.

        Commits are listed before the base is read: what has gone from the list is in that base, and what
        is in it is either taken by the base or still there. Where compactions remove a file meanwhile it starts
        again, and each time another base counts.
        """
        while True:
            names = self._names("commits")
            number, base = self._base()
            try:
                return number, base, {x: read_json(self.spark, f"{self.root}/commits/{x}.json")["rows"] for x in self._since(names, base)}
            except Exception:
                if self._base()[0] == number:
                    raise

    def has(self, batch: str) -> bool:
        """Whether a batch with this id is committed."""
        if batch in self._names("commits"):
            return True
        _, base = self._base()
        return bool(base) and bool(self.spark.read.parquet(f"{self.root}/base-{base['name']}/batches").where(F.col("batch") == batch).head(1))

    def commit(self, rows: Callable[[], DataFrame] | DataFrame, batch: str) -> bool:
        """Commit a batch; False if one with this id was committed before or meanwhile (then nothing is kept)."""
        if not re.fullmatch(r"[\w.-]+", batch) or batch.startswith(("_", ".")):
            raise ValueError(f"{batch!r} can't name a batch")
        if self.has(batch):
            return False
        name = uuid.uuid4().hex
        (rows if isinstance(rows, DataFrame) else rows()).write.parquet(f"{self.root}/rows/{name}")
        if self.has(batch) or not place_new(self.spark, f"{self.root}/commits/{batch}.json", {"rows": name}):
            remove(self.spark, f"{self.root}/rows/{name}")  # another writer was first
            return False
        return True

    def _read(self, base: dict, since: dict[str, str]) -> DataFrame:
        found = [f"{self.root}/base-{base['name']}/rows"] if base else []
        found += [f"{self.root}/rows/{x}" for x in since.values()]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The rows of the base and of the batches since, unmerged; none where nothing was committed.

        The result reads files that the second compaction after it removes: it then fails, it never lacks rows.
        """
        while True:
            number, base, since = self._state()
            try:
                return self._read(base, since)
            except Exception:  # its files went while it was planned
                if self._base()[0] == number:
                    raise

    def pending(self) -> int:
        """How many committed batches the base hasn't taken in."""
        return len(self._state()[2])

    def batches(self) -> list[str]:
        """The ids of all committed batches, in their order."""
        number, base, since = self._state()
        taken = [r.batch for r in self.spark.read.parquet(f"{self.root}/base-{base['name']}/batches").collect()] if base else []
        return sorted({*taken, *since})

    def compact(self, merge: Callable[[DataFrame], DataFrame]) -> bool:
        """Take all committed batches into a new base; False if there are none or another compaction was first.

        What the base before this one had taken in goes: whoever reads by that base needs it no more.
        """
        number, base, since = self._state()
        if not since:
            return False
        name = uuid.uuid4().hex
        merge(self._read(base, since)).write.parquet(f"{self.root}/base-{name}/rows")
        ids = self.spark.createDataFrame([(x,) for x in since], "batch string")
        if base:
            ids = self.spark.read.parquet(f"{self.root}/base-{base['name']}/batches").union(ids)
        ids.write.parquet(f"{self.root}/base-{name}/batches")
        if not place_new(self.spark, f"{self.root}/bases/{number + 1:012d}.json", {"name": name, "before": base.get("name"), "since": sorted(since)}):
            remove(self.spark, f"{self.root}/base-{name}")
            return False
        if base.get("before"):
            remove(self.spark, f"{self.root}/base-{base['before']}")
        for x in base.get("since", []):
            at = f"{self.root}/commits/{x}.json"
            if exists(self.spark, at):
                remove(self.spark, f"{self.root}/rows/{read_json(self.spark, at)['rows']}")
                remove(self.spark, at)
        return True


class Deletions:
    """Rows taken out of a table that ``replace_table`` wrote, as a log of their keys beside it.

    A deletion writes one small batch, however large the table is, and deletions at the same time all
    count. Readers leave deleted keys out. A key counts for one generation of the table: contents that
    replace it are whole again. ``compact`` writes the table without the deleted rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        types = dict(c.split() for c in schema.split(", "))
        self.log = BatchLog(spark, f"{path}-deleted", ", ".join([*[f"{k} {types[k]}" for k in keys], "generation string"]))

    def delete(self, keys: DataFrame, batch: str | None = None) -> bool:
        """Take out the rows with these keys; False if this batch was there before."""
        now = generation(self.spark, self.path) or ""
        return self.log.commit(keys.select(*self.keys).distinct().withColumn("generation", F.lit(now)), batch or uuid.uuid4().hex)

    def _deleted(self) -> DataFrame:
        return self.log.read().where(F.col("generation") == (generation(self.spark, self.path) or "")).select(*self.keys)

    def read(self) -> DataFrame:
        """The rows that are left."""
        return read_table(self.spark, self.path, self.schema).join(self._deleted(), self.keys, "left_anti")

    def compact(self) -> None:
        """Write the table without its deleted rows; their keys go when a later compaction finds another generation."""
        now = generation(self.spark, self.path)
        if now is not None:
            replace_table(self.read(), self.path, now)
            self.log.compact(lambda rows: rows.where(F.col("generation") == now).distinct())
