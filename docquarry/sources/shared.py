"""Tables kept in the folder that all machines share."""

from __future__ import annotations

import gc
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Where the kept tables of this process are, by application, input folder and name.
_KEPT: dict[tuple[str, str, str], str] = {}
#: Part of every kept table's identity: to be raised when what a table holds changes.
LAYOUT = 2


def _named(spark: SparkSession) -> str | None:
    """The shared folder that the cluster names, if it does."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder. Where none is configured, a temporary one in local mode; on a
    cluster that would lose data, so it is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = _named(spark)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docquarry-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder and read again, for a plan that needs it twice."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark removes the shuffle files of
    finished steps from the executors' disks. What the first collection lets go of holds
    others, which the second finds."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], inputs: tuple[str, ...] = ("documents",)) -> DataFrame:
    """The table ``name`` of an input folder: built once, then read.

    It is Parquet in the shared folder, so it survives lost executors and is pruned like any
    other source. Where the cluster names that folder, later applications find the table
    again as long as the files of its ``inputs`` are the same; else it is this application's.
    A table counts from when its marker is renamed into place: what a crash leaves isn't read.
    """
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _KEPT:
        named = _named(spark)
        _KEPT[key] = _lasting(spark, named, sf_dir, name, build, inputs) if named else _written(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", build)
    return spark.read.parquet(_KEPT[key])


def _written(path: str, build: Callable[[], DataFrame]) -> str:
    build().write.parquet(path)
    return path


def _lasting(spark: SparkSession, base: str, sf_dir: str, name: str, build: Callable[[], DataFrame], inputs: tuple[str, ...]) -> str:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    identity = hashlib.sha256(json.dumps([LAYOUT, name, *(_files(spark, f"{sf_dir}/{t}.parquet") for t in inputs)]).encode()).hexdigest()
    folder = f"{base.rstrip('/')}/kept/{name}-{identity}"
    marker = path(f"{folder}/marker")
    fs = marker.getFileSystem(conf)
    if not fs.exists(marker):
        made, draft = uuid.uuid4().hex, path(f"{folder}/draft-{uuid.uuid4().hex}")
        _written(f"{folder}/{made}", build)
        stream = fs.create(draft, False)
        stream.write(bytearray(made.encode()))
        stream.close()
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(marker.toUri(), conf).rename(draft, marker, options)
        except Exception as error:  # another application was first: its table is as good
            if "FileAlreadyExists" not in str(error):
                raise
            fs.delete(draft, False)
            fs.delete(path(f"{folder}/{made}"), True)
    stream = fs.open(marker)
    try:
        return f"{folder}/{jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
    finally:
        stream.close()


def _files(spark: SparkSession, location: str) -> list[list]:
    """Name, length and time of the files of a table, as its identity."""
    own = spark._jvm.org.apache.hadoop.fs.Path(location)
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(own) if fs.exists(own) else []
    return sorted([s.getPath().toString(), s.getLen(), s.getModificationTime()] for s in found)


def forget(sf_dir: str) -> None:
    """The tables kept of an input folder are looked for again when they are next asked for."""
    for key in [k for k in _KEPT if k[1] == sf_dir]:
        del _KEPT[key]
