"""Cutting lineage: tables written into the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session without one gets a temporary folder;
    a cluster without one is an error, since a machine's own folder is not seen by the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="zonespark-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver ends."""
    root = f"{shared_folder(spark).rstrip('/')}/zonespark-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: the lineage ends at those files, which
    survive the loss of executors, and a later reader gets pruned columns and pushed filters."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def list_files(spark: SparkSession, folder: str, suffix: str = ".parquet") -> list[str]:
    """Names of the files right inside a folder; none if there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = (str(s.getPath().getName()) for s in files.listStatus(path) if s.isFile())
    return sorted(n for n in names if n.endswith(suffix) and not n.startswith(("_", ".")))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, from the driver into any storage that Spark knows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_bucketed(df: DataFrame, folder: str, buckets: int, key: str) -> dict[int, list[str]]:
    """Write ``df`` into files of one bucket of ``key`` each, as Spark's own bucketed tables have them; gives the
    names of each bucket's files. The catalog forgets the table at once, its files stay."""
    spark = df.sparkSession
    name = f"zonespark_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", folder).format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    found: dict[int, list[str]] = {}
    for file in list_files(spark, folder):
        found.setdefault(int(re.search(r"_(\d+)\.", file)[1]), []).append(file)
    return found


def _java_list(jvm, items: list):
    made = jvm.java.util.ArrayList()
    for item in items:
        made.add(item)
    return made


def read_bucketed(spark: SparkSession, paths: list[str], schema: str, buckets: int, key: str) -> DataFrame:
    """Files that ``write_bucketed`` made, of any folders and any of the buckets, as a table that is known to be
    bucketed: a join on ``key`` doesn't shuffle it. Where this Spark has no way to say so it is read as plain files."""
    kind = T.StructType.fromDDL(schema)
    if not paths:
        return spark.createDataFrame([], kind)
    try:
        jvm, session = spark._jvm, spark._jsparkSession
        seq = lambda items: jvm.scala.jdk.javaapi.CollectionConverters.asScala(_java_list(jvm, items)).toSeq()
        spec = jvm.org.apache.spark.sql.catalyst.catalog.BucketSpec(buckets, seq([key]), seq([key]))
        option = jvm.scala.Option.apply
        source = jvm.org.apache.spark.sql.execution.datasources.DataSource(session, "parquet", seq(paths), option(session.parseDataType(kind.json())), seq([]), option(spec), jvm.scala.Predef.Map().empty(), option(None))
        return DataFrame(session.baseRelationToDataFrame(source.resolveRelation(True, True)), spark)
    except (Py4JError, AttributeError, TypeError):
        return spark.read.schema(kind).parquet(*paths)
