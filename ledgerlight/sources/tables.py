"""Reading the tables of a directory."""

import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of `folder`, a file or a directory of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of its files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    many = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    return reader.parquet(f"{folder}/{name}.parquet") if many else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def state(spark: SparkSession, folder: str, *names: str) -> str:
    """A text that changes when the files of these tables do: their paths, lengths and times."""
    jvm = spark.sparkContext._jvm
    found = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def local(spark: SparkSession) -> bool:
    """Whether Spark runs in this process alone, so that its own disk is one that all executors share."""
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def scratch(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    A cluster names it in `spark.checkpoint.dir`; only where that is unset and Spark runs in this process alone, as in
    tests, a local folder is taken. Without it, a cluster's executors would each write to their own disk: an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="ledgerlight-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")
