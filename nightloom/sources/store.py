"""Files and folders of any store that Spark reads, by way of Spark's own file systems; for small metadata work on the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a path, in order; none where it does not exist."""
    where, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files right below a path, in order, without those that Spark keeps for itself."""
    where, fs = _at(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(where) if s.isFile()] if fs.exists(where) else []
    return sorted(n for n in found if n[0] not in "_.")


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def make_folder(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.mkdirs(where)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole: under another name first, then renamed over the old one."""
    where, fs = _at(spark, path)
    beside, _ = _at(spark, f"{path}.new")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, where, options)


def get_text(spark: SparkSession, path: str) -> str | None:
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return None
    with_bytes = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(with_bytes)).decode()
    finally:
        with_bytes.close()
