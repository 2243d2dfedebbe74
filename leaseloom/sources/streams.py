"""Digests of whole files, read as streams by the tasks."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def file_sha256(spark: SparkSession, path: Column) -> Column:
    """SHA-256 of the file at `path`, as hex. The file is opened where the row is, by what Spark itself reads files with, and goes through
    the digest some KB at a time: it may be of any size, and is never held in memory nor asked for where the column is not."""
    jvm = spark.sparkContext._jvm
    catalyst = jvm.org.apache.spark.sql.catalyst.expressions
    kind = lambda name: jvm.java.lang.Class.forName(name)
    thing = lambda name: jvm.org.apache.spark.sql.types.ObjectType(kind(name))
    text = jvm.org.apache.spark.sql.types.DataType.fromDDL("string")

    def seq(*given):
        return jvm.org.apache.spark.api.python.PythonUtils.toSeq(list(given))

    # none of these gives a null, nor is given one: a file listed has a path
    def new(name: str, *given):
        return catalyst.objects.NewInstance(kind(name), seq(*given), seq(), False, thing(name), jvm.scala.Option.empty())

    def call(target, method: str, gives, *given):
        return catalyst.objects.Invoke(target, method, gives, seq(*given), seq(), False, False, True)

    def call_static(name: str, method: str, gives, *given):
        return catalyst.objects.StaticInvoke(kind(name), gives, method, seq(*given), seq(), False, False, True, jvm.scala.Option.empty())

    # what the session says of stores travels with the task
    settings = "org.apache.spark.util.SerializableConfiguration"
    told = jvm.org.apache.spark.util.SerializableConfiguration(spark._jsparkSession.sessionState().newHadoopConf())
    conf = call(catalyst.Literal(told, thing(settings)), "value", thing("org.apache.hadoop.conf.Configuration"))
    where = jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(path._jc)
    at = new("org.apache.hadoop.fs.Path", call(where, "toString", thing("java.lang.String")))
    files = call(at, "getFileSystem", thing("org.apache.hadoop.fs.FileSystem"), conf)
    # closed by itself at its end
    stream = new("org.apache.commons.io.input.AutoCloseInputStream", call(files, "open", thing("org.apache.hadoop.fs.FSDataInputStream"), at))
    digest = call_static("org.apache.commons.codec.digest.DigestUtils", "sha256Hex", thing("java.lang.String"), stream)
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(call_static("org.apache.spark.unsafe.types.UTF8String", "fromString", text, digest)))
