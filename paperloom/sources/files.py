"""File intake (I-01 ... I-05, I-07)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.regex import first_match


HEAD, HASH = "_head", "_hash"
HEAD_BYTES = 16


class _Calls:
    """Calls of JVM methods as expressions, for what no SQL function does: read a file as a stream in the task that lists it."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.sql = spark._jvm, spark._jvm.org.apache.spark.sql
        self.objects, self.columns = self.sql.catalyst.expressions.objects, self.sql.classic.ExpressionUtils

    def kind(self, name: str):
        return self.sql.types.ObjectType(self.jvm.java.lang.Class.forName(name))

    def many(self, *values):
        return self.jvm.PythonUtils.toSeq(list(values))

    def of(self, column: Column):
        return self.columns.expression(column._jc)

    def static(self, owner: str, method: str, result, *args):
        nothing = self.jvm.scala.Option.empty()
        return self.objects.StaticInvoke(self.jvm.java.lang.Class.forName(owner), result, method, self.many(*args), self.many(), True, True, True, nothing)

    def method(self, target, name: str, result, *args, again: bool = True):
        """``again``: whether one call may stand for two of the same."""
        return self.objects.Invoke(target, name, result, self.many(*args), self.many(), True, True, again)

    def new(self, owner: str, *args):
        return self.objects.NewInstance(self.jvm.java.lang.Class.forName(owner), self.many(*args), self.many(), False, self.kind(owner), self.jvm.scala.Option.empty())

    def parsed(self, ddl: str):
        return self.sql.types.DataType.fromDDL(ddl)


def _streamed(spark: SparkSession, path: Column) -> tuple[Column, Column]:
    """The first bytes of the file at ``path`` and the SHA-256 of all of it: read as a stream on whatever file system it lies.

    File systems get the cluster's settings and those named ``spark.hadoop.*``.
    """
    c, hadoop, io = _Calls(spark), "org.apache.hadoop.fs", "org.apache.commons.io"
    util, env = "org.apache.spark.deploy.SparkHadoopUtil", "org.apache.spark.SparkEnv"
    settings = c.method(c.static(env, "get", c.kind(env)), "conf", c.kind("org.apache.spark.SparkConf"))
    conf = c.method(c.static(util, "get", c.kind(util)), "newConfiguration", c.kind("org.apache.hadoop.conf.Configuration"), settings)
    name = c.new(f"{hadoop}.Path", c.method(c.of(path), "toString", c.kind("java.lang.String")))
    stream = c.method(c.method(name, "getFileSystem", c.kind(f"{hadoop}.FileSystem"), conf), "open", c.kind(f"{hadoop}.FSDataInputStream"), name, again=False)
    closing = lambda s: c.new(f"{io}.input.AutoCloseInputStream", s)  # noqa: E731  # closed at its end
    first = c.new(f"{io}.input.BoundedInputStream", stream, c.of(F.lit(HEAD_BYTES).cast("long")))
    head = c.static(f"{io}.IOUtils", "toByteArray", c.parsed("binary"), closing(first))
    buffered = c.new("java.io.BufferedInputStream", stream, c.of(F.lit(1 << 18)))
    digest = c.static("org.apache.commons.codec.digest.DigestUtils", "sha256Hex", c.kind("java.lang.String"), closing(buffered))
    text = c.static("org.apache.spark.unsafe.types.UTF8String", "fromString", c.parsed("string"), digest)
    return Column(c.columns.column(head)), Column(c.columns.column(text))


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """I-01: path, modificationTime, length, content; ``spark.sql.sources.binaryFile.maxLength`` caps a file's content.

    ``_head`` and ``_hash`` (first bytes, SHA-256) are read as streams and let stubs be made of files of any size: a column that
    nothing asks for is not read, and content is a whole file in memory.
    """
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    head, digest = _streamed(spark, F.col("path"))
    return reader.load(path).withColumns({HEAD: head, HASH: digest})


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def strip_uuid_prefix(filename: Column) -> Column:
    """I-02."""
    return F.regexp_replace(filename, rules.UUID_PREFIX, "")


def extension(filename: Column) -> Column:
    """Lower-case suffix with its dot; '' for none (a leading dot starts a hidden name, not a suffix)."""
    return F.lower(F.regexp_extract(base_name(filename), r"[^.].*?(\.[^.]*)$", 1))


def file_class(suffix: Column) -> Column:
    """I-03."""
    return first_match(
        [
            (suffix.isin(rules.SPREADSHEET_EXTENSIONS), F.lit("spreadsheet")),
            (suffix.isin(rules.IMAGE_EXTENSIONS), F.lit("image")),
            (suffix.isin(rules.EXTRACTABLE_EXTENSIONS), F.lit("extractable")),
        ],
        F.lit("other"),
    )


def text_expected(suffix: Column) -> Column:
    """Whether a file of this kind should yield text."""
    return suffix.isin(rules.EXTRACTABLE_EXTENSIONS)


def sniff_extension(content: Column) -> Column:
    """I-04: suffix by leading bytes, '' when unknown."""
    head = F.hex(F.substring(content, 1, 16))
    return first_match(
        [
            (F.substring(head, 2 * start - 1, len(magic)) == magic, F.lit(suffix))
            for start, magic, suffix in rules.MAGIC_BYTES
        ],
        F.lit(""),
    )


def resolved_extension(filename: Column, content: Column) -> Column:
    """I-04: the name's own suffix, or the sniffed one where it is missing or generic."""
    own = extension(filename)
    sniffed = sniff_extension(content)
    return F.when(own.isin("", ".bin", ".dat") & (sniffed != ""), sniffed).otherwise(own)


def content_hash(content: Column) -> Column:
    """I-05."""
    return F.sha2(content, 256)


def document_stubs(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """I-01: the row that exists before any enrichment; adds to the file's own columns. Files of ``read_files`` keep their streamed facts."""
    name = strip_uuid_prefix(base_name(F.col(path)))
    streamed = {HEAD, HASH} <= set(files.columns)
    suffix = resolved_extension(name, F.col(HEAD if streamed else content))
    return files.withColumns(
        {
            "filename": name,
            "extension": suffix,
            "file_class": file_class(suffix),
            "file_hash": F.col(HASH) if streamed else content_hash(F.col(content)),
            "doc_type": F.lit("other"),
            "review_state": F.lit("pending"),
            "confidence": F.lit(0.0),
            "tags": F.array().cast("array<string>"),
        }
    ).drop(HEAD, HASH)


def write_by_month(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """I-07: year/month folders; rows of a month are spread over tasks so that a busy month is no hot task."""
    dated = df.withColumns({"year": F.year(ts), "month": F.month(ts)})
    dated.write.mode("append").partitionBy("year", "month").parquet(path)
