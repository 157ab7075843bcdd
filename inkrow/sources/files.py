"""Files as rows: checked contents, digests against a manifest, specimens by name, and generated sets with their index."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkrow.sources.tables import truth

#: Types that are read, by their first bytes in hexadecimal, and error codes.
MAGIC = {"image/jpeg": "^FFD8FF", "image/png": "^89504E470D0A1A0A", "image/webp": "^52494646.{8}57454250"}
SUFFIXES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp"}
EMPTY, LARGE, MEDIA = "EMPTY_BODY", "PAYLOAD_TOO_LARGE", "UNSUPPORTED_MEDIA_TYPE"


def name_of(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def plain(path: Column | str) -> Column:
    """A path with one slash after its scheme."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def bodies(spark: SparkSession, folder: str, most_bytes: int = 10 << 20) -> DataFrame:
    """path, length, media_type, content and error of every file below folder: a file that can't be taken has an error and no content, and fails nothing.

    Empty files and those over most_bytes are told by their listing, their contents aren't read. The type is that of the first bytes; a file of no known type, or whose suffix names
    another one, isn't supported. Suffixes that name none (or octets) are as good as the contents.
    """
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    nothing = F.lit(None)
    # Spark's file index, which the driver holds anyway, knows empty files too, but no task reads them
    listed = spark.createDataFrame([(p,) for p in own.inputFiles()], "uri string").select(plain(F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))).alias("path"))
    empty = listed.join(own.select(plain("path").alias("path")), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"))
    sized = own.where(F.col("length") > most_bytes).select("path", "length").unionByName(empty)
    sized = sized.select("path", "length", nothing.cast("string").alias("media_type"), nothing.cast("binary").alias("content"), F.when(F.col("length") == 0, EMPTY).otherwise(LARGE).alias("error"))
    taken = own.where(F.col("length") <= most_bytes).select("path", "length", "content")
    head = F.hex(F.substring("content", 1, 12))
    kind = F.coalesce(*[F.when(head.rlike(sign), media) for media, sign in MAGIC.items()])
    named = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])[F.lower(F.regexp_extract(name_of("path"), r"\.([^.]*)$", 1))]
    fits = kind.isNotNull() & F.coalesce(named == kind, F.lit(True))
    read = taken.select("path", "length", kind.alias("media_type"), F.when(fits, F.col("content")).alias("content"), F.when(~fits, MEDIA).alias("error"))
    return sized.unionByName(read)


def verified(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """file, sha256 (of the contents, null without a file), expected and state of every file below folder or in manifest (file: its path in folder, sha256): ok, altered, missing or extra.

    Contents are digested where they are read and don't travel. Names that the manifest repeats count for each of their rows.
    """
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    # paths come back with their scheme; whatever stands before the folder's own path goes
    inner = F.regexp_replace(plain("path"), "^" + _quoted(re.sub("^([a-z0-9]+):/+", r"\1:/", base)) + "/", "")
    held = own.select(inner.alias("file"), F.sha2("content", 256).alias("sha256"))
    both = held.join(manifest.select("file", F.lower("sha256").alias("expected"), F.lit(True).alias("listed")), "file", "full")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("listed").isNull(), "extra").when(F.col("sha256").eqNullSafe(F.col("expected")), "ok").otherwise("altered")
    return both.select("file", "sha256", "expected", state.alias("state"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/:_" else f"\\{c}" for c in text)


def specimens(spark: SparkSession, folder: str, fields: str) -> DataFrame:
    """image (path), condition (specimen), document_type and fields (a struct of the given columns) of every truth file (name.gt.json) in folder that has an image: a file named name, a dot and more that isn't JSON, the first by name.

    Names meet by the parts of an image's name before each of its dots, so that no pair is compared that doesn't share one.
    """
    listed = spark.read.format("binaryFile").load(folder).select("path")
    images = listed.where(~F.lower("path").endswith(".json")).withColumn("parts", F.split(name_of("path"), r"\."))
    lengths = F.sequence(F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1)))
    stems = F.transform(F.when(F.size("parts") > 1, lengths).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "."))
    keyed = images.select("path", F.explode(stems).alias("stem"))
    truth = spark.read.schema(f"document_type string, fields struct<{fields}>").option("multiLine", "true").option("pathGlobFilter", "*.gt.json").json(folder)
    truth = truth.select("document_type", "fields", F.regexp_replace(F.url_decode(name_of(F.input_file_name())), r"\.gt\.json$", "").alias("stem"))
    first = keyed.groupBy("stem").agg(F.min("path").alias("image"))
    return truth.join(first, "stem").select("image", F.lit("specimen").alias("condition"), "document_type", "fields")


def write_set(papers: DataFrame, lines: DataFrame, path: str, batch: int = 0) -> None:
    """A batch of a generated set: papers (id, condition, document_type, truth: map of fields) as truth documents, one each, their lines (id, and whatever they have), and an index of both that tables.truth reads.

    The index is written last and only names what is there, so that a batch is seen whole or not at all; a batch that is written again replaces itself.
    """
    name = F.concat("condition", F.lit("/"), F.col("document_type"), F.lit("_"), F.col("id").cast("string"))
    part = f"batch={batch}"
    truth = papers.select(F.concat(name, F.lit(".gt.json")).alias("name"), "document_type", "condition", F.col("truth").alias("fields"))
    truth.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/truth/{part}")
    lines.write.mode("overwrite").json(f"{path}/lines/{part}")
    index = papers.select(F.col("id").cast("string").alias("image"), F.concat(name, F.lit(".gt.json")).alias("gt"), "condition", "document_type")
    index.write.mode("overwrite").json(f"{path}/index/{part}")


def read_set(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """image, condition, document_type and fields of the batches of a generated set that have an index."""
    return truth(spark, f"{path}/index", f"{path}/truth", fields, named=True)


def write_report(rows: DataFrame, report: DataFrame, path: str) -> None:
    """Rows as JSON lines and report (position, line) as one text, in order of position. A report has a few lines for each kind of document, condition and field, so that one task writes it."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/results")
    ordered = report.select("line", F.row_number().over(Window.orderBy("position")).alias("k"))
    ordered.coalesce(1).sortWithinPartitions("k").select("line").write.mode("overwrite").text(f"{path}/report")

