"""Sources: tables in Parquet, recognised lines in JSON with an explicit schema, and word lists."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkrow.functions.text import SPACE

LINES = "image long, pass string, idx int, text string, score double, box array<struct<x:double,y:double>>, chars array<struct<text:string,score:double,box:array<struct<x:double,y:double>>>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def growing(df: DataFrame) -> DataFrame:
    """df for a join by key in which both sides grow with the input: it is merged, never broadcast. Spark takes a table's size from its compressed files, which tells little of its rows."""
    return df.hint("merge")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by its key over as many tasks as there are shuffle partitions, cores at least. Spark cuts files by bytes, so that rows of few bytes that stand for much work, such as keys that cards are made of, would all be one task's."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder that spark.checkpoint.dir names, and read again, so that its plan isn't worked out once for each use. A local session without one takes a folder of its own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        folder = f"file://{tempfile.mkdtemp(prefix='inkrow-')}"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


TRUTH_INDEX = "image string, gt string, condition string, document_type string"


def truth(spark: SparkSession, index: str, folder: str, fields: str, named: bool = False) -> DataFrame:
    """image, condition, document_type and fields (a struct of the given columns) of the rows of an index in JSON lines (image, gt, condition, document_type), each joined to its truth document.

    Documents are files by themselves, gt being their path in folder, or with named lines of any files, which carry gt as their name. Rows without a document stay with null fields.
    """
    rows = spark.read.schema(TRUTH_INDEX).json(index).alias("r")
    held = spark.read.schema(f"name string, document_type string, fields struct<{fields}>").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    if named:
        both = rows.join(held.json(folder).alias("t"), F.col("r.gt") == F.col("t.name"), "left")
    else:
        files = held.option("multiLine", "true").json(folder).withColumn("path", F.url_decode(F.input_file_name())).withColumn("file", F.regexp_extract("path", "([^/]*)$", 1))
        own = rows.withColumn("file", F.regexp_extract("gt", "([^/]*)$", 1)).alias("r")
        both = own.join(files.alias("t"), (F.col("r.file") == F.col("t.file")) & F.endswith(F.col("t.path"), F.concat(F.lit("/"), F.col("r.gt"))), "left")
    return both.select("r.image", "r.condition", F.coalesce("t.document_type", "r.document_type").alias("document_type"), "t.fields")


def lexicon(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(provinces, districts) as address.correct takes them, from JSON with sido (names) and sgg (names by province)."""
    own = spark.read.schema("sido array<string>, sgg map<string,array<string>>").option("multiLine", "true").json(path)
    provinces = own.select(F.explode("sido").alias("province")).distinct()
    districts = own.select(F.explode("sgg").alias("province", "names")).select("province", F.explode("names").alias("district")).distinct()
    return provinces, districts


def write_lexicon(districts: DataFrame, path: str) -> None:
    """The lexicon of districts (province, district) as one line of JSON, names in order; names of a city and its ward are taken apart. It's a country's administrative names, so one row holds it."""
    from inkrow.operators.address import split_district

    own = districts.select("province", F.explode(split_district(F.col("district"))).alias("district")).distinct()
    held = own.groupBy("province").agg(F.array_sort(F.collect_list("district")).alias("names"))
    out = held.agg(F.array_sort(F.collect_list("province")).alias("sido"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("province", "names")))).alias("sgg"))
    out.coalesce(1).write.mode("overwrite").json(path)


def write_results(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Rows as JSON lines, nulls kept, in folders by the named columns: results, checks, and sets of synthetic cards."""
    (rows.write.mode("overwrite").partitionBy(*by) if by else rows.write.mode("overwrite")).option("ignoreNullFields", "false").json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINES).json(path)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of two characters or more of a text file."""
    return spark.read.text(path).select(F.explode(F.split("value", f"[{SPACE}]+")).alias("word")).where(F.length("word") >= 2).distinct()


def listing(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png"), first: int = 1) -> DataFrame:
    """Paths below folder with one of the suffixes, the first few of each folder and stem before _0; contents aren't read."""
    from pyspark.sql import Window

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    found = found.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$") & ~F.col("path").contains(".seal"))
    found = found.withColumns({"folder": F.regexp_extract("path", "^(.*)/[^/]*$", 1), "stem": F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_0")[0]})
    return found.withColumn("k", F.row_number().over(Window.partitionBy("folder", "stem").orderBy("path"))).where(F.col("k") <= first).drop("k")
