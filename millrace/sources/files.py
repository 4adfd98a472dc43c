"""Reading and writing the file formats of the data sets, with their rules for missing and malformed input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.parsing import decode_upload_udf

PAIR = "user string, reply string, mode string, tags array<string>"
SUFFIXES = (".txt", ".md", ".markdown")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_array(spark: SparkSession, path: str, schema: str | StructType = PAIR) -> DataFrame:
    """A JSON array file; a missing file is empty, and so is one that isn't an array of objects or is corrupt."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def load_array(spark: SparkSession, path: str, schema: str | StructType = PAIR) -> DataFrame:
    """read_array; a file that isn't JSON at all is first renamed to `.bak`, so that no later write takes its place."""
    if exists(spark, path):
        text = spark.read.text(path, wholetext=True)
        broken = text.filter(F.trim("value") != "").filter(F.try_parse_json("value").isNull()).limit(1).count()
        if broken:
            old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".bak"))
            old.getFileSystem(spark._jsc.hadoopConfiguration()).rename(old, new)
    return read_array(spark, path, schema)


def write_array(df: DataFrame, path: str, order: str) -> None:
    """One JSON array file of a small data set, in order, published by a rename: what was there stays whole until the
    new file is. Larger data sets are written as lines."""
    spark = df.sparkSession
    line = F.to_json(F.struct(*[c for c in df.columns if c != order]), {"ignoreNullFields": "false"})
    one = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x")))).alias("x")).select(F.concat(F.lit("[\n  "), F.array_join(F.transform("x", lambda x: x["x"]), ",\n  "), F.lit("\n]")).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path + ".tmp")
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder, target = hadoop.Path(path + ".tmp"), hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-"))
    fs.delete(target, True)
    fs.rename(part, target)
    fs.delete(folder, True)


def held_out(spark: SparkSession, path: str, n: int) -> DataFrame:
    """user, gold of the first n ChatML texts of a JSON lines file, in the file's order; texts without both are none."""
    from ..functions.text import chatml_turn

    rows = spark.read.schema("text string").option("mode", "DROPMALFORMED").json(path).withColumn("_at", F.monotonically_increasing_id())
    turns = rows.select("_at", F.trim(chatml_turn(F.col("text"), "user")).alias("user"), F.trim(chatml_turn(F.col("text"), "assistant")).alias("gold"))
    return turns.filter("user <> '' and gold <> ''").orderBy("_at").limit(n).drop("_at")


def read_lines(spark: SparkSession, path: str, schema: str | StructType, strict: bool = False) -> DataFrame:
    """JSON lines. Strict reading fails at the first malformed line; else such lines and blank ones are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, nulls included. Spark's commit publishes all of a write or nothing."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def count_rows(spark: SparkSession, path: str, schema: str | StructType = PAIR) -> int:
    return read_array(spark, path, schema).count()


def read_prompt(spark: SparkSession, path: str, default: str) -> str:
    """A small text file, trimmed; a default if it is missing or blank."""
    rows = spark.read.text(path, wholetext=True).limit(1).collect() if exists(spark, path) else []
    return (rows[0][0].strip() if rows else "") or default


def pools(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """mode, message of several data sets; missing files are skipped, blank messages dropped."""
    found = [read_array(spark, p).select(F.lit(mode).alias("mode"), F.trim("user").alias("message")) for mode, p in paths.items() if exists(spark, p)]
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], "mode string, message string")).filter("message <> ''")


def uploads(spark: SparkSession, path: str, most: int = 5 << 20) -> DataFrame:
    """path, text, accepted, why of text uploads: by suffix and size; utf-8, else utf-16, else latin-1. Spark lists no empty
    files, so those never appear."""
    files = spark.read.format("binaryFile").load(path)
    good = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$")
    why = F.when(~good, "type").when(F.col("length") > most, "size")
    text = F.when(why.isNull(), decode_upload_udf("content"))
    return files.select("path", text.alias("text"), why.isNull().alias("accepted"), why.alias("why"))


def upload_memories(found: DataFrame) -> DataFrame:
    """A memory row for each accepted upload with text: the file's name is its title."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    kept = found.filter(F.col("accepted") & (F.trim("text") != ""))
    return kept.select(F.substring(name, 1, 255).alias("title"), F.trim("text").alias("content"), F.lit("upload").alias("source"), F.lit(5).alias("importance"), F.array().cast("array<string>").alias("tags"))


def to_report(df: DataFrame, *columns: str) -> Column:
    """The columns as one JSON text."""
    return F.to_json(F.struct(*columns))


def markdown(df: DataFrame, configs: list[str], key: str, columns: list[str]) -> str:
    """A result table; configurations without a row are pending. For tables of a few rows, it is built on the driver."""
    rows = {r[key]: r for r in df.select(key, *columns).limit(len(configs) + 1000).collect()}
    line = lambda cells: "| " + " | ".join(cells) + " |"
    body = [line([c, *(("_pending_" if c not in rows else "" if rows[c][x] is None else f"{rows[c][x]:.2f}" if isinstance(rows[c][x], float) else str(rows[c][x])) for x in columns)]) for c in configs]
    return "\n".join([line([key, *columns]), line(["---"] * (len(columns) + 1)), *body])


def template_rows(spark: SparkSession, templates: dict[str, list[str]], fillers: list[str], per_label: int, seed: int = 42) -> DataFrame:
    """query, label: up to per_label distinct texts of each label, a template with a filler, chosen by hash."""
    every = spark.createDataFrame([(k, t) for k, ts in templates.items() for t in ts], "label string, template string")
    words = spark.createDataFrame([(w,) for w in fillers], "filler string")
    made = every.join(F.broadcast(words)).select("label", F.replace("template", F.lit("{}"), F.col("filler")).alias("query")).distinct()
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("query", F.lit(seed)), "query"))
    return made.withColumn("_r", rank).filter(F.col("_r") <= per_label).select("query", "label")


def ranking_rows(spark: SparkSession, queries: int = 500, per_query: int = 10, seed: int = 42) -> DataFrame:
    """Synthetic ranking data: query_id, id, eight features, score, grade with noise; the same for a seed."""
    from ..functions import features as X

    ids = spark.range(queries * per_query).select(F.floor(F.col("id") / per_query).alias("query_id"), "id")
    u = lambda i: F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(1 << 30)) / float(1 << 30)
    cols = [F.sqrt(u(0)), F.floor(u(1) * 10) + 1.0, F.floor(u(2) * 4) + 0.0, F.pow(u(3), 2.0) * 365.0, F.floor(-F.log(1.0 - u(4)) * 6.0), (u(5) < 0.3).cast("double"), F.floor(u(6) * 3) + 1.0, u(7)]
    rows = ids.select("query_id", "id", *[F.least(c, F.lit(50.0)).alias(n) if n == "access" else c.cast("double").alias(n) for c, n in zip(cols, X.FEATURES)])
    noise = (u(8) + u(9) + u(10) - 1.5) * 0.2  # near normal
    return rows.withColumn("score", X.blend()).withColumn("grade", X.grade(F.col("score"), F.col("days_old"), F.col("cosine"), noise))
