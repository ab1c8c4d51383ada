"""Tables of the engine on disk: Parquet, and import and export of the text and JSON layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents in a corpus file.
SHARD_DOCUMENTS = 10_000


def source_of_file(path: Column) -> Column:
    """attack if the file's name holds that word, or its folder is that source's; else nvd."""
    p = F.split(path, "/")
    return F.when(F.element_at(p, -1).contains("attack") | (F.element_at(p, -2) == "source=attack"), "attack").otherwise("nvd")


def write_corpus(corpus: DataFrame, path: str, shard_documents: int = SHARD_DOCUMENTS) -> None:
    corpus.write.mode("overwrite").option("maxRecordsPerFile", shard_documents).partitionBy("source").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_corpus_text(tokens: DataFrame, path: str) -> None:
    """Lines of id and tokens, a folder a source."""
    tokens.select("source", F.concat_ws(" ", "doc_id", F.array_join("tokens", " ")).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", SHARD_DOCUMENTS).partitionBy("source").text(path)


def read_corpus_text(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, source (by file name), text of lines 'id token ...'; blank lines are skipped."""
    raw = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(path).withColumn("file", F.input_file_name()).where(F.trim("value") != "")
    p = F.split(F.trim("value"), r"\s+", 2)
    return raw.select(p[0].alias("doc_id"), source_of_file(F.col("file")).alias("source"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("text"))


def postings_lines(postings: DataFrame, codes: DataFrame) -> DataFrame:
    """value: '<code> <term> <df> (<doc>,<tf>,<source>) ...' in code order."""
    one = F.format_string("(%s,%d,%s)", "doc_id", "tf", "source")
    g = postings.groupBy("term").agg(F.count("*").alias("df"), F.array_sort(F.collect_list(one)).alias("l")).join(codes, "term")
    return g.orderBy("word_code").select(F.concat_ws(" ", F.col("word_code").cast("string"), "term", F.col("df").cast("string"), F.array_join("l", " ")).alias("value"))


def parse_postings(lines: DataFrame) -> DataFrame:
    """word_code, term, doc_id, tf, source from such lines; malformed lines and entries are skipped."""
    p = F.split("value", r"\s+", 4)
    x = lines.select(F.expr("try_cast(get(split(value, '\\\\s+', 4), 0) as int)").alias("word_code"), F.get(p, F.lit(1)).alias("term"), F.expr("try_cast(get(split(value, '\\\\s+', 4), 2) as int)").alias("df"), F.get(p, F.lit(3)).alias("rest"))
    x = x.where("word_code is not null and df is not null and rest is not null")
    x = x.select("word_code", "term", F.explode(F.regexp_extract_all("rest", F.lit(r"\(([^,()]+),(\d+),([^,()]+)\)"), F.lit(0))).alias("e"))
    e = r"\(([^,()]+),(\d+),([^,()]+)\)"
    return x.select("word_code", "term", F.regexp_extract("e", e, 1).alias("doc_id"), F.regexp_extract("e", e, 2).cast("int").alias("tf"), F.regexp_extract("e", e, 3).alias("source"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_json wrote: lengths, topics, or other rows of a schema; a line that does not fit is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_technique_map(pairs: DataFrame, path: str) -> None:
    """A JSON object of technique to its sorted advisories, a file for each technique: no task has more than some techniques' lists."""
    g = pairs.groupBy("tid").agg(F.array_sort(F.collect_set("cve_id")).alias("cves"))
    one = g.where("tid is not null").select(F.to_json(F.create_map("tid", "cves")).alias("value"))
    one.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_technique_map(spark: SparkSession, path: str) -> DataFrame:
    """tid, cve_id without repeats, from JSON objects of id to list, one a file."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("tid", "cves"))
    return raw.select(F.upper("tid").alias("tid"), F.explode("cves").alias("cve_id")).distinct()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
