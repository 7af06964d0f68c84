"""Readers of an archive's side files: address book, entity book, lexicons, labels,
annotations, authority triples, typed names and address lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str) -> DataFrame:
    """Blocks between `--` lines, as arrays of their lines."""
    return spark.read.option("lineSep", "--").text(path).select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("lines")).where(F.size("lines") > 0)


def read_address_book(spark: SparkSession, path: str) -> DataFrame:
    """Contacts: first name is the best one, entries with @ are addresses."""
    lines = F.transform("lines", lambda x: F.trim(x))
    r = records(spark, path).select(lines.alias("l"))
    emails, names = F.filter("l", lambda x: F.instr(x, "@") > 0), F.filter("l", lambda x: F.instr(x, "@") == 0)
    return r.select(F.coalesce(F.get(names, F.lit(0)), F.get(emails, F.lit(0))).alias("best_name"), names.alias("names"), F.transform(emails, F.lower).alias("emails"))


def read_entity_book(spark: SparkSession, path: str) -> DataFrame:
    """Entities: the first line is the display name, the others are further names."""
    return records(spark, path).select(F.trim(F.col("lines")[0]).alias("display"), F.transform("lines", lambda x: F.trim(x)).alias("names"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """`caption: query` lines, # comments; queries of an equal caption are joined with |."""
    t = spark.read.text(path).where("trim(value) != '' and not startswith(trim(value), '#') and instr(value, ':') > 0")
    at = F.instr("value", ":")
    rows = t.select(F.trim(F.substr("value", F.lit(1), at - 1)).alias("caption"), F.trim(F.substr("value", at + 1)).alias("q"), F.monotonically_increasing_id().alias("i"))
    return rows.groupBy("caption").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]), "|").alias("query"))


def read_labels(spark: SparkSession, definitions: str, assigned: str) -> tuple[DataFrame, DataFrame]:
    """(label definitions from JSON lines, doc_id / label_id rows from CSV)."""
    return spark.read.json(definitions), spark.read.csv(assigned, header=True).select("doc_id", "label_id")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"').select("doc_id", "text")


def read_triples(spark: SparkSession, path: str, predicates: list[str]) -> DataFrame:
    """N-Triples: a row per subject, a column of values per predicate tail."""
    p = r'^<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"[^ ]*)\s*\.\s*$'
    t = spark.read.text(path)
    rows = t.select(F.regexp_extract("value", p, 1).alias("subject"), F.regexp_extract(F.regexp_extract("value", p, 2), r"([^/#]*)$", 1).alias("pred"), F.concat(F.regexp_extract("value", p, 3), F.regexp_extract("value", p, 4)).alias("object")).where("subject != ''")
    return rows.groupBy("subject").pivot("pred", predicates).agg(F.array_sort(F.collect_set("object")))


def read_typed_names(spark: SparkSession, path: str, share: float = 1.0, seed: int = 1) -> DataFrame:
    """`name type` lines, optionally a sample of them."""
    t = spark.read.text(path).select(F.split(F.trim("value"), r"\s+(?=\S+$)").alias("p")).where(F.size("p") == 2).select(F.replace(F.col("p")[0], F.lit("_"), F.lit(" ")).alias("name"), F.col("p")[1].alias("type"))
    return t.sample(share, seed) if share < 1 else t


def select_by_address_list(messages: DataFrame, addresses: DataFrame) -> DataFrame:
    """Messages from or to an address of a list (column email)."""
    wanted = addresses.select(F.lower(F.trim("email")).alias("email")).distinct()
    hit = messages.select("doc_id", F.explode(F.transform(F.concat("from", "to", "cc", "bcc"), lambda a: F.lower(a["email"]))).alias("email")).join(wanted, "email", "left_semi").select("doc_id")
    return messages.join(hit, "doc_id", "left_semi")


def read_archive(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a saved archive."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
