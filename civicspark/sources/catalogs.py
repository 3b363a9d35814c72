"""Catalog and log scans (survey S1-S4).

Explicit schemas, no inference pass; a malformed catalog fails loudly
instead of silently becoming an empty frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions.text import py_strip, strip_bom

# Column layouts of the reference's catalog files.
CATALOG_SCHEMA = ("id BIGINT, prefeitura STRING, municipio STRING, url STRING, "
                  "empresa STRING, unidadegestora INT")
TOPIC_SCHEMA = "id INT, assunto STRING, parametros STRING"


def read_catalog_csv(spark: SparkSession, path: str, schema: str = CATALOG_SCHEMA) -> DataFrame:
    """Header CSV with a declared schema; a blank field is NULL."""
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
            .option("encoding", "UTF-8").csv(path))


def read_topics_csv(spark: SparkSession, path: str, schema: str = TOPIC_SCHEMA) -> DataFrame:
    """Topic catalog; a missing URL template becomes ``''``."""
    return read_catalog_csv(spark, path, schema).fillna("", ["parametros"])


def read_line_list(spark: SparkSession, path: str) -> DataFrame:
    """S3: one entry per line, byte-order mark removed, blanks stripped,
    empty lines dropped."""
    lines = spark.read.text(path)
    return lines.select(py_strip(strip_bom(F.col("value"))).alias("value")).filter(F.col("value") != "")


def parse_error_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """S4 on text rows: ``ts|url|type|message`` (or the three-part
    ``ts|url|Erro: type - message``); lines with fewer than two parts are
    skipped; the URL is part two."""
    parts = F.split(py_strip(F.col(value)), r"\|")
    n = F.size(parts)
    third = F.get(parts, 2)
    tagged = F.regexp_extract(third, r"^Erro: (\S+) - ", 1)
    error_type = F.when(n >= 4, third).when((n == 3) & (tagged != ""), tagged)
    message = (F.when(n >= 4, F.array_join(F.slice(parts, 4, F.greatest(n - 3, F.lit(1))), "|"))
               .when((n == 3) & (tagged != ""), F.regexp_extract(third, r"^Erro: \S+ - (.*)$", 1))
               .when(n == 3, third))
    return (lines.withColumn("__parts", parts).filter(n >= 2)
            .select(F.get(parts, 0).alias("logged_at"), F.get(parts, 1).alias("url"),
                    error_type.alias("error_type"), message.alias("message")))


def read_error_log(spark: SparkSession, path: str) -> DataFrame:
    """Scan an error log."""
    return parse_error_lines(spark.read.text(path))
