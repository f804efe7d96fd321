"""a table of tokens sorted by token, in which a prefix is a range that scans prune.

Tokens are runs of letters and digits of lower-cased texts. A search reads the files and row groups whose tokens may lie in the range of a prefix, and no text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_token_table(rows: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """token, id of each different token of each text, in order of tokens. A token that very many texts have is spread over files, as ids are part of the order."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^\\p{L}\\p{N}]+"))
    tokens = rows.select(F.explode(words).alias("token"), F.col(id_col).alias("id")).where("token <> ''")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens.repartitionByRange(n, "token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(path)


def prefixes(query: str) -> list[str]:
    """The different runs of two or more letters and digits of a query, in lower case."""
    return list(dict.fromkeys(r for r in re.findall(r"[^\W_]+", query.lower()) if len(r) >= 2))


def begins(token: Column, prefix: str) -> Column:
    """token starts with prefix, as a range: up to the prefix with its last character raised by one."""
    last = ord(prefix[-1])
    after = prefix[:-1] + chr(0xE000 if last == 0xD7FF else last + 1)
    return (token >= F.lit(prefix)) & (token < F.lit(after))


def search_tokens(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Ids of the texts in which every prefix of the query begins a token; all ids that have tokens if the query has no prefix."""
    tokens = spark.read.parquet(path)
    wanted = prefixes(query)
    if not wanted:
        return tokens.select("id").distinct()
    found = [tokens.where(begins(F.col("token"), p)).select("id", F.lit(i).alias("prefix")).distinct() for i, p in enumerate(wanted)]
    return reduce(DataFrame.union, found).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("id")
