"""Reading inputs and storing tables as Parquet.

A table is a folder of Parquet versions and one of markers, empty files named by time and version. The
last marker names the current version. A marker is made whole or not at all and none is ever written
over, so a reader sees the old table or the new one, never half of one, and a rewrite may read what it
replaces. The version before the current one stays for readers that began with it; older ones go.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markup
from . import schema


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if any(f.endswith(f"/{name}.parquet") for f in table.inputFiles()):  # the table is one file, a stream reads folders
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def document_pages(documents: DataFrame) -> DataFrame:
    """Pages made of documents: the first line is the title, the text the body."""
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.col("doc_id").cast("string"))
    title = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, markup.TITLE_CHARS)
    return documents.select(F.col("doc_id").alias("page_id"), url.alias("url"), markup.url_hash(url).alias("url_hash"), title.alias("title"), F.col("text").alias("body_text"))


def part_pages(part: DataFrame) -> DataFrame:
    """Pages of short titles: part names, with the type as the body."""
    url = F.concat(F.lit("https://parts.example/"), F.col("p_partkey").cast("string"))
    return part.select(F.col("p_partkey").alias("page_id"), url.alias("url"), markup.url_hash(url).alias("url_hash"), F.col("p_name").alias("title"), F.col("p_type").alias("body_text"))


def crawl_log(events: DataFrame) -> DataFrame:
    """A fetch log made of events: purchases succeed, errors fail, and so on."""
    status = F.when(F.col("event_type") == "purchase", 200).when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 403).otherwise(200 + F.col("user_id") % 3 * 100)
    return events.select(F.col("event_id").alias("id"), F.concat(F.lit("https://e.example/"), F.col("user_id").cast("string")).alias("url"), status.cast("int").alias("status"), F.col("ts").alias("crawled_at"))


def host_chain(pages: DataFrame) -> DataFrame:
    """Links from each page to the next of its host: edges (src, dst) of page ids."""
    host = F.expr("try_parse_url(url, 'HOST')")
    after = F.lead("page_id").over(Window.partitionBy("host").orderBy("page_id"))
    return pages.withColumn("host", host).select(F.col("page_id").alias("src"), after.alias("dst")).filter("dst IS NOT NULL")


class Store:
    """Tables under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, name: str) -> list[tuple[str, str]]:
        """Marker and version, the current one last."""
        fs, folder = self._file(f"{self.path}/{name}/current")
        if not fs.exists(folder):
            return []
        markers = sorted(f.getPath().getName() for f in fs.listStatus(folder))
        return [(m, m.split("-", 1)[1]) for m in markers]

    def _version(self, name: str) -> str | None:
        found = self._versions(name)
        return found[-1][1] if found else None

    def _file(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        return self._version(name) is not None

    def table(self, name: str) -> DataFrame:
        """The table, or an empty one of its schema."""
        version = self._version(name)
        if version is None:
            return self.spark.createDataFrame([], schema.TABLES[name])
        return self.spark.read.parquet(f"{self.path}/{name}/{version}")

    def overwrite(self, name: str, df: DataFrame) -> DataFrame:
        """Replaces a table. Rows come as they are partitioned and sorted, so sorted keys keep statistics tight."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}/{version}")
        before = self._versions(name)
        fs, marker = self._file(f"{self.path}/{name}/current/{time.time_ns():020d}-{version}")
        fs.create(marker, False).close()
        for old, gone in before[:-1]:
            for path in (f"{self.path}/{name}/{gone}", f"{self.path}/{name}/current/{old}"):
                fs.delete(self._file(path)[1], True)
        return self.table(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Adds rows to the current version."""
        version = self._version(name)
        if version is None:
            return self.overwrite(name, df)
        df.write.mode("append").parquet(f"{self.path}/{name}/{version}")
        return self.table(name)
