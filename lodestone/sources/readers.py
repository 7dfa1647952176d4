"""Readers and writers: object stores, JSON lines, Atom feeds, private addresses."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType


def raw_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content); files that vanish meanwhile are left out."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(path)


def text_objects(spark: SparkSession, path: str) -> DataFrame:
    """(key, payload) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("key"), F.col("value").alias("payload"))


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes df, replacing only the partitions that it has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


@pandas_udf(BooleanType())
def _forbidden(ip: pd.Series) -> pd.Series:
    import ipaddress

    def one(x: str | None) -> bool:
        try:
            a = ipaddress.ip_address(x or "")
        except ValueError:
            return True
        return a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_unspecified or a.is_reserved

    return ip.map(one)


def forbidden_address(ip: Column) -> Column:
    """Addresses that a fetch must refuse: private, loopback, link-local, multicast, unspecified, reserved, and what is no address."""
    return _forbidden(ip)


FEED = "array<struct<id:string,title:string,updated:string,link:array<struct<_href:string,_rel:string,_type:string>>>>"
#: Types of acquisition links, best first.
ACQUIRED = ("application/epub+zip", "application/pdf", "text/html", "text/plain")


def feed_entries(feeds: DataFrame, url_col: str = "url", xml_col: str = "xml") -> DataFrame:
    """(url, id, title, href, type) with the best acquisition link of each entry of Atom feeds, hrefs resolved against the feed's url."""
    link = "array<struct<_href:string,_rel:string,_type:string>>"
    parsed = feeds.select(F.col(url_col).alias("url"), F.from_xml(F.col(xml_col), f"entry array<struct<id:string,title:string,link:{link}>>, link {link}").alias("f"))
    rows = parsed.select("url", F.explode("f.entry").alias("e")).select("url", "e.id", "e.title", F.explode("e.link").alias("l"))
    rows = rows.where(F.contains("l._rel", F.lit("acquisition"))).select("url", "id", "title", F.col("l._href").alias("href"), F.col("l._type").alias("type"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ACQUIRED)), F.col("type")).cast("int"), F.lit(0))
    best = rows.groupBy("url", "id", "title").agg(F.min(F.struct(F.when(rank == 0, 99).otherwise(rank).alias("r"), "href", "type")).alias("b"))
    return best.select("url", "id", "title", resolved(F.col("url"), F.col("b.href")).alias("href"), "b.type")


def next_pages(feeds: DataFrame, url_col: str = "url", xml_col: str = "xml") -> DataFrame:
    """(url, next): the next page of each feed that names one."""
    link = "array<struct<_href:string,_rel:string,_type:string>>"
    rows = feeds.select(F.col(url_col).alias("url"), F.explode(F.from_xml(F.col(xml_col), f"link {link}")["link"]).alias("l")).where("l._rel = 'next'")
    return rows.select("url", resolved(F.col("url"), F.col("l._href")).alias("next"))


@pandas_udf(StringType())
def _resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else urljoin(b or "", h) for b, h in zip(base, href, strict=True)])


def resolved(base: Column, href: Column) -> Column:
    return _resolved(base, href)
