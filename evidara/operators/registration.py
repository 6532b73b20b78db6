"""Registering files by their content: what is rejected, what is new, and what a duplicate adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.functions import scalar as S

c = F.col


def arrived(files: DataFrame) -> DataFrame:
    """``files`` (ord, filename, body, urls) with digest and reason: file_missing, zero_bytes, no_url, or null for those that are taken.

    A null body is a missing file. Addresses count as ``url_candidate`` cleans them.
    """
    good = F.filter(F.transform("urls", S.url_candidate), lambda u: u.isNotNull())
    reason = F.when(c("body").isNull(), "file_missing").when(F.octet_length("body") == 0, "zero_bytes").when(F.coalesce(F.size(good), F.lit(0)) <= 0, "no_url")
    return files.withColumns({"digest": F.when(c("body").isNotNull(), S.sha256_text(c("body"))), "reason": reason})


def statuses(files: DataFrame, registry: DataFrame) -> DataFrame:
    """(ord, status, reason): rejected, duplicate of the registry or of a file before it, or ingested."""
    a = arrived(files).select("ord", "digest", "reason")
    first = a.filter("reason IS NULL").groupBy("digest").agg(F.min("ord").alias("first")).join(registry.select("digest", F.lit(True).alias("known")), "digest", "left")
    both = a.join(first, "digest", "left")
    status = F.when(c("reason").isNotNull(), "rejected").when(c("known").isNotNull() | (c("ord") > c("first")), "duplicate").otherwise("ingested")
    return both.select("ord", status.alias("status"), "reason")


def merged_urls(files: DataFrame, registry: DataFrame) -> DataFrame:
    """(digest, url, ord, place) of each resource's addresses: the first occurrence of each, the registry's (ord -1) before those of files in their order.

    Rows and not lists, so a content that comes from very many addresses is no large group: the list's order is (ord, place).
    """
    taken = arrived(files).filter("reason IS NULL").select("digest", "ord", "urls")
    # No resource is registered by addresses alone, so the registry's count only if it has the digest.
    every = taken.unionByName(registry.select("digest", F.lit(-1).cast("long").alias("ord"), "urls"))
    spread = every.select("digest", "ord", F.posexplode(S.merged_urls(c("urls"))).alias("place", "url"))
    return spread.groupBy("digest", "url").agg(F.min(F.struct("ord", "place")).alias("m")).select("digest", "url", "m.ord", "m.place")


def resources(files: DataFrame, registry: DataFrame) -> DataFrame:
    """(digest, id, is_new, arrivals, download_url, n_urls, original_filename, display_title) of all resources after the files.

    ``registry``: (digest, id, urls, original_filename, display_title). A resource's id and file name are those of the registry or of
    its first file; a title is kept, and made from the name and the primary address where there is none.
    """
    taken = arrived(files).filter("reason IS NULL")
    firsts = taken.groupBy("digest").agg(F.min(F.struct("ord", "filename")).alias("f"), F.count(F.lit(1)).alias("arrivals"))
    known = registry.select("digest", "id", c("original_filename").alias("name"), "display_title", F.lit(True).alias("known"))
    both = firsts.join(known, "digest", "full")
    urls = merged_urls(files, registry).groupBy("digest").agg(F.min(F.struct("ord", "place", "url")).alias("p"), F.count(F.lit(1)).alias("n_urls"))
    named = both.join(urls, "digest", "left").withColumns({"id": F.coalesce("id", "f.ord"), "original_filename": F.coalesce("name", "f.filename"), "download_url": c("p.url")})
    title = F.coalesce("display_title", S.human_title(c("original_filename"), c("download_url"), F.lit(None).cast("string"), c("id").cast("string")))
    return named.select(
        "digest", "id", c("known").isNull().alias("is_new"), F.coalesce("arrivals", F.lit(0)).alias("arrivals"), "download_url", F.coalesce("n_urls", F.lit(0)).alias("n_urls"), "original_filename", title.alias("display_title")
    )
