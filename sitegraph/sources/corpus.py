"""Fetching as a join: a corpus of canned pages stands for the network.

corpus: url, status, content_type, charset, body, redirect_to, etag, last_modified, x_robots_tag, error_kind, error_message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = (
    "url string, status int, content_type string, charset string, body string, redirect_to string, etag string, last_modified string, "
    "x_robots_tag string, error_kind string, error_message string"
)
MAX_REDIRECTS = 10
KEPT_HOPS = 50


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CORPUS)


def chain_depth(corpus: DataFrame, hops: int = MAX_REDIRECTS) -> int:
    """How many joins the longest chain of redirects needs: moves that end in another move make longer chains."""
    moves = corpus.where("redirect_to is not null").select(F.col("url").alias("__from"), F.col("redirect_to").alias("__next"))
    ends, deepest = moves.select(F.col("__next").alias("at")), 0
    while deepest < hops and not ends.isEmpty():
        deepest += 1
        ends = moves.join(ends.withColumnRenamed("at", "__from"), "__from", "left_semi").select(F.col("__next").alias("at"))
    return deepest


def kept_hops(redirects: str) -> Column:
    """Of very long chains the first hops are remembered."""
    return F.slice(redirects, 1, KEPT_HOPS)


def follow_redirects(requests: DataFrame, corpus: DataFrame, hops: int = MAX_REDIRECTS, url: str = "url", depth: int | None = None) -> DataFrame:
    """Adds final_url, redirects (the urls passed) and too_many: a chain of joins on redirect_to, as long as the longest chain.

    Only as many joins are planned as the longest chain has hops (``depth``, or a look at the moves); targets are urls as
    the corpus spells them.
    """
    moves = corpus.where("redirect_to is not null").select(F.col("url").alias("__from"), F.col("redirect_to").alias("__next"))
    rows = requests.withColumns({"final_url": F.col(url), "redirects": F.array().cast("array<string>")})
    deepest = chain_depth(corpus, hops) if depth is None else depth
    if not deepest:
        return rows.withColumn("too_many", F.lit(False))
    for _ in range(deepest):
        step = rows.join(moves, rows.final_url == moves["__from"], "left")
        rows = step.withColumns(
            {
                "redirects": F.when(F.col("__next").isNotNull(), F.concat("redirects", F.array("final_url"))).otherwise(F.col("redirects")),
                "final_url": F.coalesce("__next", "final_url"),
            }
        ).drop("__from", "__next")
    left = rows.join(moves.select(F.col("__from").alias("final_url"), F.lit(True).alias("too_many")), "final_url", "left")
    return left.withColumns({"too_many": F.coalesce("too_many", F.lit(False)), "redirects": kept_hops("redirects")})


def fetch(requests: DataFrame, corpus: DataFrame, conditional: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """Requests (with their redirects followed or not) and their responses: a url that isn't in the corpus is a 404 with the body ``not found``.

    conditional: (url, if_none_match, if_modified_since); a page whose validator still holds answers 304 without a body.
    """
    depth = chain_depth(corpus) if depth is None else depth
    at = "final_url" if depth else "url"  # without redirects they are the same, and later joins on url find the rows dealt out by it
    answers = corpus.select(F.col("url").alias(at), *[c for c in corpus.columns if c not in ("url", "redirect_to")], F.lit(True).alias("__known"))
    rows = requests if "too_many" in requests.columns else follow_redirects(requests, corpus, depth=depth)
    if conditional is not None:
        rows = rows.join(conditional, "url", "left")  # before there are bodies to move
    rows = rows.join(answers, at, "left")
    known = F.col("__known").isNotNull()
    rows = rows.withColumns(
        {
            "error_kind": F.when(F.col("too_many"), "too-many-redirects").otherwise(F.col("error_kind")),
            "status": F.when(F.col("too_many") | F.col("error_kind").isNotNull(), F.lit(None).cast("int")).when(~known, 404).otherwise(F.coalesce("status", F.lit(200))),
            "body": F.when(~known, "not found").otherwise(F.col("body")),
            "content_type": F.when(~known, "text/plain").otherwise(F.coalesce("content_type", F.lit("text/html"))),
        }
    )
    if conditional is not None:
        same = F.coalesce(F.col("if_none_match") == F.col("etag"), F.lit(False)) | F.coalesce(F.col("etag").isNull() & (F.col("if_modified_since") == F.col("last_modified")), F.lit(False))
        same = same & (F.col("status") == 200)
        rows = rows.withColumns({"not_modified": same, "status": F.when(same, 304).otherwise(F.col("status")), "body": F.when(same, F.lit(None).cast("string")).otherwise(F.col("body"))}).drop("if_none_match", "if_modified_since")
    else:
        rows = rows.withColumn("not_modified", F.lit(False))
    ok = F.col("error_kind").isNull() & (F.col("status").between(200, 299) | (F.col("status") == 304))
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("__known", "too_many")
