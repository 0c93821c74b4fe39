"""Web pages: plain text with paragraph breaks, links, main content cut (S10, P4, P13), by one scan of a page's tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio_spark.functions.markup import links, page

#: Lines that end a text: press questions and answers, and what belongs to a page's frame.
STOPS = "^(?:记者|问[:：]|答[:：]|责任编辑|[\\[【]责任编辑|编辑[:：]|分享到|打印|关闭窗口|相关链接|相关新闻|扫一扫|主办单位|版权所有|©)|答记者问"


def plain_title(title: Column, suffix: str = r"\s*[-_|－—].*$") -> Column:
    """A page's title without its site's name; empty where there is none."""
    return F.regexp_replace(F.coalesce(title, F.lit("")), suffix, "")


def pages_to_text(pages: DataFrame) -> DataFrame:
    """page_id, title, text."""
    seen = pages.select("page_id", page(F.col("html")).alias("p"))
    return seen.select("page_id", plain_title(F.col("p.title")).alias("title"), F.col("p.text").alias("text"))


def explode_links(pages: DataFrame) -> DataFrame:
    """page_id, target (path or address), href (absolute), anchor, place; the first of a page's links to one target.

    A link ends with its end tag or where the next one starts. Addresses are resolved against the page's own.
    """
    rows = links(pages).select("page_id", "url", "p", F.trim("href").alias("h"), "anchor").where("h <> ''")
    base = F.regexp_replace("url", r"[?#].*$", "")
    root = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z]+://[^/]+(?:/.*)?)/[^/]*$", 1)
    folder = F.when(folder == "", root).otherwise(folder)
    absolute = (
        F.when(F.col("h").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("h")).when(F.col("h").startswith("//"), F.concat(F.regexp_extract("url", "^([a-zA-Z]+:)", 1), "h"))
        .when(F.col("h").startswith("/"), F.concat(root, "h")).when(F.col("h").startswith("?") | F.col("h").startswith("#"), F.concat(base, "h")).otherwise(F.concat(folder, F.lit("/"), F.regexp_replace("h", r"^(?:\./)+", "")))
    )
    rows = rows.withColumn("href", absolute).withColumn("target", F.regexp_replace("href", "#.*$", ""))
    first = rows.groupBy("page_id", "target").agg(F.min_by(F.struct("href", "anchor", "p"), "p").alias("x"))
    return first.select("page_id", "target", "x.href", "x.anchor", F.col("x.p").alias("place"))


def main_content(pages: DataFrame) -> DataFrame:
    """page_id, text: the content block's lines (or else the page's) up to the first that belongs to the page's frame."""
    seen = pages.select("page_id", page(F.col("html")).alias("p")).select("page_id", F.coalesce("p.block", "p.text").alias("text"))
    lines = F.split("text", "\n")
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(STOPS)), True)
    return seen.select("page_id", F.array_join(F.when(stop > 0, F.slice(lines, 1, stop.cast("int") - 1)).otherwise(lines), "\n").alias("text"))
