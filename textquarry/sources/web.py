"""Web search responses and crawled pages as result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textquarry.schemas import WEB_RESPONSE


def web_results(responses: DataFrame, body: str = "body") -> DataFrame:
    """JSON responses to one row per result: title, url, description; unknown fields are ignored."""
    keep = [c for c in responses.columns if c != body]
    parsed = responses.withColumn("parsed", F.from_json(body, WEB_RESPONSE))
    return parsed.select(*keep, F.inline("parsed.web.results"))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def page_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles, head or tags, blanks joined."""
    body = F.regexp_replace(html, r"(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))


def page_response(url: Column, html: Column) -> Column:
    """A page as a one-result response body."""
    result = F.struct(page_title(html).alias("title"), url.alias("url"), page_text(html).alias("description"))
    return F.to_json(F.struct(F.struct(F.array(result).alias("results")).alias("web")))
