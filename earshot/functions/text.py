r"""Text functions as column expressions; exact case folding needs Python.

``(?U)`` gives \d and \s their Unicode meaning. The order of the steps of
sanitize() is part of its meaning.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The patterns that cleaning and masking are defined by.
URL = r"""https?://[^\s<>"')\]]+"""
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_INTERNATIONAL = r"\+\d{1,3}[\s\-().]*\d{2,4}(?:[\s\-().]*\d{2,4}){1,4}"
PHONE_DIGITS = r"\d{3}[\s\-]\d{3}[\s\-]\d{4}"
PHONE_LOCAL = r"(?:\(\d{2,4}\)[\s\-]?)?" + PHONE_DIGITS
QUOTES = "\"'“”‘’"
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "gbraid", "wbraid", "fbclid", "msclkid", "mc_cid", "mc_eid", "igshid", "_hsenc", "_hsmi", "vero_id", "yclid")
MARKDOWN = r"([\\`*_{}\[\]()#+\-.!|~<>$])"


def _replaced(text: Column, where: Callable[[Column], Column], pattern: str, by: str) -> Column:
    """regexp_replace() of the texts that meet a cheap condition, without which the pattern changes nothing; `text` is worked out once."""
    return F.get(F.transform(F.array(text), lambda t: F.when(where(t), F.regexp_replace(t, pattern, by)).otherwise(t)), 0)


def _holds(*parts: str) -> Callable[[Column], Column]:
    return lambda t: reduce(Column.__or__, (F.contains(t, F.lit(p)) for p in parts))


def _at_an_end(pattern: str) -> Callable[[Column], Column]:
    return lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1)).rlike(pattern)


def mask_personal(text: Column) -> Column:
    text = _replaced(text, _holds("@"), EMAIL, "[EMAIL]")
    text = _replaced(text, _holds("+"), "(?U)" + PHONE_INTERNATIONAL, "[PHONE]")
    return _replaced(text, lambda t: t.rlike("(?U)" + PHONE_DIGITS), "(?U)" + PHONE_LOCAL, "[PHONE]")


def _strip(text: Column) -> Column:
    return _replaced(text, _at_an_end(r"(?U)\s"), r"(?U)^\s+|\s+$", "")


def tidy(text: Column) -> Column:
    """White space and surrounding quotes; line breaks stay."""
    text = _replaced(text, _holds("\t", "  "), r"[ \t]+", " ")
    text = _replaced(text, _holds(" \n", "\n "), r" ?\n ?", "\n")
    text = _replaced(text, _holds("\n\n\n"), r"\n{3,}", "\n\n")
    return _strip(_replaced(_strip(text), _at_an_end(f"[{QUOTES}]"), f"^[{QUOTES}]+|[{QUOTES}]+$", ""))


def sanitize(text: Column) -> Column:
    """Cleaning of a text whose URLs are already clean."""
    return tidy(mask_personal(text))


def _requoted(part: Column) -> Column:
    """A part of a query, decoded and quoted again: the same text, written in the one way."""
    plain = F.coalesce(F.try_url_decode(part), part)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def without_tracking(url: Column) -> Column:
    """The URL less its tracking parameters; one that has none, or a host in unbalanced brackets, stays as it is."""
    part = lambda n: F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", n)
    pairs = F.filter(F.split(part(3), "&"), lambda p: p != "")
    name, value = lambda p: F.substring_index(p, "=", 1), lambda p: F.regexp_replace(p, r"^[^=]*=?", "")
    known = F.array(*map(F.lit, TRACKING))
    kept = F.filter(pairs, lambda p: ~F.array_contains(known, F.lower(F.coalesce(F.try_url_decode(name(p)), name(p)))))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_requoted(name(p)), F.lit("="), _requoted(value(p)))), "&")
    marked = lambda mark, text: F.when(text == "", "").otherwise(F.concat(F.lit(mark), text))
    scheme = F.regexp_extract(part(1), "^[^:]+", 0)
    cleaned = F.concat(F.lower(scheme), F.regexp_replace(part(1), "^[^:]+", ""), part(2), marked("?", query), marked("#", part(4)))
    odd = F.length(F.translate(part(1), "[", "")) != F.length(F.translate(part(1), "]", ""))
    return F.when((F.size(kept) == F.size(pairs)) | odd, url).otherwise(cleaned)


def clean_urls(df: DataFrame, column: str = "text") -> DataFrame:
    """Drops tracking parameters from the URLs of a text: the pieces between them and the cleaned URLs, put together again."""
    text, pattern = F.col(column), "(?i)" + URL
    between, urls = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ends = F.concat(F.transform(urls, without_tracking), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(between, ends, lambda x, y: F.concat(x, y)), "")
    return df.withColumn(column, F.when(F.coalesce(text.rlike(r"(?i)https?://[^\s<>\"')\]]*\?"), F.lit(False)), whole).otherwise(text))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text with lower case and white space collapsed: the fingerprint of texts in Western European letters."""
    folded = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.sha2(_strip(F.regexp_replace(folded, r"(?U)\s+", " ")), 256)


@F.pandas_udf(StringType())
def fingerprint_exact(texts: pd.Series) -> pd.Series:
    """The same with full Unicode case folding (ligatures, final sigma)."""
    import hashlib

    return texts.map(lambda t: None if t is None else hashlib.sha256(" ".join(t.casefold().split()).encode()).hexdigest())


def with_fingerprint(df: DataFrame, column: str = "text", name: str = "fp") -> DataFrame:
    """Adds the exact fingerprint, by one pass through Python: telling the texts that need full folding by a pattern costs more."""
    return df.withColumn(name, fingerprint_exact(F.col(column)))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(_strip(F.regexp_replace(text, r"(?U)\s+", " ")), MARKDOWN, r"\\$1")


def parse_reference(raw: Column) -> Column:
    """STRUCT<kind, video_id, channel_id, handle, legacy_username>; what can't be read has the kind 'error'."""
    text = _strip(raw)
    candidate = F.when(F.contains(text, F.lit("//")), text).otherwise(F.concat(F.lit("https://"), text))
    rest = F.regexp_extract(candidate, r"^[A-Za-z][A-Za-z0-9+.-]*://(.*)$|^//(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), r"^www\.", ""), r"^m\.", "")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first, second = F.coalesce(F.get(parts, 0), F.lit("")), F.coalesce(F.get(parts, 1), F.lit(""))
    watch = F.regexp_extract(rest, r"\?(?:[^#]*?&)?v=([^&#]*)", 1)
    is_id = lambda c: c.rlike(r"^[A-Za-z0-9_-]{11}$")
    tube, short = host == "youtube.com", host == "youtu.be"
    video = F.when(short & is_id(first), first).when(tube & (first == "watch") & is_id(watch), watch).when(tube & (first == "shorts") & is_id(second), second)
    bare_channel = text.rlike(r"^UC[A-Za-z0-9_-]{22}$")
    bare_handle = F.startswith(text, F.lit("@")) & ~F.contains(text, F.lit("/"))
    channel = F.when(bare_channel, text).when(~bare_handle & tube & (first == "channel") & (second != ""), second)
    handle = F.when(bare_handle, text).when(~bare_channel & tube & F.startswith(first, F.lit("@")), first)
    user = F.when(~bare_handle & ~bare_channel & tube & (first == "user") & (second != ""), second)
    video = F.when(~bare_handle & ~bare_channel, video)
    kind = F.when(channel.isNotNull(), "channel_id").when(handle.isNotNull(), "handle").when(video.isNotNull(), "video").when(user.isNotNull(), "legacy_username").otherwise("error")
    return F.struct(kind.alias("kind"), video.alias("video_id"), channel.alias("channel_id"), handle.alias("handle"), user.alias("legacy_username"))


def comment_pages(count: Column, page: int = 100) -> Column:
    return F.when(count <= 0, F.lit(0)).otherwise(F.ceil(count / page)).cast("bigint")


def filter_clusters(n: Column) -> Column:
    """Clusters that the stage filter asks for."""
    return F.when(n < 2, F.lit(1)).otherwise(F.least(F.greatest(F.lit(2), F.floor(n / 15)), F.lit(60), n)).cast("bigint")


def synthesis_clusters(n: Column, most: int = 3) -> Column:
    return F.when(n < 2, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), F.floor(n / 2)))).cast("bigint")


#: Stage names as shown to users.
STAGE_LABELS = {
    "ingestion": "Pulling comments from YouTube",
    "stage_a_sentiment": "Classifying sentiment (Stage A)",
    "stage_a_embedding": "Embedding comments (Stage A)",
    "stage_b": "Classifying requests & confusion (Stage B)",
    "stage_c": "Synthesizing insights (Stage C)",
}


def stage_label(stage: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in STAGE_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.coalesce(stage, F.lit(""))), stage, F.lit("Starting…"))


def vendor(model: Column) -> Column:
    """The second segment of provider/vendor/model."""
    return F.split_part(model, F.lit("/"), F.lit(2))


def bare_model(model: Column, prefix: str = "openrouter/") -> Column:
    return F.regexp_replace(model, "^" + re.escape(prefix), "")


def quota_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "America/Los_Angeles"))


def quota_refusal(needed: Column, comments: Column, videos: Column, remaining: Column) -> Column:
    return F.format_string("This analysis needs an estimated %d more YouTube API quota units to pull %d comments across %d videos, but only %d remain today (resets at midnight Pacific Time).", needed, comments, videos, remaining)
