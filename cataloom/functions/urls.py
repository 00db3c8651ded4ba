"""URL functions as column expressions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import squash, strip

# Hosts of mail providers, first labels that many companies share, hosts that aren't a company's own, blocked parts.
MAIL_HOSTS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "qq.com", "163.com", "126.com", "foxmail.com", "naver.com"]
GENERIC_LABELS = ["ac", "co", "com", "edu", "gov", "go", "net", "org", "ne", "linkedin", "facebook", "twitter", "x", "instagram", "youtube", "alibaba", "globalsources", "made-in-china", "kompass", "linktr"]
OTHER_HOSTS = [
    "facebook.com", "www.facebook.com", "twitter.com", "x.com", "www.x.com",
    "linkedin.com", "www.linkedin.com", "instagram.com", "www.instagram.com",
    "youtube.com", "www.youtube.com", "wechat.com", "weibo.com",
    "semi.org", "expo.semi.org", "portal2026.semiconindia.org",
    "semiconindia.org", "www.semiconindia.org", "maps.google.com",
    "goo.gl", "google.com", "www.google.com",
]
BLOCKED_HOSTS = ["semi.org", "semiconindia.org", "portal2026", "expo.semi.org", "facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com", "youtube.com", "wechat.com", "weibo.com", "wa.me", "whatsapp.com", "maps.google", "goo.gl", "google.com/maps"]
BLOCKED_PARTS = [".aspx", "boothurl", "ebooth", "eventmap", "javascript:", "mailto:", "tel:", "#"]


def authority(url: Column) -> Column:
    """What stands between :// and the path, in lower case."""
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def website_domain(url: Column) -> Column:
    """Host without www., null for none and for mail providers; a port and user are dropped."""
    u = strip(url)
    full = F.when(u.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), u).otherwise(F.concat(F.lit("http://"), u))
    host = F.regexp_replace(F.regexp_replace(authority(full), "^.*@", ""), r":\d*$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when((u != "") & (host != "") & ~host.isin(MAIL_HOSTS), host)


def full_domain(url: Column) -> Column:
    """Authority without www and its number, the port included; null where its first label is one that many share."""
    u = strip(url)
    host = F.regexp_replace(authority(F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))), r"^www\d*\.", "")
    return F.when((u != "") & (host != "") & ~F.element_at(F.split(host, r"\."), 1).isin(GENERIC_LABELS), host)


def tidy_website(url: Column) -> Column:
    """With a scheme and without a slash at the end; empty stays empty."""
    u = squash(url)
    full = F.when(F.lower(u).rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), F.regexp_replace(u, "^/+", "")))
    return F.when(u == "", "").otherwise(F.regexp_replace(full, "/+$", ""))


def is_company_website(url: Column) -> Column:
    """http or https, and not a social network's or the show's own host."""
    u = F.coalesce(url, F.lit(""))
    host = authority(u)
    bare = F.regexp_replace(host, "^[w.]+", "")
    others = sorted({h.lstrip("w.") for h in OTHER_HOSTS})
    return F.lower(u).rlike("^https?://") & (host != "") & ~host.isin(OTHER_HOSTS) & ~bare.isin(others)


def is_blocked(url: Column) -> Column:
    """Whether one of BLOCKED_PARTS stands anywhere in the url, or one of BLOCKED_HOSTS in its host; null isn't blocked."""
    u = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(u, "^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    out = F.lit(False)
    for where, parts in ((u, BLOCKED_PARTS), (host, BLOCKED_HOSTS)):
        for p in parts:
            out = out | where.contains(p)
    return out


@F.pandas_udf(T.StringType())
def joined(base: pd.Series, link: pd.Series) -> pd.Series:
    """Absolute form of a link on a page."""

    def one(b: str | None, x: str | None) -> str | None:
        try:
            return None if x is None else urljoin(b or "", x.strip())
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)])


def external_url(base: Column, link: Column) -> Column:
    """The link as an absolute http(s) url with a dotted host, without a slash at the end; null if the link or that form is blocked."""
    u = joined(base, link)
    return F.when(u.rlike(r"(?i)^https?://[^/?#]*\.[^/?#]*") & ~is_blocked(strip(link)) & ~is_blocked(u), F.regexp_replace(u, "/+$", ""))


def booth_id(url: Column) -> Column:
    """The number behind BoothID=, upper or lower case; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)BoothID=(\d+)", 1)


def digits_id(raw: Column) -> Column:
    """An id in a padded text as a number."""
    return F.nullif(F.regexp_replace(raw.cast("string"), r"\D", ""), F.lit("")).try_cast("bigint")
