"""Text functions as column expressions; only Unicode normalisation needs a pandas function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FALLBACK_ABOUT, MIN_KEEP_CHARS

# Legal suffixes that end a name.
LEGAL_SUFFIXES = [
    "incorporated", "corporation", "company", "limited", "co kg", "kabushiki kaisha",
    "sdn bhd", "pte ltd", "pvt ltd", "private limited", "s r l", "s p a", "s a",
    "b v", "n v", "a s", "a g", "gmbh co kg", "gmbh", "kk", "plc", "llp", "llc",
    "lp", "ag", "sa", "srl", "spa", "bv", "nv", "oy", "ab", "as", "kg",
    "inc", "corp", "co", "ltd",
]
# Suffix words that the fallback key drops anywhere, and words that the portal key drops.
FALLBACK_SUFFIXES = "incorporated|corporation|company|limited|kabushiki\\s*kaisha|sdn\\s*bhd|pte\\s*ltd|pvt\\s*ltd|private\\s*limited|s\\s*r\\s*l|s\\s*p\\s*a|s\\s*a|b\\s*v|n\\s*v|gmbh\\s*co\\s*kg|gmbh|kk|plc|llp|llc|lp|inc|corp|co|ltd|ag|sa|srl|spa|bv|nv|oy|ab|as|kg"
PORTAL_WORDS = "pvt|private|ltd|limited|llp|inc|incorporated|co|corp|corporation|gmbh|bv|nv|sa|ag|kk|plc|llc|group|india|technologies|technology"
# Sentences that only announce a booth.
BOILERPLATE = [
    r"\bis\s+located\s+at\s+(booth|stand)\b",
    r"\blocated\s+at\s+(booth|stand)\s*[:#]?\s*[a-z]?\d",
    r"\bwe\s+look\s+forward\s+to\s+meeting\s+you\b",
    r"\blook\s+forward\s+to\s+(seeing|welcoming)\s+you\b",
    r"\b(visit|come\s+(and\s+)?(visit|see))\s+us\s+at\s+(booth|stand)\b",
    r"\bplease\s+visit\s+our\s+(booth|stand)\b",
    r"\bsee\s+you\s+at\s+semicon\b",
    r"\bmeet\s+us\s+at\s+(booth|stand)\b",
    r"^\s*(booth|stand)\s*(no\.?|number|#)?\s*[:\-]?\s*[a-z]?[\d\-]+\s*$",
]
# Words of a query that carry no signal in category names.
QUERY_STOPWORDS = [
    "the", "and", "for", "with", "from", "that", "this", "our", "your", "are",
    "can", "has", "have", "who", "what", "which", "where", "need", "want",
    "find", "looking", "supplier", "suppliers", "vendor", "vendors", "company",
    "companies", "manufacturer", "manufacturers", "maker", "makers",
    "equipment", "systems", "system", "technology", "technologies",
    "solutions", "solution", "services", "service", "products", "product",
    "semiconductor", "semiconductors", "based", "near", "local", "domestic",
    "avoid", "best", "good", "top", "new", "used",
]
# Rows of a directory that aren't exhibitors.
LISTING = [
    r"^\s*$",
    r"^(all|view all|show all|back to|return to)\b",
    r"^(product|technology|market|category|segment)\s+(categories|listing|listings|index)",
    r"^(sponsor|sponsors|media partner|partners|supporting organi[sz]ation)s?\b",
    r"^(pavilion|country pavilion|zone|theatre|theater|stage|lounge|cafe|registration)\b",
    r"^(exhibitor list|exhibitor directory|floor ?plan|hall \d+)\b",
    r"^\d+\s*$",
]
# What a booth, an e-mail address and a phone number look like.
BOOTH = r"(?i)\b(?:booth|stand|stall)\s*(?:no\.?|number|#|:)?\s*([A-Z]{0,3}[-\s]?\d{1,5}[A-Z]?(?:\s*[/,&]\s*[A-Z]{0,3}[-\s]?\d{1,5}[A-Z]?)*)"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"(?:\+?\d[\d\s().-]{7,}\d)"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode normal form KC."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def ascii_only(s: pd.Series) -> pd.Series:
    """Unicode normal form KD without what isn't ASCII."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii"), na_action="ignore")


def folded(c: Column) -> Column:
    """NFKC; ASCII text stays in the JVM, since only the other rows need Python."""
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(nfkc(c))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s++|\s++$", "")


def squash(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def presence(c: Column) -> Column:
    """null where the text is null, empty or blank."""
    return F.when(strip(c) != "", c)


def name_key(name: Column, *, unicode: bool = True) -> Column:
    """Merge key of a name: folded, lower case, without marks and without legal suffixes at its end. A lone suffix stays."""
    s = F.lower(folded(F.coalesce(name, F.lit(""))) if unicode else F.coalesce(name, F.lit("")))
    s = F.regexp_replace(F.regexp_replace(s, r"[.,()\[\]{}'\"]", " "), "[&/]", " and ")
    ending = r"(?:\s+(?:" + "|".join(sorted(LEGAL_SUFFIXES, key=len, reverse=True)) + r")\.?)+$"
    s = squash(s)
    for _ in range(2):
        s = F.trim(F.regexp_replace(s, ending, ""))
    return s


def fallback_key(name: Column) -> Column:
    """Key of names without website: without marks, and without suffix words anywhere; may be empty."""
    s = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\w\s]", " ")
    return squash(F.regexp_replace(s, rf"\b({FALLBACK_SUFFIXES})\b", " "))


def portal_key(name: Column, *, unicode: bool = True) -> Column:
    """Key of portal names: letters a-z and digits, without suffixes and words that all names share."""
    base = squash(folded(F.coalesce(name, F.lit(""))) if unicode else name)
    s = F.regexp_replace(F.lower(base), "[^a-z0-9 ]+", " ")
    return squash(F.regexp_replace(s, rf"\b({PORTAL_WORDS})\b", " "))


def loose_key(name: Column) -> Column:
    """Letters and digits in lower case, for names_match."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[\W_]+", "")


def names_match(a: Column, b: Column) -> Column:
    """Whether one loose key holds the other; empty keys match nothing."""
    x, y = loose_key(a), loose_key(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def snippet_key(name: Column) -> Column:
    return F.upper(squash(name))


def plain_key(name: Column) -> Column:
    return F.lower(strip(name))


def truncated(c: Column, limit: int, mark: str = " ...[truncated]") -> Column:
    """The text up to limit, without the last broken word, and a mark where something was cut."""
    t = strip(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), " [^ ]*$", ""), F.lit(mark)))


def sentences(c: Column) -> Column:
    """Split behind . ! or ? and white space where a capital or digit follows."""
    return F.filter(F.transform(F.split(strip(c), r"(?<=[.!?])\s+(?=[A-Z0-9])"), strip), lambda s: s != "")


def is_boilerplate(sentence: Column) -> Column:
    return sentence.rlike("(?i)" + "|".join(f"(?:{p})" for p in BOILERPLATE))


def cleaned_overview(c: Column) -> Column:
    """Struct (cleaned, removed, kept, fallback_used): the text without booth announcements, or the whole if little is left.

    Each sentence is matched once: the marked sentences, and then the kept ones, are bound to a lambda's variable, so that no
    later use computes them again.
    """
    text = F.coalesce(c, F.lit(""))
    none = F.array().cast("array<string>")
    whole = (text == "") | (text == FALLBACK_ABOUT)

    def parts(marked: Column) -> Column:
        of = lambda removed: F.transform(F.filter(marked, lambda m: m["out"] == removed), lambda m: m["s"])
        return F.struct(of(False).alias("kept"), of(True).alias("removed"))

    def joined(p: Column) -> Column:
        return F.struct(p["kept"].alias("kept"), p["removed"].alias("removed"), F.array_join(p["kept"], " ").alias("joined"))

    def result(p: Column) -> Column:
        short = F.length(p["joined"]) < MIN_KEEP_CHARS
        return F.struct(
            F.when(whole | short, text).otherwise(p["joined"]).alias("cleaned"),
            F.when(whole, none).otherwise(p["removed"]).alias("removed"),
            F.when(text == "", none).when(whole, F.array(text)).otherwise(p["kept"]).alias("kept"),
            F.when(whole, False).otherwise(short).alias("fallback_used"),
        )

    out = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), is_boilerplate(s).alias("out")))
    for step in (parts, joined, result):
        out = F.transform(F.array(out), step)[0]
    return out


def digest(*parts: Column, length: int = 20, sep: str = "\n") -> Column:
    """The first hex digits of the SHA-1 of the parts; null is empty."""
    return F.substring(F.sha1(F.concat_ws(sep, *(F.coalesce(p, F.lit("")) for p in parts)).cast("binary")), 1, length)


def cache_key(name: Column, content_hash: Column) -> Column:
    return digest(name, content_hash, length=24, sep=":")


def without_fences(c: Column) -> Column:
    """A reply of a model without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def query_tokens(c: Column) -> Column:
    """Distinct words of three letters or more that carry signal, in order."""
    stop = F.array(*(F.lit(w) for w in QUERY_STOPWORDS))
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)))


def has_token(name: Column, tokens: Column) -> Column:
    """Whether a token is part of the name."""
    return F.exists(tokens, lambda t: F.lower(F.coalesce(name, F.lit(""))).contains(t))


def is_listing(name: Column) -> Column:
    """Rows of a directory that are navigation, sponsors and the like."""
    n = squash(name)
    return (F.length(n) < 2) | n.rlike("(?i)" + "|".join(f"(?:{p})" for p in LISTING))


def slug(name: Column) -> Column:
    """Portal slug: ASCII, lower case, white space as -, and only letters, digits, &, . and - left."""
    s = F.lower(ascii_only(squash(folded(name))))
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), r"[^a-z0-9&.\-]", "")
    return F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), "^-+|-+$", "")


def plain_slug(name: Column) -> Column:
    """The earlier portal's slug: & as and, anything else but letters and digits as -."""
    s = F.regexp_replace(F.lower(ascii_only(squash(folded(name)))), "&", " and ")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_variants(base: Column) -> Column:
    """Other spellings of a slug, without the slug itself."""
    spelled = [F.regexp_replace(base, r"\.", ""), F.regexp_replace(base, "&", "and"), F.regexp_replace(base, r"[&.]", "")]
    return F.filter(F.array_distinct(F.array(*spelled)), lambda s: (s != base) & (s != ""))


def booth_of(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), BOOTH, 1)


def email_of(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), f"({EMAIL})", 1)


def phone_of(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), f"({PHONE})", 1)


def address_country(c: Column) -> Column:
    """The last part of an address if it can be a country."""
    last = F.trim(F.element_at(F.split(F.coalesce(c, F.lit("")), ","), -1))
    return F.when(F.length(last).between(2, 30) & ~last.rlike(r"\d"), last)


def is_cjk(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("[\\u3040-\\u30ff\\u3400-\\u9fff\\uff66-\\uff9f]")


def english_half(c: Column) -> Column:
    """Of a label in two languages around " / ", the side without Chinese or Japanese letters; a leading three-digit code stays."""
    sides = F.split(F.coalesce(c, F.lit("")), " / ", 2)
    left, right = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
    code = F.regexp_extract(left, r"^(\d{3})\b", 1)
    two = right.isNotNull() & is_cjk(left) & ~is_cjk(right)
    return F.when(two, F.when(code != "", F.concat_ws(" ", code, F.trim(right))).otherwise(F.trim(right))).otherwise(c)


def chunks(c: Column, limit: int = 800) -> Column:
    """Sentences packed greedily into parts of at most limit characters; longer sentences are cut at limit."""
    cut = F.flatten(F.transform(F.split(F.coalesce(c, F.lit("")), "(?<=[\\u3002\\uff01\\uff1f.!?])"), lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / limit) - 1, F.lit(0)).cast("int")), lambda i: F.substr(s, i * limit + 1, F.lit(limit)))))
    last = lambda a: F.element_at(a, -1)
    packed = F.aggregate(
        F.filter(cut, lambda s: s != ""),
        F.array().cast("array<string>"),
        lambda a, s: F.when((F.size(a) > 0) & (F.length(F.concat(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")), s)) <= limit), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(last(a), s)))).otherwise(F.concat(a, F.array(s))),
    )
    return F.filter(F.transform(packed, strip), lambda s: s != "")


def terms(c: Column) -> Column:
    """Words of a-z and 0-9 in lower case, for sparse retrieval."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")
