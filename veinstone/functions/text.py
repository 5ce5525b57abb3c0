"""Text expressions. All are built-in expressions, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of Latin letters (with those of western languages), digits and underscores, or runs of two ideographs or more: the same in every regex dialect.
WORD = "[a-z0-9_ß-öø-ÿ]+|[一-鿿]{2,}"


def words(c: Column) -> Column:
    """Lower-case words of a text, in order; null for null.

    Runs of ideographs have no spaces: they give every two that stand side by side, so that a word is found wherever it stands.
    """
    runs = F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1)
    two = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda x: F.when(x >= F.lit("一"), two(x)).otherwise(F.array(x))))


def words_sql(text: str) -> str:
    """The same in SQL."""
    return f"flatten(list_transform(regexp_extract_all(lower({text}), '{WORD}'), lambda x: CASE WHEN x >= '一' THEN list_transform(range(1, length(x)), lambda i: x[i:i + 1]) ELSE [x] END))"


def mixed_tokens(c: Column) -> Column:
    """Runs of two or more ideographs, and words with their case kept."""
    return F.regexp_extract_all(c, F.lit("([一-鿿]{2,}|[A-Za-z0-9_]+)"), 1)


def ascii_tokens(c: Column) -> Column:
    """ASCII texts are split at white space, others give ``mixed_tokens``."""
    split = F.filter(F.split(c, "[ \\t\\r\\n]+"), lambda x: x != "")
    return F.when(c.rlike("^[\\x00-\\x7F]*$"), split).otherwise(mixed_tokens(c))


def first_line(c: Column) -> Column:
    return F.regexp_extract(c, "^([^\\n]*)", 1)


def label(c: Column) -> Column:
    """Lower case, nothing but plain letters, digits and ideographs."""
    return F.regexp_replace(F.lower(c), "[^0-9a-z一-鿿]", "")


def characters(c: Column) -> Column:
    """The characters of a text as an array, empty for an empty text."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def shingles(c: Column) -> Column:
    """Distinct runs of 2 characters up to a length of 6, of 3 above; the whole if it is no longer than that."""
    k = F.when(F.length(c) <= 6, 2).otherwise(3)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substring(c, i, k))
    return F.when(F.length(c) <= k, F.array(c)).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def entropy(c: Column) -> Column:
    """Entropy of the characters in bits, 0 for an empty text."""
    chars = characters(c)
    n = F.size(chars)
    parts = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def fnv1a(c: Column) -> Column:
    """FNV-1a of 32 bits over the code points of a text, as a long."""
    points = F.transform(characters(c), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(points, F.lit(2166136261).cast("long"), lambda h, p: (h.bitwiseXOR(p) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def stable_key(c: Column, n: int = 16) -> Column:
    """The first characters of the SHA-1 of a text."""
    return F.substring(F.sha1(c), 1, n)


def visible_length(html: Column) -> Column:
    """Characters of HTML without tags and white space."""
    return F.length(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), "[ \\t\\r\\n]+", ""))


def html_text(html: Column) -> Column:
    """HTML without scripts, styles and tags, common entities resolved, white space joined."""
    t = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, "[ \\t\\r\\n]+", " "))
