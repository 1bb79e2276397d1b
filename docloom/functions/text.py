"""Text normal forms and lexical relevance as columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a query that say nothing about its topic.
STOP_WORDS = ("a", "an", "and", "class", "does", "for", "function", "how", "in", "is", "of", "the", "to", "use", "what", "with", "work")
#: The places a query term can stand in and what it counts there.
HEADING_WEIGHT, TITLE_WEIGHT, CONTENT_WEIGHT, URL_WEIGHT = 1.0, 0.8, 0.55, 0.35
HEADING_PHRASE, CONTENT_PHRASE = 0.25, 0.15
#: Every line end that Python's ``splitlines`` knows.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def strip(text: Column) -> Column:
    """Without outer white space, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^[\s\u001c-\u001f]+|[\s\u001c-\u001f]+$", "")


def clean_markdown(markdown: Column) -> Column:
    """Lines without trailing white space, runs of blank lines as one, none at either end."""
    unified = F.regexp_replace(markdown, LINE_END, "\n")
    bare = F.regexp_replace(unified, r"(?U)[\s\u001c-\u001f&&[^\n]]+(?=\n|\z)", "")
    squeezed = F.regexp_replace(bare, r"\n{3,}", "\n\n")
    return F.regexp_replace(squeezed, r"^\n+|\n+$", "")


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, joined by blanks; ``\\_`` counts as ``_``."""
    return F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit("\\_"), F.lit("_"))), r"[^a-z0-9]+", " "))


def search_text(text: Column) -> Column:
    """``words``, with camelCase split first."""
    plain = F.replace(text, F.lit("\\_"), F.lit("_"))
    return words(F.regexp_replace(plain, r"([a-z0-9])([A-Z])", "$1 $2"))


def query_terms(query: str) -> list[str]:
    """The terms of a query that count, duplicates kept."""
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query.replace("\\_", "_")).lower()
    return [t for t in re.findall(r"[a-z0-9]+", split) if len(t) > 1 and t not in STOP_WORDS]


def query_terms_column(query: Column) -> Column:
    """``query_terms`` for a column of queries."""
    return F.filter(F.split(search_text(query), " "), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def lexical_forms(heading: Column, title: Column, content: Column, url: Column) -> Column:
    """What of a chunk's texts lexical relevance looks at: its words by place, and two texts for phrases.

    Null texts count as empty. Words come once for each place.
    """
    texts = [search_text(F.coalesce(c, F.lit(""))) for c in (heading, title, content, url)]
    names = ("heading", "title", "content", "url")
    bags = [F.array_distinct(F.split(t, " ")).alias(f"{n}_words") for t, n in zip(texts, names, strict=True)]
    return F.struct(texts[0].alias("heading"), texts[2].alias("content"), *bags)


def lexical_relevance_of(terms: Column, forms: Column) -> Column:
    """How well a chunk's ``lexical_forms`` agree with a query's terms (array of strings), between 0 and 1.

    Each term counts what its best place weighs; the mean of that, and a bonus if
    the terms stand as one phrase in the headings or else the content. Without
    terms the relevance is 0.
    """
    weights = {"heading": HEADING_WEIGHT, "title": TITLE_WEIGHT, "content": CONTENT_WEIGHT, "url": URL_WEIGHT}

    def weight_of(term: Column) -> Column:
        # The best place comes first.
        found = F.lit(0.0)
        for place, weight in sorted(weights.items(), key=lambda w: w[1]):
            found = F.when(F.array_contains(forms[f"{place}_words"], term), F.lit(weight)).otherwise(found)
        return found

    coverage = F.aggregate(F.transform(terms, weight_of), F.lit(0.0), lambda a, x: a + x) / F.size(terms)
    phrase = F.array_join(terms, " ")
    bonus = F.when(forms["heading"].contains(phrase), HEADING_PHRASE).when(forms["content"].contains(phrase), CONTENT_PHRASE).otherwise(0.0)
    score = F.least(F.lit(1.0), coverage + F.when(F.size(terms) < 2, 0.0).otherwise(bonus))
    return F.when(F.size(terms) > 0, score).otherwise(F.lit(0.0))


def lexical_relevance(terms: Column, heading: Column, title: Column, content: Column, url: Column) -> Column:
    """``lexical_relevance_of`` for plain texts."""
    # Bound to a lambda variable, so that texts are normalized and split once, not for each term.
    return F.get(F.transform(F.array(lexical_forms(heading, title, content, url)), lambda forms: lexical_relevance_of(terms, forms)), F.lit(0))


def plain_markdown(text: Column) -> Column:
    """A text without leading number signs, backticks, asterisks and needless white space."""
    bare = strip(F.replace(text, F.lit("\\_"), F.lit("_")))
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?U)^#{1,6}\s*", ""), r"[`*]", "")
    return strip(F.regexp_replace(bare, r"(?U)[\s\u001c-\u001f]+", " "))


def definition_after_name(content: Column, name: Column) -> Column:
    """The plain text of a content behind its leading name, up to the first reference; null if empty."""
    plain, prefix = plain_markdown(content), plain_markdown(name)
    starts = F.startswith(F.lower(plain), F.lower(prefix)) & (F.length(prefix) > 0)
    rest = F.regexp_replace(F.substring(plain, F.length(prefix) + 1, F.length(plain)), r"^[ :\-]+|[ :\-]+$", "")
    chosen = F.when(starts, rest).otherwise(plain)
    return F.nullif(strip(F.split_part(chosen, F.lit("](/python/"), F.lit(1))), F.lit(""))


def first_plain_line(content: Column) -> Column:
    """The first line that is neither blank nor a heading, as plain text; null if there is none."""
    lines = F.transform(F.split(content, LINE_END), strip)
    lines = F.filter(lines, lambda x: (F.length(x) > 0) & ~F.rlike(x, F.lit(r"(?U)^#{1,6}\s")))
    return F.get(F.filter(F.transform(lines, plain_markdown), lambda x: F.length(x) > 0), F.lit(0))


def slug_of(value: str) -> str:
    """ASCII letters and digits in lower case, all else as hyphens; 'topic' if nothing is left."""
    ascii_only = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode().lower()
    return "-".join(re.findall(r"[a-z0-9]+", ascii_only)) or "topic"


def slugify(column: Column) -> Column:
    """``slug_of`` as a column, by Arrow batches (Spark has no Unicode normal forms); null stays null."""

    @F.pandas_udf(T.StringType())
    def by_table(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else slug_of(v))

    return by_table(column)


def ascii_slug(column: Column) -> Column:
    """``slugify`` for texts known to be ASCII, without leaving the JVM."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(column), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(slug == "", F.lit("topic")).otherwise(slug)


#: Small letters that fold to several: the sharp s and the Latin ligatures.
FOLDS = {chr(c): chr(c).casefold() for c in (0xDF, *range(0xFB00, 0xFB07))} | {"ς": "σ"}


def fold(column: Column) -> Column:
    """Text without differences of letter case, for keys (``ß`` and ``SS`` are one); null stays null.

    The JVM's lower case, and ``FOLDS`` for what that leaves different.
    """
    out = F.lower(column)
    for letter, plain in FOLDS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out
