"""Terms of a text, computed in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no topic, German and English.
STOP_WORDS = (
    "aber alle als also am an auch auf aus bei bin bis bitte da dann das dass dem den der des die dies diese dieser doch ein eine einem einen einer es für hat hatte ich ihr im in ist ja kann man mehr mit nach nicht noch nur oder schon sehr sich sie sind so über um und uns unter vom von vor war warum was wenn wer wie wir wird wo zu zum zur "
    "a about after all and any are as at be been but by can could did do does for from had has have he her his how i if in into is it its more no not of on or our over she should so that the their then there these they this to was we were what when where which who why will with would you your"
).split()
SPLIT = r"[^\p{L}\p{N}]+"
#: Terms of up to so many characters are left out.
SHORT = 2


def terms(text: Column) -> Column:
    """All terms in order, repeated ones too: lower case, split at everything but letters and digits, without short and stop words. Null is no term."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda t: (F.length(t) > SHORT) & ~t.isin(*STOP_WORDS))  # looked up in a hash set


def lexemes(text: Column) -> Column:
    """Distinct terms."""
    return F.array_distinct(terms(text))


def document(title: str = "title", body: str = "body") -> Column:
    return F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(body), F.lit("")))


def doc_freqs(postings: DataFrame) -> DataFrame:
    """(term, df) of postings (id, term), each once."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    """ln((n + 1) / (df + 1/2)); negative for a term in more documents than n."""
    return F.log((n + 1.0) / (df + 0.5))


def slugify(text: Column, length: int = 60, fallback: str = "turn") -> Column:
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    s = F.substring(s, 1, length)
    return F.when(s == "", fallback).otherwise(s)


def snippet(text: Column, length: int = 160) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, length)


def shorten(text: Column, length: int, marker: str = " …") -> Column:
    """The text, or its beginning and a marker where it is longer."""
    return F.when(F.length(text) > length, F.concat(F.rtrim(F.substring(text, 1, length)), F.lit(marker))).otherwise(text)


def approx_tokens(chars: Column) -> Column:
    """Characters by 3.7, rounded half to even."""
    return F.bround(chars / 3.7).cast("long")


def first_sentence(text: Column, length: int = 120) -> Column:
    """The first line that isn't a heading, without markup, up to the end of its first sentence and to `length` characters."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")
    plain = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*>]+|\d+\.)\s+|[*_`]+", "")))
    told = F.filter(plain, lambda x: (F.length(x) > 0) & ~x.startswith("#"))
    line = F.coalesce(F.try_element_at(told, F.lit(1)), F.lit(""))
    sentence = F.regexp_extract(line, r"^(.*?[.!?])(?:\s|$)", 1)
    whole = F.when(sentence == "", line).otherwise(sentence)
    return F.when(F.length(whole) > length, F.concat(F.rtrim(F.substring(whole, 1, length - 1)), F.lit("…"))).otherwise(whole)


def highlight(text: Column, words: list[str], before: str = "«", after: str = "»") -> Column:
    """Marks whole words, in any case."""
    pattern = "|".join(rf"\Q{w}\E" for w in sorted(words, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?iU)\b({pattern})\b", f"{before}$1{after}") if words else text


def redact_url(url: Column) -> Column:
    return F.regexp_replace(url, r"://[^/@\s]+@", "://***@")


# Relative days, German and English, with their distance; those of the second line are also nouns and count in lower case only, and not before `früh`.
RELATIVE_DAYS = {"vorgestern": -2, "gestern": -1, "yesterday": -1, "heute": 0, "today": 0, "tomorrow": 1}
LOWER_CASE_DAYS = {"morgen": 1, "übermorgen": 2}
CODE_SPAN = r"(?s)```.*?```|`[^`\n]*`"
_DAY = r"(?:(?i:\b(?:" + "|".join(RELATIVE_DAYS) + r")\b)|(?<!\p{L})(?:" + "|".join(LOWER_CASE_DAYS) + r")\b(?!\s*früh))"


def relative_dates(text: Column, day: Column) -> Column:
    """Distinct (word, date) of the relative days outside code, as `word=date` with the word as it is written, in alphabetical order; day is what `today` means."""
    prose = F.regexp_replace(F.coalesce(text, F.lit("")), CODE_SPAN, " ")
    words = F.regexp_extract_all(prose, F.lit("(?U)" + _DAY), F.lit(0))
    offsets = F.create_map(*[F.lit(x) for kv in (RELATIVE_DAYS | LOWER_CASE_DAYS).items() for x in kv])
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.concat(w, F.lit("="), F.date_add(day, offsets[F.lower(w)]).cast("string")))))


def rewrite_relative_dates(text: Column, day: Column) -> Column:
    """Relative days outside code with their date in brackets."""
    out = F.coalesce(text, F.lit(""))
    for word, off in (RELATIVE_DAYS | LOWER_CASE_DAYS).items():  # a match is skipped where an odd number of backticks precedes it on its line or it lies in a fence
        kind, after = ("(?iU)", "") if word in RELATIVE_DAYS else ("(?U)", r"(?!\s*früh)")
        out = F.regexp_replace(out, F.lit(rf"{kind}(?<![`\w])\b({word})\b{after}(?!\s*\(\d{{4}}-)(?=(?:[^`]*`[^`]*`)*[^`]*$)"), F.concat(F.lit("$1 ("), F.date_add(day, off).cast("string"), F.lit(")")))
    return out


def replace_relative_dates(text: Column, day: Column) -> Column:
    """Relative days outside code replaced by their date."""
    out = F.coalesce(text, F.lit(""))
    for word, off in (RELATIVE_DAYS | LOWER_CASE_DAYS).items():
        kind, after = ("(?iU)", "") if word in RELATIVE_DAYS else ("(?U)", r"(?!\s*früh)")
        out = F.regexp_replace(out, F.lit(rf"{kind}(?<![`\w])\b{word}\b{after}(?=(?:[^`]*`[^`]*`)*[^`]*$)"), F.date_add(day, off).cast("string"))
    return out


def headline(text: Column, words: list[str], most: int = 25, before: str = "«", after: str = "»") -> Column:
    """The `most` words around the first hit, with the hits marked; the beginning of the text where there is none. A third of the words precede the hit."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    hit = rf"(?iU)\b({'|'.join(rf'\Q{w}\E' for w in sorted(words, key=len, reverse=True))})\b" if words else "(?!)"
    first = F.coalesce(F.array_min(F.filter(F.transform(tokens, lambda t, i: F.when(F.regexp_like(t, F.lit(hit)), i)), lambda i: i.isNotNull())), F.lit(0))
    start = F.greatest(F.lit(0), F.least(first - most // 3, F.size(tokens) - most))
    return highlight(F.array_join(F.slice(tokens, start + 1, most), " "), words, before, after)


def title_of(text: Column, length: int = 120) -> Column:
    """The first line that isn't blank, cut to `length` characters with three dots; empty for an empty text."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    line = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    return F.when(F.length(line) > length, F.concat(F.substring(line, 1, length - 3), F.lit("..."))).otherwise(line)


def tag_list(text: Column, forced: list[str] = ()) -> Column:
    """Tags of a comma-separated text, trimmed, then the forced ones; of tags that differ in case only the first stays."""
    given = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    tags = F.concat(given, F.array(*[F.lit(t) for t in forced]).cast("array<string>"))
    lower = F.transform(tags, lambda t: F.lower(t))
    return F.filter(tags, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1)


def trivial_prompt(text: Column, least: int = 2) -> Column:
    """Whether a prompt asks for nothing: a command without a space, or fewer than `least` terms."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (t.startswith("/") & ~F.contains(t, F.lit(" "))) | (F.size(lexemes(t)) < least)
