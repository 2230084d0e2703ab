"""Text normalisation as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from litgraph import lookups as L

_EDGE = r"""[\s.,;:!?"'\[\]{}]+"""


def nonempty(c: Column) -> Column:
    """The value, or null when it is the empty string."""
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    """The text without white space at its ends (``trim`` takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def regex_any(words) -> str:
    """One alternation that matches any of the literal ``words``."""
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def norm_key(c: Column) -> Column:
    """lower case, punctuation (but hyphen and Greek letters) to blanks, single blanks."""
    kept = F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w\s\-]", " ")
    return F.coalesce(F.trim(F.regexp_replace(kept, r"(?U)\s+", " ")), F.lit(""))


def strip_parens(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\([^)]+\)", "")


def canonical_form(c: Column) -> Column:
    """text without parentheticals and edge punctuation, single blanks, lower case."""
    s = F.regexp_replace(strip_parens(F.trim(c)), f"^{_EDGE}|{_EDGE}$", "")
    return F.trim(F.lower(F.regexp_replace(s, r"\s+", " ")))


def paren_extras(c: Column) -> Column:
    """the 2-30 character parentheticals of a text, as an array."""
    inner = F.transform(F.regexp_extract_all(c, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda x: F.trim(x))
    return F.filter(inner, lambda x: F.length(x).between(2, 30))


def is_null_word(c: Column) -> Column:
    return F.lower(c).isin("", *L.NULL_WORDS)


def clean_entity(c: Column) -> Column:
    """trimmed entity text; null words and texts over 200 characters become null."""
    s = strip(c)
    return F.when(~is_null_word(s) & (F.length(s) <= 200), s)


def clean_value(c: Column) -> Column:
    """the value unless it is a null word."""
    return F.when(~is_null_word(c), c)


def section_key(title: Column) -> Column:
    """normalised section name of a section title."""
    low = F.lower(title)
    hit = F.coalesce(*[F.when(low.rlike(p), F.lit(k)) for p, k in L.SECTION_PATTERNS])
    return F.coalesce(hit, F.lit("other"))


def flexible_date(c: Column) -> Column:
    """a four-digit year becomes its first of January; else the first ten characters."""
    s = F.trim(c.cast("string"))
    day = F.when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01"))).otherwise(F.substring(s, 1, 10))
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd"))


def first_name(author: Column) -> Column:
    """given name of "Last, First" or "First Last"."""
    a = F.trim(author)
    after = F.trim(F.element_at(F.split(a, ","), 2))
    return F.when(a.contains(","), F.element_at(F.split(after, r"\s+"), 1)).otherwise(
        F.element_at(F.split(a, r"\s+"), 1)
    )


def author_name(author: Column) -> Column:
    """the name of an author given as a JSON object with ``name``, or as plain text."""
    return F.coalesce(F.get_json_object(author, "$.name"), author)


def emails(json_text: Column) -> Column:
    """distinct e-mail addresses anywhere in a metadata document given as JSON text."""
    return F.array_distinct(F.regexp_extract_all(json_text, F.lit(L.EMAIL_PATTERN), F.lit(0)))


def ellipsis(c: Column, n: int, inside: bool = True) -> Column:
    """F16: cut to ``n`` characters; the dots count towards ``n`` when ``inside``."""
    keep = n - 3 if inside else n
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)


def strip_tags(c: Column) -> Column:
    """drop markup tags."""
    return F.regexp_replace(c, r"<[^>]+>", "")


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def strip_fences(c: Column) -> Column:
    """drop code-fence lines from a model answer."""
    return strip(F.regexp_replace(strip(c), r"(?m)^\s*```.*$\n?", ""))


@F.pandas_udf(T.StringType())
def balanced_object(texts):  # noqa: ANN001, ANN201
    """the first balanced ``{...}`` of each text, or null."""

    def first(text):
        start = text.find("{") if text else -1
        depth = 0
        for m in re.finditer(r"[{}]", text[start:] if start >= 0 else ""):
            depth += 1 if m.group() == "{" else -1
            if depth == 0:
                return text[start : start + m.end()]
        return None

    return texts.map(first)


def json_strings(c: Column) -> Column:
    """JSON text holding an array of strings; junk and null become an empty array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def fill_template(template: Column, condition: Column) -> Column:
    """put ``condition`` in the template; null when it needs one and none is given."""
    needs = template.contains("{condition}")
    cond = nonempty(F.trim(condition))
    return F.when(needs, F.replace(template, F.lit("{condition}"), cond)).otherwise(template)


def distinct_ci(items: Column) -> Column:
    """array without nulls and case-insensitive repeats, first spelling and order kept."""
    kept = F.array_compact(items)
    low = F.transform(kept, F.lower)
    return F.filter(kept, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def contains_ci(c: Column, needle: Column | str) -> Column:
    """Case-insensitive substring test; wildcards in ``needle`` are plain characters."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.coalesce(F.lower(c).contains(F.lower(needle)), F.lit(False))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def tokens(c: Column) -> Column:
    """Lower-case alphanumeric tokens of a text."""
    return F.filter(
        F.split(F.lower(c), r"(?U)[^\p{L}\p{N}]+"), lambda t: t != ""
    )
