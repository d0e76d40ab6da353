"""Column helpers for who wrote a source, when, where it lies, and what its editions are called."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions.text import keyed_slug, strip


def _full(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def authors(raw: Column) -> Column:
    """The names in a list parted by `;` or `and`; a list of one entry is parted at its commas if it has two or more."""
    given = _full(F.flatten(F.transform(F.split(raw, ";"), lambda p: F.split(strip(p), r"(?U)\s+and\s+"))))
    listed = F.split(F.get(given, F.lit(0)), ",")
    return F.when((F.size(given) == 1) & (F.size(listed) > 2), _full(listed)).otherwise(given)


def credit(names: Column) -> Column:
    """Up to three names in a phrase; of four or more the first `and colleagues`; none gives the empty text."""
    name = lambda k: F.get(names, F.lit(k))
    return (
        F.when(F.size(names) > 3, F.concat(name(0), F.lit(" and colleagues")))
        .when(F.size(names) == 3, F.concat(name(0), F.lit(", "), name(1), F.lit(", and "), name(2)))
        .otherwise(F.array_join(names, " and "))
    )


def stamp_date(text: Column) -> Column:
    """The first `4 Sep 2026` of a text as `2026-09-04`; empty if there is none or its month is no month."""
    part = lambda k: F.regexp_extract(text, r"(?U)(\d{1,2})\s+(\w{3})\s+(\d{4})", k)
    month = F.array_position(F.lit(list(P.MONTHS)), F.lower(part(2)))
    return F.when(month > 0, F.concat(part(3), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"))).otherwise("")


def document_date(raw: Column) -> Column:
    """The date that `D:20260904…` or `2026-09-04…` begins with, as `2026-09-04`; else empty. No calendar is consulted."""
    return F.regexp_extract(F.regexp_replace(strip(raw), r"^D:(\d{4})(\d{2})(\d{2})", "$1-$2-$3"), r"^\d{4}-\d{2}-\d{2}", 0)


def shown_date(raw: Column) -> Column:
    """`2026-09-14` or `20260914`, in quotes or not, as `September 14, 2026`; other text stays, without its quotes.

    Week dates (`2026-W38-1`) count as other text."""
    bare = F.regexp_replace(strip(raw), r"""^["']+|["']+$""", "")
    iso = F.when(bare.rlike(r"^(?!0000)(\d{4}-\d{2}-\d{2}|\d{8})\z"), F.regexp_replace(bare, r"^(\d{4})-?(\d{2})-?(\d{2})", "$1-$2-$3"))
    return F.coalesce(F.date_format(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), "MMMM d, yyyy"), bare)


def source_folder(title: Column, key: Column) -> Column:
    """The folder name of an acquired source: its title's slug, `article` if none is left, and six digits of the key's digest."""
    return keyed_slug(title, key, "article")


def letters_digits(text: Column) -> Column:
    """a-z and 0-9 of the lower-cased text, for comparing titles."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def masked(url: Column, token: Column) -> Column:
    """The URL with its token as `****`; without a token it stays."""
    return F.when(F.coalesce(token, F.lit("")) != "", F.replace(url, token, F.lit("****"))).otherwise(url)


def valid_key(key: Column) -> Column:
    """Whether a cache key is 64 lower-case hex digits; null is none."""
    return F.coalesce(key.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def source_link(url: Column, ref: Column, templates: dict[str, str]) -> Column:
    """The URL if there is one; else the template of the reference's kind, with the rest of the reference as `{path}`.

    References without a kind, kinds without a template, and templates that name anything but `{path}` give no link."""
    path, kind, out = F.regexp_replace(ref, "^[^:]*:", ""), F.substring_index(ref, ":", 1), F.lit("")
    for name, template in templates.items():
        try:
            pieces = list(Formatter().parse(template))
        except ValueError:
            continue
        if template and all(field in (None, "path") and not form and not way for _, field, form, way in pieces):
            made = [c for text, field, _, _ in pieces for c in ([F.lit(text)] + ([path] if field else []))]
            out = F.when(F.contains(ref, F.lit(":")) & (kind == name), F.concat(*made)).otherwise(out)
    return F.when(strip(F.coalesce(url, F.lit(""))) != "", url).otherwise(out)


def _of_edition(edition: Column, texts: dict[str, str]) -> Column:
    out = F.lit("")
    for name, text in texts.items():
        out = F.when(edition == name, F.lit(text)).otherwise(out)
    return out


def edition_title(title: Column, edition: Column) -> Column:
    """The title with its edition in brackets; editions without a label leave it as it is."""
    label = _of_edition(edition, P.EDITION_LABELS)
    return F.when(label != "", F.concat(title, F.lit(" ("), label, F.lit(")"))).otherwise(title)


def coverage(edition: Column) -> Column:
    """The sentence that says what an edition covers; empty for others."""
    return _of_edition(edition, P.EDITION_COVERAGE)
