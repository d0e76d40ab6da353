"""Column helpers over text; all of them stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import patterns as P


def strip(text: Column) -> Column:
    """The text without Unicode white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    """Words parted by white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def sentences(text: Column) -> Column:
    """Sentences, parted after `.`, `!` or `?` at white space; blank ones are left out."""
    return F.filter(F.split(strip(text), r"(?U)(?<=[.!?])\s+"), lambda s: strip(s) != "")


def slug(title: Column, otherwise: str = "episode") -> Column:
    """A file-name form of a title: at most 60 characters of a-z, 0-9 and single dashes; `otherwise` if none is left."""
    dashed = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.trim(F.substring(F.coalesce(F.nullif(dashed, F.lit("")), F.lit(otherwise)), 1, 60), F.lit("-"))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(otherwise))


def keyed_slug(title: Column, key: Column, otherwise: str = "episode") -> Column:
    """The slug with six hex digits of the key's SHA-256."""
    return F.concat(slug(title, otherwise), F.lit("-"), F.substring(F.sha2(key, 256), 1, 6))


def canonical_title(title: Column) -> Column:
    """A title without outer white space, with plain quotes and dashes."""
    return F.translate(strip(title), "“”„—", '"""-')


def spoken_date(raw: Column) -> Column:
    """`2026-09-14` as `September 14, 2026`; text without a date stays."""
    day = F.to_date(F.try_to_timestamp(F.regexp_extract(raw, r"\d{4}-\d{2}-\d{2}", 0), F.lit("yyyy-MM-dd")))
    return F.coalesce(F.date_format(day, "MMMM d, yyyy"), raw)


def spoken(text: Column) -> Column:
    """Text for reading aloud: section signs spelled, URLs and what they leave behind removed."""
    out = F.regexp_replace(F.regexp_replace(text, P.SECTION_SIGN, "section $1"), P.URL, "")
    out = F.regexp_replace(F.regexp_replace(out, P.ORPHANS, ""), P.LOOSE_COMMA, "$1")
    out = F.regexp_replace(out, P.LOOSE_STOP, "$1")
    return strip(F.regexp_replace(out, r"[ \t]{2,}", " "))


def identifier_words(code: Column) -> Column:
    """An identifier as words: snake, kebab and camel boundaries become blanks."""
    bare = F.regexp_replace(strip(code), P.CODE_EDGE, "")
    parted = F.regexp_replace(F.translate(bare, "_-", "  "), P.CAMEL, " ")
    return strip(F.regexp_replace(parted, r"[ \t]{2,}", " "))


def spoken_code(code: Column) -> Column:
    """An inline-code span for reading aloud; empty where it is to be dropped."""
    text = strip(code)
    words = identifier_words(F.replace(F.regexp_replace(text, P.CODE_MARKS, " "), F.lit("."), F.lit(" ")))
    sha = F.replace(text, F.lit(" "), F.lit("")).rlike(P.CODE_SHA) & text.rlike("[a-fA-F]")
    dropped = reduce(Column.__or__, (text.rlike(p) for p in P.CODE_DROPPED), (text == "") | sha)
    return (
        F.when(dropped, "")
        .when(text.rlike(P.CODE_KEY), F.concat(F.lit("the "), text, F.lit(" key")))
        .when(text.rlike(P.CODE_NUMBER), text)
        .otherwise(words)
    )


def file_title(path: Column) -> Column:
    """`my_notes.md` as `My Notes`."""
    stem = F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    parts = F.filter(F.split(stem, r"[_\-]+"), lambda w: w != "")
    return F.when(F.size(parts) == 0, "Untitled").otherwise(F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " "))


def pronounced(text: Column, lexicon: dict[str, str]) -> Column:
    """Whole words replaced by their spoken forms in one pass, longest first, so that no replacement is replaced."""
    if not lexicon:
        return text
    terms = sorted(lexicon, key=len, reverse=True)
    pattern = r"(?U)(?<!\w)(" + "|".join(re.escape(t) for t in terms) + r")(?!\w)"
    known = F.create_map(*[F.lit(x) for pair in lexicon.items() for x in pair])
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    said = F.concat(F.transform(found, lambda t: known[t]), F.array(F.lit("")))
    return F.array_join(F.flatten(F.zip_with(gaps, said, lambda g, t: F.array(g, t))), "")


def normal_url(url: Column) -> Column:
    """A URL's identity: scheme and host in lower case, tracking keys and fragment removed, `/` for no path."""
    text = strip(url)
    scheme, host = F.lower(F.try_parse_url(text, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(text, F.lit("HOST")))
    user, port = F.try_parse_url(text, F.lit("USERINFO")), F.regexp_extract(F.try_parse_url(text, F.lit("AUTHORITY")), ":([0-9]+)$", 1)
    path = F.coalesce(F.nullif(F.try_parse_url(text, F.lit("PATH")), F.lit("")), F.lit("/"))
    pairs = F.filter(F.split(F.coalesce(F.try_parse_url(text, F.lit("QUERY")), F.lit("")), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike("^utm_") & ~F.lower(F.substring_index(p, "=", 1)).isin("fbclid", "gclid", "mc_cid", "mc_eid"))
    paired = F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    query = F.when(F.size(paired) > 0, F.concat(F.lit("?"), F.array_join(paired, "&"))).otherwise("")
    full = F.concat(scheme, F.lit("://"), F.coalesce(F.concat(user, F.lit("@")), F.lit("")), host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), path, query)
    return F.when(scheme.isin("http", "https") & (host != ""), full)


def paper_id(url: Column) -> Column:
    """The paper id of an arXiv page URL, else null; `.pdf` may end it only under /pdf/."""
    text = strip(url)
    host = F.lower(F.try_parse_url(text, F.lit("HOST")))
    path = F.try_parse_url(text, F.lit("PATH"))
    plain, pdf = F.regexp_extract(path, f"^/(?:abs|html|pdf)/({P.PAPER})/?$", 1), F.regexp_extract(path, rf"^/pdf/({P.PAPER})(?:\.pdf)?/?$", 1)
    ours = F.lower(F.try_parse_url(text, F.lit("PROTOCOL"))).isin("http", "https") & host.isin("arxiv.org", "www.arxiv.org", "export.arxiv.org")
    return F.when(ours, F.coalesce(F.nullif(plain, F.lit("")), F.nullif(pdf, F.lit(""))))
