"""Column helpers for what is shown or published: amounts, times, links and feed items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    """Text for XML and HTML, quotes included."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for mark, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def clock(seconds: Column) -> Column:
    """`m:ss` of rounded seconds, half to even."""
    total = F.greatest(F.lit(0), F.bround(seconds).cast("int"))
    return F.format_string("%d:%02d", F.floor(total / 60).cast("int"), total % 60)


def byte_size(n: Column) -> Column:
    """`512 bytes`, `6.8 KB` or `6.8 MB`."""
    return F.when(n < 1024, F.format_string("%d bytes", n)).when(n < 1 << 20, F.format_string("%.1f KB", F.bround(n / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / (1 << 20), 1)))


def duration(seconds: Column) -> Column:
    """`0.3s` below ten seconds, then `41s`, `1m 42s`, `1h 02m`."""
    value = F.greatest(F.lit(0.0), seconds)
    total = F.floor(value).cast("int")
    minutes, hours = F.floor(total / 60).cast("int"), F.floor(total / 3600).cast("int")
    return (
        F.when(value < 10, F.format_string("%.1fs", F.bround(value, 1))).when(total < 60, F.format_string("%ds", total))
        .when(total < 3600, F.format_string("%dm %02ds", minutes, total % 60)).otherwise(F.format_string("%dh %02dm", hours, minutes % 60))
    )


def mail_date(ts: Column) -> Column:
    """A feed item's date in the form that mail headers use."""
    return F.date_format(ts.cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss Z")


def source_kind(source: Column) -> Column:
    """What a source string names: a URL, a PDF, a `kind:path` reference or a path."""
    return (
        F.when(source.rlike("(?i)^https?://"), "url").when(F.lower(source).endswith(".pdf"), "pdf")
        .when(source.rlike(r"(?U)^[A-Za-z_][\w+.\-]*:.+"), "reference").otherwise("path")
    )


def challenged(status: Column, header: Column, body: Column, markers: list[str]) -> Column:
    """Whether a response asks to prove that its reader is no robot."""
    head = F.lower(F.substring(body, 1, 262144))
    marked = F.lit(False)
    for marker in markers:
        marked = marked | F.contains(head, F.lit(marker))
    return F.coalesce(F.lower(header) == "challenge", F.lit(False)) | (status.isin(403, 429, 503) & marked)


def publishes(asked: Column, automatic: Column, kind: Column) -> Column:
    """An explicit wish decides; else the setting, for research and articles or where no kind is known."""
    return F.coalesce(asked, automatic & (kind.isNull() | kind.isin("research", "article")))


def last_object(text: Column) -> Column:
    """The JSON object that a text is, or else that its last line is; null if neither."""
    body = F.trim(text)
    whole, line = F.try_parse_json(body), F.try_parse_json(F.element_at(F.split(body, "\n"), -1))
    found = F.coalesce(whole, line)
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def description(title: Column, chapters: Column, link: Column) -> Column:
    """A feed item's description: chapters (array of start_ms and title) as a list, and a link."""
    items = F.array_join(F.transform(chapters, lambda c: F.concat(F.lit("<li>"), clock(c["start_ms"] / 1000), F.lit(" — "), escaped(c["title"]), F.lit("</li>"))), "")
    listed = F.when(F.size(chapters) > 0, F.concat(F.lit("<h3>Chapters</h3><ul>"), items, F.lit("</ul>"))).otherwise("")
    read = F.when(F.coalesce(link, F.lit("")) != "", F.concat(F.lit('<p><a href="'), escaped(link), F.lit('">Read the original article</a></p>'))).otherwise("")
    return F.concat(F.lit("<p>Narrated audio edition of "), escaped(title), F.lit(".</p>"), listed, read)


def feed_item(title: Column, guid: Column, date: Column, about: Column, url: Column, size: Column) -> Column:
    """One RSS item."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), escaped(value), F.lit(f"</{name}>"))
    sound = F.concat(F.lit('<enclosure url="'), escaped(url), F.lit('" length="'), size.cast("string"), F.lit('" type="audio/mpeg"/>'))
    return F.concat(F.lit("<item>"), tag("title", title), F.lit('<guid isPermaLink="false">'), escaped(guid), F.lit("</guid>"), tag("pubDate", date), tag("description", about), sound, F.lit("</item>"))
