"""Block scanner for Markdown and outline walker for HTML: kernels behind the tables of blocks and headings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FRONT = re.compile(r"\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)", re.S)
_ITEM = re.compile(r"^(\s*)(?:[-*+]|\d+[.)])\s+(.*)$")
_DELIMITER = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_DEFINITION = re.compile(r"^\s*\[[^\]]+\]:\s*\S+.*$")


def front_title(text: str | None) -> str:
    """The title that a text's frontmatter gives, or an empty string."""
    front = _FRONT.match((text or "").replace("\r\n", "\n"))
    found = re.search(r"""(?m)^title[ \t]*:[ \t]+(?:"([^"\n]*)"|'([^'\n]*)'|([^\n#]*))""", front[0]) if front else None
    return next((g for g in found.groups() if g), "").strip() if found else ""


def blocks_of(text: str | None) -> list[tuple[int, str, int, str, str]]:
    """(line, type, level, info, text) of a text's blocks: heading, paragraph, item, fence, code, table, html, math, footnote."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    front = _FRONT.match(text)
    skip = front[0].count("\n") if front else 0
    lines, out, at = text.split("\n"), [], skip

    def gather(stop) -> str:
        nonlocal at
        start = at
        at += 1
        while at < len(lines) and lines[at].strip() and not stop(lines[at]):
            at += 1
        return "\n".join(lines[start:at])

    opens = lambda x: bool(re.match(r"^\s{0,3}(#{1,6}\s|```|~~~|>|<!--)", x) or _ITEM.match(x))
    while at < len(lines):
        line, first = lines[at], at + 1
        if not line.strip():
            at += 1
        elif m := re.match(r"^\s{0,3}(`{3,}|~{3,})\s*(\S*)", line):
            end = next((k for k in range(at + 1, len(lines)) if lines[k].strip().startswith(m[1])), len(lines))
            out.append((first, "fence", 0, m[2], "\n".join(lines[at + 1 : end])))
            at = end + 1
        elif line.strip().startswith("$$"):
            end = at if line.strip().endswith("$$") and len(line.strip()) > 3 else next((k for k in range(at + 1, len(lines)) if lines[k].strip().endswith("$$")), len(lines) - 1)
            out.append((first, "math", 0, "", "\n".join(lines[at : end + 1]).strip().strip("$").strip()))
            at = end + 1
        elif line.lstrip().startswith("<!--"):
            end = next((k for k in range(at, len(lines)) if "-->" in lines[k]), len(lines) - 1)
            out.append((first, "html_comment", 0, "", "\n".join(lines[at : end + 1])))
            at = end + 1
        elif m := re.match(r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            out.append((first, "heading", len(m[1]), "", m[2]))
            at += 1
        elif m := re.match(r"^\[\^([^\]]+)\]:\s*(.*)$", line):
            out.append((first, "footnote", 0, m[1], gather(opens)))
        elif re.match(r"^( {4}|\t)", line):
            end = at
            while end < len(lines) and (re.match(r"^( {4}|\t)", lines[end]) or not lines[end].strip()):
                end += 1
            out.append((first, "code", 0, "", "\n".join(lines[at:end]).strip()))
            at = end
        elif m := _ITEM.match(line):
            whole = gather(opens)
            out.append((first, "item", len(m[1]) // 2, "", re.sub(r"\s+", " ", _ITEM.match(whole.split("\n")[0])[2] + " " + " ".join(whole.split("\n")[1:])).strip()))
        elif "|" in line and at + 1 < len(lines) and _DELIMITER.match(lines[at + 1]) and "-" in lines[at + 1]:
            whole = gather(lambda x: "|" not in x)
            out.append((first, "table", 0, "", whole))
        elif re.match(r"^\s{0,3}(?:-\s*){3,}$|^\s{0,3}(?:\*\s*){3,}$", line):
            at += 1
        else:
            whole = gather(opens)
            out.append((first, "paragraph", 0, "", re.sub(r"^\s*>\s?", "", whole, flags=re.M)))
    return [b for b in out if not (b[1] == "paragraph" and all(_DEFINITION.match(x) for x in b[4].split("\n")))]


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line, type, level, info, text) of the Markdown of every document (doc_id, text and, if there, path); each
    begins with a row of type `doc` that has the frontmatter's title as its text and the path (or notes.md) as its info."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for d, t, p in zip(frame["doc_id"], frame["text"], frame["path"], strict=True):
                rows.append((d, -1, 0, "doc", 0, p or "notes.md", front_title(t)))
                rows += [(d, k, *b) for k, b in enumerate(blocks_of(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "line", "type", "level", "info", "text"])

    path = F.col("path") if "path" in docs.columns else F.lit("notes.md").alias("path")
    return docs.select("doc_id", "text", path).mapInPandas(run, "doc_id long, pos int, line int, type string, level int, info string, text string")


class _Walker(HTMLParser):
    """Headings and prose in document order, without navigation."""

    KEPT, OUT = {"h1", "h2", "h3", "p", "li", "blockquote"}, {"nav", "header", "footer", "aside", "button"}
    VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int | None]] = []
        self.found: list[list] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.VOID:
            return
        if tag == "p" and self.stack and self.stack[-1][0] == "p":
            self.handle_endtag("p")
        barred = tag in self.OUT or tag in ("script", "style") or ("role", "navigation") in attrs or (self.stack and self.stack[-1][1])
        place = None
        if tag in self.KEPT:
            place = len(self.found)
            self.found.append([tag, bool(barred), "", any(t == "article" for t, *_ in self.stack)])
        self.stack.append((tag, bool(barred), place))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, *_ in self.stack):
            while self.stack and self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if any(t in ("script", "style") for t, *_ in self.stack):
            return
        for *_, place in self.stack:
            if place is not None:
                self.found[place][2] += data


def outline_of(html: str | None) -> list[tuple[str, bool, bool, str]]:
    """(tag, excluded, inside an article, text) of headings and prose."""
    walker = _Walker()
    walker.feed(html or "")
    walker.close()
    return [(tag, barred, inside, re.sub(r"\s+", " ", text).strip()) for tag, barred, text, inside in walker.found]


def outline(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, excluded, in_article, text) of every page (page_id, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, k, *x) for p, h in zip(frame["page_id"], frame["html"], strict=True) for k, x in enumerate(outline_of(h))]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "tag", "excluded", "in_article", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos int, tag string, excluded boolean, in_article boolean, text string")
