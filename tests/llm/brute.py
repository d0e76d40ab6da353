"""Plain single-threaded models that the operators are held against."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TERM = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(LOW))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def pii(text: str | None) -> list[tuple[int, int, int, str, str]]:
    out = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind, m[0]))
    return sorted(out)


def disclosing(texts: list[str | None], reach: int, support: int, disclosure: float) -> set[str]:
    total = len(texts)
    n_e, n_t, n_et = Counter(), Counter(), Counter()
    for text in texts:
        text = text or ""
        n_t.update(set(TERM.findall(text.lower())))
        spans, near = pii(text), defaultdict(set)
        for start, _, end, kind, value in spans:
            a, b = text[max(0, start - reach) : start], text[end : end + reach]
            if start > reach:
                a = re.sub(r"^[^\W_]+", "", a)
            if end + reach < len(text):
                b = re.sub(r"[^\W_]+$", "", b)
            for pattern in PII.values():
                a, b = pattern.sub(" ", a), pattern.sub(" ", b)
            near[kind, value].update(t for t in TERM.findall((a + " " + b).lower()) if len(t) > 2)
        n_e.update(near.keys())
        for e, terms in near.items():
            n_et.update((e, t) for t in terms)
    out = set()
    for (e, t), n in n_et.items():
        if n >= support and n_e[e] < total and math.log(total * n / (n_e[e] * n_t[t])) / math.log(total / n_e[e]) >= disclosure - 1e-9:
            out.add(t)
    return out


def all_spans(text: str | None, terms: set[str]) -> list[tuple[int, int, int, str, str]]:
    base = pii(text)
    more = [
        (m.start(), 4, m.end(), "term", m[0])
        for m in TERM.finditer(text or "")
        if m[0].lower() in terms and not any(b[0] < m.end() and m.start() < b[2] for b in base)
    ]
    return sorted(base + more)


def rendered(spans: list[tuple[int, int, int, str, str]]) -> str:
    return ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)


def contaminated(documents: list[str | None], items: list[tuple[object, str | None]]) -> list[tuple[int, int, list[str]]]:
    windows: dict[tuple[str, ...], set[str]] = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if w and item is not None else []:
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    sizes, out = {len(w) for w in windows}, []
    for text in documents:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= got
        out.append((len(w), len(hit), sorted(found)))
    return out


def near_classes(rows: list[tuple[int, str | None]], threshold: float = 0.8) -> list[tuple[int, int, int]]:
    """(doc_id, class_id, n_links) of every row, by comparing all pairs of rows."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if a and b and 10 * len(a & b) >= 10 * threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, least[find(i)], links[i]) for i, (doc, _) in enumerate(rows)]
