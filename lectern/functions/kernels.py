"""Vectorised Python kernels for what has no built-in expression."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import patterns as P

# English number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
TENS = "twenty thirty forty fifty sixty seventy eighty ninety"
ORDINAL_ONES = "zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth"
ORDINAL_TENS = "twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth"
SCALES = {"hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}

_VALUE = {w: i for words in (ONES, ORDINAL_ONES) for i, w in enumerate(words.split())}
_VALUE |= {w: 10 * i for words in (TENS, ORDINAL_TENS) for i, w in enumerate(words.split(), 2)}
_VALUE |= {w + end: n for w, n in SCALES.items() for end in ("", "th")} | {"a": 1, "an": 1}
_TOKEN = re.compile(r"\d[\d,]*(?:\.\d+)?|[a-z]+")

# Number phrases as a regular language over one letter for each token: z a word for zero, u another number word below
# a hundred, h hundred, s a larger scale, q digits that are zero, d other digits, a an article, n "and", x anything else.
# Digits open the count before a scale; an article needs a number after it, "and" a number on both sides.
_LETTERS = {w: "z" if not v else "h" if v == 100 else "s" if v > 100 else "u" for w, v in _VALUE.items()} | {"a": "a", "an": "a", "and": "n"}
_COUNT = r"(?:[zq]|n(?=[zuhsqda]))*d?(?:[zuh]|a(?=[zuhsqd])|n(?=[zuhsqda]))*"
_PHRASE = re.compile(rf"(?!n)(?=[^x]){_COUNT}(?:s{_COUNT})*")


def _number(token: str) -> Decimal:
    return Decimal(token.replace(",", "")) if token[0].isdigit() else Decimal(_VALUE[token])


def _counted(letters: str, tokens: list[str]) -> Decimal:
    """The number that words before a scale make: they add up, and hundred multiplies what is before it."""
    total = Decimal(0)
    for letter, token in zip(letters, tokens, strict=True):
        if letter == "h":
            total = (total or 1) * Decimal(100)
        elif letter != "n":
            total += _number(token)
    return total


def _worth(letters: str, tokens: list[str]) -> Decimal:
    """The value of a number phrase: each scale times the count before it (one, if there is none), and what follows."""
    total, at = Decimal(0), 0
    for m in re.finditer("s", letters):
        total += (_counted(letters[at : m.start()], tokens[at : m.start()]) or 1) * _number(tokens[m.start()])
        at = m.end()
    return total + _counted(letters[at:], tokens[at:])


def number_forms_of(text: str | None) -> list[str]:
    """The digit forms of every English number phrase; every token may begin one."""
    tokens, forms = _TOKEN.findall((text or "").lower()), set()
    kind = lambda t: _LETTERS.get(t, "x") if not t[0].isdigit() else "d" if t.strip("0,.") else "q"
    letters = "".join(map(kind, tokens))
    for at in range(len(tokens)):
        found = _PHRASE.match(letters, at)
        if not found or found.end() == at:
            continue
        end = found.end()
        value = _worth(found[0], tokens[at:end])
        whole = value == value.to_integral_value()
        name = str(int(value)) if whole else f"{value.normalize():f}"
        percent = tokens[end : end + 1] == ["percent"] or tokens[end : end + 2] == ["per", "cent"]
        forms |= ({name} if whole else set()) | ({f"{name}%"} if percent else set())
    return sorted(forms)


@F.pandas_udf(T.ArrayType(T.StringType()))
def number_forms(text: pd.Series) -> pd.Series:
    return text.map(number_forms_of)


def cache_key_of(engine: str, model: str, voice: str, style: str, speed: float, sample_rate: int, text: str) -> str:
    """SHA-256 of the canonical JSON of a synthesis request: sorted keys, no blanks, non-ASCII escaped."""
    facts = {"v": 1, "engine": engine, "model": model, "voice": voice, "style": style, "speed": speed, "sample_rate": sample_rate, "text": text}
    return hashlib.sha256(json.dumps(facts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def cache_key(engine: pd.Series, model: pd.Series, voice: pd.Series, style: pd.Series, speed: pd.Series, rate: pd.Series, text: pd.Series) -> pd.Series:
    rows = zip(engine, model, voice, style, speed.astype(float), rate.astype(int), text, strict=True)
    return pd.Series([cache_key_of(e, m, v, s, float(p), int(r), t or "") for e, m, v, s, p, r, t in rows])


def match_form_of(text: str | None) -> str:
    """A line's form for comparison: NFKC, case folded, without list or heading marks, decoration and link targets."""
    out = unicodedata.normalize("NFKC", text or "").casefold()
    out = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", out)
    out = re.sub(r"(?:\*\*|__|\*|_|~~|`+)", "", out)
    out = re.sub(r"^\s*(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+)", "", out)
    return re.sub(r"\s+", " ", out).strip()


@F.pandas_udf(T.StringType())
def match_form(text: pd.Series) -> pd.Series:
    return text.map(match_form_of)


_LEFTOVERS = [(kind, re.compile(pattern), kept) for kind, pattern, kept in P.LEFTOVERS]


def without_markup(text: str | None) -> tuple[str, list[str]]:
    """A text without leftover markup, and the kinds that were found. Emphasis nests, so it is removed until none is left."""
    out, kinds = text or "", []
    for kind, pattern, kept in _LEFTOVERS:
        out, hits = pattern.subn(kept, out)
        kinds += [kind] if hits else []
        while hits and kind == "emphasis":
            out, hits = pattern.subn(kept, out)
    return re.sub(r"[ \t]{2,}", " ", out).strip(), kinds


@F.pandas_udf(T.StructType().add("text", "string").add("touched", "string"))
def cleaned_markup(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(c, ",".join(t)) for c, t in text.map(without_markup)], columns=["text", "touched"])


@F.pandas_udf(T.ArrayType(T.StructType().add("text", "string").add("touched", "string")))
def cleaned_all(texts: pd.Series) -> pd.Series:
    """`cleaned_markup` of every text of an array."""
    return texts.map(lambda row: [{"text": c, "touched": ",".join(t)} for c, t in map(without_markup, () if row is None else row)])
