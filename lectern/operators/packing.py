"""Splitting and greedy packing of paragraphs into synthesis chunks, as ordered folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import sentences, word_count


def hard_split(text: Column, max_chars: int) -> Column:
    """Pieces of at most `max_chars`: words joined while they fit, longer words sliced."""
    cut = lambda w: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(w) - 1) / max_chars).cast("int")), lambda i: w.substr(i * max_chars + 1, F.lit(max_chars))
    )
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, w: Column) -> Column:
        trial = F.when(s["open"] == "", w).otherwise(F.concat(s["open"], F.lit(" "), w))
        closed = F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        slices = cut(w)
        split = F.struct(F.concat(closed, F.slice(slices, F.lit(1), F.size(slices) - 1)).alias("done"), F.element_at(slices, -1).alias("open"))
        return F.when(F.length(trial) <= max_chars, F.struct(s["done"].alias("done"), trial.alias("open"))).otherwise(split)

    pieces = F.aggregate(words, zero, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(text))


def fit(unit: Column, max_chars: int) -> Column:
    """A unit within `max_chars` whole, else its sentences, the longest of them split hard."""
    parts = F.flatten(F.transform(sentences(unit), lambda s: F.when(F.length(s) <= max_chars, F.array(s)).otherwise(hard_split(s, max_chars))))
    return F.when(F.length(unit) <= max_chars, F.array(unit)).when(F.size(parts) > 0, parts).otherwise(F.array(unit))


def pack(units: Column, target_words: int, max_chars: int) -> Column:
    """Chunks: units joined by a blank line until the next would exceed the words or characters allowed.

    The fold carries two numbers and the places at which chunks begin; texts are only joined at its end."""
    sizes = F.transform(units, lambda u: F.struct(word_count(u).alias("words"), F.length(u).alias("chars")))
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"), F.lit(0).alias("words"), F.lit(0).alias("chars"))

    def step(s: Column, u: Column) -> Column:
        full = (s["at"] == 0) | (s["words"] + u["words"] > target_words) | (s["chars"] + u["chars"] + 2 > max_chars)
        return F.struct(
            F.when(full, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"),
            (s["at"] + 1).alias("at"),
            (F.when(full, 0).otherwise(s["words"]) + u["words"]).alias("words"),
            (F.when(full, 0).otherwise(s["chars"] + 2) + u["chars"]).alias("chars"),
        )

    ends = lambda starts: F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(units)))
    joined = lambda a, b: F.array_join(F.slice(units, a + 1, b - a), "\n\n")
    found = F.aggregate(sizes, zero, step, lambda s: s["starts"])
    return F.when(F.size(units) > 0, F.zip_with(found, ends(found), joined)).otherwise(F.array().cast("array<string>"))


def paragraphs(text: Column) -> Column:
    """The text's lines that aren't blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: F.trim(p) != "")


def chunks(text: Column, target_words: int, max_chars: int) -> Column:
    """The packed chunks of a text whose lines are paragraphs."""
    return pack(F.flatten(F.transform(paragraphs(text), lambda p: fit(p, max_chars))), target_words, max_chars)
