"""License scan: Dice coefficient over word bigrams between text units and licence templates.

Built-in DataFrame functions only.  A text is normalised (lower case, everything but letters, digits,
line ends and sentence ends to spaces) and cut into units at five levels: sentences within a line, sentences wrapped over
lines, lines, paragraphs (parted by blank lines) and the whole text; equal units of a text count once.  The Dice coefficient
of a unit and a template is ``2 * common / (a + b)`` over their different word bigrams.

**Windows** (``embedded``).  A notice inside other prose may be diluted in every unit.  Where no unit of a document reaches the threshold with
any template of a licence, the stretches of as many words as the template that hold one of its anchors (below) are units too.

**Size bounds.**  As ``common <= min(a, b)``, a coefficient of at least ``t`` needs ``a`` between ``b * t / (2 - t)`` and
``b * (2 - t) / t``.  Documents without any word of the templates' anchors go before they are cut into units, units with too few
separators before their words are cut, and units without one of the anchors (the same counting shows that they cannot reach ``t``) before they are compared; each other unit is compared
with just the templates whose bounds hold its bigram count.

The templates are a small table of the caller's, checked to have at most ``MAX_TEMPLATES`` rows; they become
literals of the plan, so nothing is joined or shuffled but the best match per document and licence, which is found
inside the row.

Nulls and odd input: a null text is empty and matches nothing; null ids and repeated rows are scanned like any
other row; templates of under two words are refused; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainrules.llm.common import doc_columns

THRESHOLD = 0.8
MAX_TEMPLATES = 1000

# Public licence notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ),
}

#: Words that are no help in telling licence notices from other texts; any list gives the same matches.
COMMON = set("a an and any are be by for from if in is it may not of on or that the this to under use with work you".split())

WINDOWS = "array<struct<license_id:string,dice:double,unit:string>>"

_SENTENCE_END = "\u001e"
_PARTING = "[ \n\u001e]+"


def normalised(text: Column) -> Column:
    """Lower case, words parted by single spaces or line ends, sentence ends as a control character."""
    ended = F.regexp_replace(F.lower(text), r"[.!?]+([ \n])", _SENTENCE_END + "$1")
    return F.regexp_replace(ended, r"[^\p{L}\p{N}\n" + _SENTENCE_END + "]+", " ")


def words_of(unit: Column) -> Column:
    return F.filter(F.split(unit, _PARTING), lambda w: w != "")


def all_bigrams_of(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def bigrams_of(words: Column) -> Column:
    return F.array_distinct(all_bigrams_of(words))


def once(value: Column) -> Column:
    """The value as a generator's only row: computed once, however often later steps use it."""
    return F.explode(F.array(value))


def template_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    """The different bigrams of a template, in order: the driver's form of ``bigrams_of(words_of(normalised(...)))``."""
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach the threshold with a template of ``n``."""
    fits = [a for a in range(1, int(n * (2 - threshold) / threshold) + 2) if 2 * min(a, n) >= threshold * (a + n) - 1e-9]
    return fits[0], fits[-1]


def anchors(grams: list[str], threshold: float) -> list[str]:
    """Bigrams of a template of which every unit that reaches the threshold holds at least one.

    Such a unit shares ``need`` bigrams or more, so it cannot miss all of any ``len(grams) - need + 1``; those with
    the rarest words, as far as can be told without a corpus, are taken.
    """
    least = size_bounds(len(grams), threshold)[0]
    need = math.ceil(threshold * (least + len(grams)) / 2 - 1e-9)
    order = sorted(grams, key=lambda g: (rarer_word(g) in COMMON or rarer_word(g).isdigit(), -max(map(len, g.split())), g))
    return order[: len(grams) - need + 1]


def rarer_word(bigram: str) -> str:
    """The word of a bigram that texts hold less often: not a common one, and the longer one."""
    return max(bigram.split(), key=lambda w: (w not in COMMON and not w.isdigit(), len(w)))


def _list(values: list[str]) -> Column:
    return F.split(F.lit("\n".join(values)), "\n")


def windows(form: Column, words: Column, grams: Column, hits: Column, threshold: float) -> Column:
    """``license_id, dice, unit`` of the stretches of ``form.n`` words around its anchors that reach the threshold.

    ``grams`` are all bigrams of the words in order; ``hits`` the places, from 1, of those that are an anchor of any template.
    """
    own = F.filter(hits, lambda p: F.array_contains(form["anchors"], F.element_at(grams, p)))
    starts = F.array_distinct(F.flatten(F.transform(own, lambda p: F.sequence(F.greatest(F.lit(1), p - form["n"] + 2), p))))

    def match(s: Column) -> Column:
        inside = F.array_distinct(F.slice(grams, s, form["n"] - 1))
        dice = 2.0 * F.size(F.array_intersect(inside, form["grams"])) / (F.size(inside) + F.size(form["grams"]))
        return F.struct(dice.alias("dice"), s.alias("s"))

    reached = F.filter(F.transform(starts, match), lambda m: m["dice"] >= threshold)
    return F.transform(reached, lambda m: F.struct(form["license_id"].alias("license_id"), m["dice"].alias("dice"), F.array_join(F.slice(words, m["s"], form["n"]), " ").alias("unit")))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, embedded: bool = False) -> DataFrame:
    """``doc_id, license_id, dice, unit`` per document and licence with a unit of Dice ``threshold`` or more.

    ``dice`` is the best coefficient, rounded to six digits; ``unit`` the normalised words of the best unit (of equal
    ones the last in text order).  ``templates`` are pairs of licence id and text.  ``embedded`` adds the windows.
    """
    if templates is None:
        templates = [(k, t) for k, ts in TEMPLATES.items() for t in ts]
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    grams = [(k, template_bigrams(t)) for k, t in templates]
    if not grams or any(not g for _, g in grams):
        raise ValueError("a template needs at least two words")
    bounds = [size_bounds(len(g), threshold) for _, g in grams]
    least, most = min(b[0] for b in bounds), max(b[1] for b in bounds)

    text = normalised(F.col("text"))
    units = F.array_distinct(F.concat(
        F.split("norm", "[\n" + _SENTENCE_END + "]"), F.split(F.regexp_replace("norm", "\n[ \n]*\n", _SENTENCE_END), _SENTENCE_END), F.split("norm", "\n"), F.split("norm", "\n[ \n]*\n"), F.array("norm")
    ))
    separators = F.length("unit") - F.length(F.translate(F.col("unit"), " \n" + _SENTENCE_END, ""))
    rare = sorted({a for _, g in grams for a in anchors(g, threshold)})
    rare_words = sorted({rarer_word(g) for g in rare})
    # A document without any of these words holds no unit that could match; only the others are cut into units.
    flat = F.concat(F.lit(" "), F.translate(F.col("norm"), "\n" + _SENTENCE_END, "  "), F.lit(" "))
    holds = flat.rlike(" (?:" + "|".join(map(re.escape, rare_words)) + ") ")
    forms = F.array(*[
        F.struct(F.lit(k).alias("license_id"), F.lit(len(template_words(t))).alias("n"), _list(anchors(g, threshold)).alias("anchors"), _list(g).alias("grams"))
        for (k, t), (_, g) in zip(templates, grams, strict=True)
    ])
    hits = F.filter(F.transform("all_grams", lambda g, i: F.when(g.isin(rare), i + 1)), lambda p: p.isNotNull())
    found = F.flatten(F.transform(forms, lambda t: windows(t, F.col("all_words"), F.col("all_grams"), F.col("hits"), threshold)))
    is_window = F.col("found").isNotNull()
    cut = (
        doc_columns(docs)
        .select("doc_id", once(text).alias("norm"))
        .where(holds)
        .select("doc_id", "norm", once(words_of(F.col("norm"))).alias("all_words"))
        .select("doc_id", "norm", "all_words", once(all_bigrams_of(F.col("all_words"))).alias("all_grams"))
        .select("doc_id", "norm", "all_words", "all_grams", once(hits if embedded else F.array().cast("array<int>")).alias("hits"))
        .select("doc_id", "norm", once(F.when(F.size("hits") > 0, found)).alias("windows"))
        # A row for each unit, and one for the windows of the document.
        .select("doc_id", F.col("windows").alias("all_windows"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), units)).alias("at", "unit"))
        .select("doc_id", "unit", F.when(F.col("at") == 0, F.coalesce("all_windows", F.array().cast(WINDOWS))).alias("found"))
        .where(is_window | (separators >= least))
        .select("doc_id", "found", once(words_of(F.col("unit"))).alias("words"))
        .where(is_window | (F.size("words") > least) & F.exists("words", lambda w: w.isin(rare_words)))
        .select("doc_id", "found", "words", once(bigrams_of(F.col("words"))).alias("grams"))
        .where(is_window | F.size("grams").between(least, most) & F.exists("grams", lambda g: g.isin(rare)))
    )
    size = F.size("grams")
    scores = []  # a template's bigrams are one folded literal, which keeps the plan small
    for (license_id, g), (lo, hi) in zip(grams, bounds, strict=True):
        common = F.size(F.array_intersect("grams", F.split(F.lit("\n".join(g)), "\n")))
        dice = F.when(size.between(lo, hi), 2.0 * common / (size + len(g)))
        scores.append(F.struct(F.lit(license_id).alias("license_id"), dice.alias("dice")))
    of_units = F.transform(
        F.filter(F.array(*scores), lambda s: s["dice"] >= threshold),
        lambda s: F.struct(s["license_id"].alias("license_id"), s["dice"].alias("dice"), F.array_join("words", " ").alias("unit")),
    )
    matches = (
        cut.select("doc_id", (~is_window).alias("is_unit"), F.explode(F.when(is_window, F.col("found")).otherwise(of_units)).alias("m"))
        .groupBy("doc_id", "m.license_id")
        .agg(F.max(F.struct("is_unit", "m.dice", "m.unit")).alias("best"))
    )
    return matches.select("doc_id", "license_id", F.round("best.dice", 6).alias("dice"), "best.unit")
