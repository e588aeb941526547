"""Quality rules, line first (operator 1): built-in functions only.

Every line is held against rules on punctuation, navigation and boilerplate; lines that fail go; a document that loses
too much of its text goes too. Base figures (repeated windows, symbols, repeated lines) come from the whole text.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: White space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: What a line of prose ends with, closing quotes and brackets aside.
LINE_END = [".", "!", "?", ":", ";", ",", "…", "。", "！", "？", "；", "：", "،", "؟", "।"]
CLOSING = "\"'”’»)]}"
#: Marks of shouting and of symbol noise, and those that separate the entries of a menu.
NOISE_MARKS, MENU_MARKS = "!*#$%&<=_", "|>»›•·"
#: Phrases of boilerplate lines, lower case.
BOILERPLATE = ["cookie", "javascript", "terms of", "privacy policy", "rights reserved", "copyright", "licensed under", "lorem ipsum", "click here"]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _chars(text: Column) -> Column:
    """Code points that aren't white space."""
    return F.length(F.regexp_replace(text, SPACE, ""))


def _repeat_words(words: Column, window: int) -> Column:
    """Words that lie in a window of that many words found twice or more, the first one included.

    Window hashes, built by doubling, show whether any two windows can be equal. Only then are they sorted: neighbours
    with equal hashes are held against each other word by word, and if one such pair differs the windows themselves are
    sorted. A start covers the words before the next one, at most window.
    """
    if window != 8:
        raise ValueError("the doubling is for windows of eight words")

    def doubled(h: Column, step: int) -> Column:
        return F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))

    def twins(s: Column) -> Column:
        return F.filter(s, lambda x, k: (x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]))

    def covered(twin: Column) -> Column:
        def steps(at: Column) -> Column:
            widths = F.zip_with(at, F.slice(at, 2, F.size(at) + 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
            return F.aggregate(widths, F.lit(0), lambda x, y: x + y)

        return let(F.sort_array(F.transform(twin, lambda x: x["i"])), steps)

    def by_text(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.struct(F.array_join(F.slice(w, i, window), " ").alias("g"), i.alias("i")))
        return covered(let(F.sort_array(grams), twins))

    def by_hash(w: Column, h: Column) -> Column:
        def verified(t: Column) -> Column:
            same = lambda a, b: F.slice(w, a["i"], window) == F.slice(w, b["i"], window)
            pairs = F.zip_with(t, F.slice(t, 2, F.size(t) + 1), lambda a, b: b.isNull() | (a["g"] != b["g"]) | same(a, b))
            return F.when(F.forall(pairs, lambda x: x), covered(t)).otherwise(by_text(w))

        marked = F.transform(h, lambda x, i: F.struct(x.alias("g"), (i + 1).alias("i")))
        return let(let(F.sort_array(marked), twins), verified)

    def of(w: Column) -> Column:
        # each lambda takes one argument: a second one would be given the place in the list
        hashes = let(let(doubled(w, 1), lambda h: doubled(h, 2)), lambda h: doubled(h, 4))
        full = let(hashes, lambda h: F.slice(h, 1, F.size(w) - (window - 1)))
        return F.when(F.size(w) <= window, 0).otherwise(let(full, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(by_hash(w, h))))

    return let(words, of)


def line_passes(line: Column, marked: Column | None = None, menu_share: float = 0.2, max_marks: float = 0.3) -> Column:
    """Whether a line stays: it ends as prose does and has at most max_marks noise marks a word; it isn't a menu (two
    or more separating marks, and one for menu_share of its words); it has no boilerplate phrase. marked: whether its
    document has any such mark, which spares the lines of one that has none."""
    prose = F.right(F.rtrim(line, F.lit(" \t\n\r\x0b\x0c" + CLOSING)), F.lit(1)).isin(LINE_END)
    marks = F.regexp_replace(line, f"[^{NOISE_MARKS}{MENU_MARKS}]+", "")

    def noisy(m: Column) -> Column:
        words = F.size(F.split(line, " "))
        menu = F.length(F.translate(m, NOISE_MARKS, ""))
        return (F.length(m) > max_marks * words) | (menu >= 2) & (menu >= menu_share * words)

    boiler = let(F.lower(line), lambda x: reduce(or_, [x.contains(p) for p in BOILERPLATE]))
    passes = ~let(marks, noisy)
    return prose & (passes if marked is None else F.when(marked, passes).otherwise(True)) & ~boiler


def quality_rules(
    docs: DataFrame, text_col: str = "text", *, min_words: int = 20, window: int = 8, max_repeat: int = 30, max_loss: float = 0.5
) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs), base_failed, clean_text,
    clean_chars, kept. One row for each row of docs; a column of docs that has one of those names is replaced.

    base_failed: under min_words words, or over max_repeat per cent of the words in repeated windows. clean_text: the
    lines that pass, in their order. kept: not base_failed, and at most max_loss of the characters (white space aside)
    lie on failed lines. A null text has no words and gives clean_text "". There are no joins and no shuffles; repeated
    rows and an empty table need no case of their own.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    clash = "__strandline_"
    step = docs.withColumns(
        {f"{clash}marked": text.rlike(f"[{NOISE_MARKS}{MENU_MARKS}]"), f"{clash}words": _words(text), f"{clash}lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))}
    )
    words, lines = F.col(f"{clash}words"), F.col(f"{clash}lines")
    out = step.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": _repeat_words(words, window).cast("long"),
            f"{clash}clean": F.filter(lines, lambda x: line_passes(x, F.col(f"{clash}marked"))),
        }
    )
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    clean = F.col(f"{clash}clean")
    all_pass = F.size(clean) == F.size(lines)
    out = out.withColumns({"clean_text": F.array_join(clean, "\n"), "clean_chars": F.when(all_pass, F.col("word_chars")).otherwise(_chars(F.array_join(clean, "")).cast("long"))})
    out = out.drop(*(f"{clash}{n}" for n in ("marked", "words", "lines", "clean")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("word_chars") - F.col("clean_chars") <= max_loss * F.col("word_chars")))
