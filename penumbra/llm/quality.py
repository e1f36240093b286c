"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

#: Frequent function words of the languages served.
STOP_WORDS = {
    "en": "the and of to in a is that it for on with be this are from by an was or".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split(),
    "fr": "de la le et les des en un du une est pour que dans par sur au avec ce il".split(),
    "es": "de la que el en y los del se las por un para con no una su al es lo".split(),
}
#: Characters that count as symbols, and marks that open a list line.
SYMBOLS = "#*$%&|<>"
BULLETS = ("-", "*", "•", "‣", "·")

#: measure, comparison that rejects, limit. A document fails if any line holds; measures of nothing are 0.
RULES = [
    ("n_words", "<", 50),
    ("repeat_share", ">", 0.5),
    ("mean_word_chars", "<", 2.0),
    ("mean_word_chars", ">", 15.0),
    ("symbol_ratio", ">", 0.1),
    ("dup_line_share", ">", 0.5),
    ("bullet_line_share", ">", 0.9),
    ("ellipsis_line_share", ">", 0.3),
    ("n_stop_words", "<", 2),
]
#: A share measure: its part and its whole.
SHARES = {
    "repeat_share": ("n_repeat_words", "n_words"),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "bullet_line_share": ("n_bullet_lines", "n_lines"),
    "ellipsis_line_share": ("n_ellipsis_lines", "n_lines"),
}


def repeat_words(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more in the array, each word counted once.

    Windows are sorted by their fingerprint, so equal ones are neighbours; the positions of those
    with an equal neighbour are put in order and the lengths of the merged spans are summed.
    Windows compare by two independent fingerprints, of 64 and of 32 bits.
    """

    def fingerprints(w):
        # Each window carries its place, so the sorted array still knows where it came from.
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), F.hash(w[i + 2], w[i + 1], w[i]).alias("g"), i.alias("p"))))

    def equal(a, b):
        return (a["h"] == b["h"]) & (a["g"] == b["g"])

    def positions(s):
        last = F.size(s) - 1
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.when(i > 0, equal(F.get(s, i - 1), x)).otherwise(False) | F.when(i < last, equal(F.get(s, i + 1), x)).otherwise(False)), lambda x: x["p"]))

    def covered(p):
        n = F.size(p)
        return F.aggregate(F.transform(p, lambda x, i: F.when(i == n - 1, 3).otherwise(F.least(F.lit(3), F.get(p, i + 1) - x))), F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) < 4, 0).otherwise(let(let(fingerprints(words), positions), covered)).cast("long")


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Integer counts that all rules derive from."""
    stop = {w for ws in STOP_WORDS.values() for w in ws}
    stop = sorted(stop | {w.capitalize() for w in stop})
    plain = F.regexp_replace(text, "[" + SYMBOLS + "]+", "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(plain)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: reduce(lambda a, b: a | b, [F.startswith(F.ltrim(x), F.lit(m)) for m in BULLETS]))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.endswith(F.rtrim(x), F.lit("...")) | F.endswith(F.rtrim(x), F.lit("…")))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stop))).cast("long"),
        "n_repeat_words": repeat_words(words),
    }


def verdict(get=F.col, rules=None) -> Column:
    """The threshold table as one boolean: true if no rule rejects. ``get`` finds a measure's column."""
    compare = {"<": lambda a, b: a < b, ">": lambda a, b: a > b}

    def value(name):
        if name not in SHARES:
            return get(name)
        part, whole = SHARES[name]
        return F.coalesce(get(part) / F.nullif(get(whole), F.lit(0)), F.lit(0.0))

    rejects = [compare[op](value(name), F.lit(limit)) for name, op, limit in (RULES if rules is None else rules)]
    return ~reduce(lambda a, b: a | b, rejects, F.lit(False))


def base_failed(get=F.col) -> Column:
    """The base rules, on integers."""
    return (get("n_words") < 50) | (100 * get("n_repeat_words") > 50 * get("n_words"))


def judged(text: Column) -> Column:
    """All measures of a text as one struct; words and lines are split once for all of them."""
    whole = F.coalesce(text.cast("string"), F.lit(""))

    def arrays(t):
        lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
        return F.struct(t.alias("t"), words_of(t).alias("w"), lines.alias("l"))

    def counts(a):
        return F.struct(*(c.alias(k) for k, c in measures(a["t"], a["w"], a["l"]).items()))

    return let(let(whole, arrays), counts)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=None) -> DataFrame:
    """Measures and verdict of every row, in one narrow pass.

    A null or blank text has no words and no lines, fails the base rule and is not kept. Lines are
    split at \\n; a line without a word is no line; a line equal to an earlier one is a duplicate.
    Repeated rows are judged alike; null ids stay; other columns are not read, so their names don't matter.
    """
    m = docs.select(docs[id_col].alias("_id"), judged(docs[text_col]).alias("_m")).select("_id", "_m.*")
    base = base_failed()
    return m.select(F.col("_id").alias(id_col), *(c for c in m.columns if c != "_id"), base.alias("base_failed"), (~base & verdict(rules=rules)).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", rules=None) -> DataFrame:
    """The rows whose text passes all rules, with the columns they came with, whatever their names."""

    def good(m):
        return ~base_failed(m.getField) & verdict(m.getField, rules)

    return docs.where(let(judged(docs[text_col]), good))
