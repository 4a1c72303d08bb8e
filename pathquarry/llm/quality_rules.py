"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Null and empty texts have no words: every count is 0, the base test fails, and they are not kept. Repeated rows are judged
one by one and alike; texts of any length are measured whole (a row's arrays grow with its own text only). An empty table gives no
rows. Other columns pass through (`judge` adds its own under the names in COLUMNS and replaces clashing ones).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The most common function words of English, German, French and Spanish.
STOP_WORDS = """
the of and to in is that for it was on are as with be by this from or an at which not have has but they he she we you all
der die das und ist nicht ein eine mit von zu den dem im auf für sich des auch als an es wie wird bei oder
le la les de des et un une est que pour dans qui sur pas par au aux avec il elle du en ne se ce son
el los las una y que es por con para del se no su al lo como más pero sus o
""".split()


@dataclass(frozen=True)
class Rule:
    """low <= value / base <= high, asked of documents with at least min_words words."""

    name: str
    value: str
    base: str
    low: float | None = None
    high: float | None = None
    min_words: int = 10


#: The threshold table. Symbols, stop words and shouting are shares of the words; lines are shares of the lines.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols", "n_symbols", "n_words", high=0.30),
    Rule("exclamations", "n_exclaim", "n_words", high=0.50),
    Rule("stop_words", "n_stop", "n_words", low=0.02, min_words=60),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.50),
)
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaim", "n_stop", "n_lines", "n_bullet_lines", "n_ellipsis_lines")
WINDOW = 5


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression: true if no rule is broken. Ratios are compared by products, so no division by zero."""
    ok = F.lit(True)
    for r in rules:
        v, b = F.col(r.value).cast("double"), F.col(r.base).cast("double")
        fits = F.lit(True)
        if r.low is not None:
            fits = fits & (v >= F.lit(r.low) * b)
        if r.high is not None:
            fits = fits & (v <= F.lit(r.high) * b)
        ok = ok & ((F.col("n_words") < r.min_words) | fits)
    return ok


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts in COLUMNS. Each select below is used more than once by the next, so Spark evaluates it once."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in COLUMNS]
    words = F.filter(F.split(F.col("__t"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(F.col("__t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    df = df.select(*rest, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    df = df.select("*", words.alias("__w"), lines.alias("__l"))
    n = F.size("__w")
    gram = lambda i: F.xxhash64(*[F.get(F.col("__w"), i + k) for k in range(WINDOW)])
    count = lambda chars: F.length("__t") - F.length(F.regexp_replace(F.col("__t"), f"[{chars}]+", ""))
    df = df.select(
        *rest, "__w",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        count("!").cast("long").alias("n_exclaim"),
        F.size(F.filter("__w", lambda w: w.isin(stop))).cast("long").alias("n_stop"),
        F.size("__l").cast("long").alias("n_lines"),
        F.size(F.filter("__l", lambda x: x.rlike(r"^\s*[-*•]\s"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("__l", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), gram)).alias("__g"),
    )
    counts = [F.col(c) for c in COLUMNS if c != "n_repeat_words"]
    # Windows are compared by 64-bit hashes within one text (two of n windows collide with probability n^2 / 2^65). Most texts
    # repeat none; only the others are sorted.
    again = F.size("__g") > F.size(F.array_distinct("__g"))
    df = df.select(*rest, *counts, F.when(again, F.sort_array(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("__s"))
    at = lambda j: F.get(F.col("__s"), j)
    twice = lambda j: at(j)["g"].eqNullSafe(at(j - 1)["g"]) | at(j)["g"].eqNullSafe(at(j + 1)["g"])
    spots = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("__s") - 1), twice), lambda j: at(j)["i"]))
    df = df.select(*rest, *counts, F.when(F.col("__s").isNotNull(), spots).alias("__p"))
    pos = lambda j: F.get(F.col("__p"), j)
    step = lambda a, j: a + F.least(F.lit(WINDOW), F.coalesce(pos(j + 1), pos(j) + WINDOW) - pos(j))
    covered = F.when(F.size("__p") > 0, F.aggregate(F.sequence(F.lit(0), F.size("__p") - 1), F.lit(0), step)).otherwise(0)
    return df.select(*rest, *counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the counts, base_failed and kept; nothing is dropped. A filter on `kept` makes it a filtering stage."""
    out = measure(df.drop("base_failed", "kept"), text)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumns({"base_failed": failed, "kept": ~failed & compile_rules(rules)})
