"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Every source gets a share of the wanted words in proportion to its weight. A source whose share exceeds `max_epochs` times its
own words is clamped there, and what it cannot give is shared again by weight among the others, until no share exceeds its
clamp. A source's target is then met exactly (to the word): every document is repeated floor(target / size) whole times, and
the rest is taken from documents in the order of md5(seed:doc_id), whole ones until the last, of which only a part is taken.

Null texts have size 0 and take nothing. A null source is a source of its own, the last. Sources without words get target 0.
Repeated rows are rows of their own; equal ids are ordered by size, so reruns agree on every row's values. Texts of any length are
counted whole. An empty table gives no rows. Extra columns pass through; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered

WEIGHTS = (5, 2, 1)
SEED = 17
#: Documents of a source are put in order in so many slices of their md5, so no source is sorted in one task.
SLICE_DIGITS = 3


def words_in(text):
    """Number of `[^\\x20\\x09-\\x0D]+` in a text, 0 for null: its length less that with every word's first character gone."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.regexp_replace(t, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]", ""))).cast("long")


def fill(sizes: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """sizes(source_size, weight, ...) with target. Each round is one aggregate; rounds end when no further source is clamped."""
    total = float(sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    clamp = F.col("source_size") * F.lit(float(max_epochs))
    level = 0.0
    # The level only rises, so the clamped sources are those whose clamp lies below weight * level.
    while True:
        held = clamp <= F.col("weight") * F.lit(level)
        row = sizes.agg(
            F.coalesce(F.sum(F.when(held, clamp)), F.lit(0.0)).alias("given"),
            F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0)).alias("weights"),
        ).first()
        if not row["weights"]:
            return sizes.withColumn("target", clamp)
        new = max(0.0, total - row["given"]) / float(row["weights"])
        if new <= level:
            return sizes.withColumn("target", F.when(held, clamp).otherwise(F.col("weight") * F.lit(level)))
        level = new


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: int = SEED,
        source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs (without text) with size, source_size, target, taken, copies (whole repetitions) and part (words of a further one)."""
    made = {"size", "source_size", "target", "taken", "copies", "part", text}
    rest = [f"`{c}`" for c in docs.columns if c not in made]
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(f"`{doc_id}`").cast("string")).cast("binary"))
    sized = cut(docs.select(*rest, words_in(F.col(f"`{text}`")).alias("size"), order.alias("__o")))
    src, cell = F.col(f"`{source}`"), F.substring("__o", 1, SLICE_DIGITS)
    # One row for each source and slice; from here on the small table stands for the documents.
    cells = cut(sized.groupBy(src.alias("__s"), cell.alias("__c")).agg(F.sum("size").alias("n")))
    sources = numbered(cells.groupBy("__s").agg(F.sum("n").alias("source_size")), [F.col("__s").asc_nulls_last()])
    pick = F.get(F.array(*map(F.lit, weights)), F.col("rank").cast("int") % len(weights))
    sources = fill(cut(sources.withColumn("weight", pick)), share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("__w", whole).withColumn("__x", F.round(F.col("target") - F.col("__w") * F.col("source_size")).cast("long"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__s").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lots = sources.withColumnRenamed("__s", "__t").select("__t", "source_size", "target", "__w", "__x")
    cells = cells.withColumn("__b", before).join(lots, F.col("__s").eqNullSafe(F.col("__t"))).drop("__t", "n")
    # A source's documents are spread over its slices, so this join has no hot key however large the source.
    cells = cells.withColumnRenamed("__c", "__d")
    near = sized.withColumn("__c", cell).join(cells, (F.col("__c") == F.col("__d")) & src.eqNullSafe(F.col("__s")))
    run = F.sum("size").over(Window.partitionBy("__s", "__c").orderBy("__o", f"`{doc_id}`", "size").rowsBetween(Window.unboundedPreceding, -1))
    left = F.col("__x") - F.col("__b") - F.coalesce(run, F.lit(0))
    more = F.least(F.greatest(left, F.lit(0)), F.col("size"))
    out = near.withColumn("__m", more).withColumn("copies", F.col("__w") + F.when((F.col("__m") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0))
    out = out.withColumn("part", F.when(F.col("__m") < F.col("size"), F.col("__m")).otherwise(0))
    return out.withColumn("taken", F.col("__w") * F.col("size") + F.col("__m")).select(*rest, "size", "source_size", "target", "taken", "copies", "part")


def repeat(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of docs, as often as `mix` takes them whole (a part of more than half a document counts as one).

    mix() leaves texts out of its tables, so they are joined back by id; of rows with one id each is repeated alike. Rows without an
    id are told apart by source and text (a hash of it), so that they aren't one hot key.
    """
    doc_id, source, text = (how.get(k, k) for k in ("doc_id", "source", "text"))
    n = F.col("copies") + F.when(2 * F.col("part") > F.col("size"), 1).otherwise(0)
    tell = lambda df: F.when(df[f"`{doc_id}`"].isNull(), F.xxhash64(df[f"`{source}`"], df[f"`{text}`"])).otherwise(F.lit(0))
    own = docs.select(*dict.fromkeys((doc_id, source, text)))
    times = mix(own.withColumn("__h", tell(own)), **how)
    times = times.groupBy(F.col(f"`{doc_id}`").alias("__k"), "__h").agg(F.max(n).cast("int").alias("__n"))
    same = docs[f"`{doc_id}`"].eqNullSafe(times["__k"]) & (tell(docs) == times["__h"])
    joined = docs.join(times.where("__n > 0"), same)
    return joined.withColumn("__r", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__k", "__h", "__n", "__r")
