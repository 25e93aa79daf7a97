"""Mixing of sources to target weights by weighted sampling without
replacement (Efraimidis and Spirakis).

Every document draws a uniform number and divides its exponential by its
quality weight; the smallest keys come first. A source whose target is a
multiple of its size takes all of its documents that many times (whole epochs)
and fills the rest in key order, up to the budget. That order is never sorted
as a whole: quantiles of the keys cut each source into bins, the bin in which
the budget runs out is known from their sums, and only that bin is sorted, to
find the last key that is taken. The documents are then marked where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import staged

BINS = 256
BROADCAST_SOURCES = 100_000
WORD = r"[^\\x20\\x09-\\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.expr(f"coalesce(regexp_count({text}, '{WORD}'), 0)").cast("bigint")


def letter_share(text: str = "text") -> Column:
    """A plain quality weight: the share of letters, 0.05 at least."""
    rest = F.length(F.regexp_replace(text, r"\p{L}+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(1 - rest / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)))


def sampling_key(weight: Column, seed: int) -> Column:
    """``-ln(u) / weight`` with ``u`` in (0, 1) from the MD5 of seed, id and text."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return -F.log(u) / weight


def targets(sources: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Add ``target`` to ``sources`` (``source``, ``source_size``). Sources in
    code-point order, null last, weigh ``weights``, repeating. A target that
    would pass ``max_epochs`` sizes stops there, and the excess goes to the
    others by weight: ``target = least(cap, level * weight)``."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.select(
        "source",
        "source_size",
        F.element_at(listed, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).alias("w"),
        (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap"),
        F.sum("source_size").over(everything).cast("double").alias("total"),
    )
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (F.col("total") - below) / rest)
    free = F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level"))
    level = F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("w")))
    return levels.select("source", "source_size", target.alias("target"))


def _with_source(df: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    table = table.withColumnRenamed("source", "source_")
    table = F.broadcast(table) if small else table
    return df.join(table, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")


class Mix:
    """The decisions for a table of documents: per source its size, target,
    whole epochs and the last key that the rest takes. ``mark`` applies them."""

    def __init__(self, docs: DataFrame, weights, quality: Column, max_epochs: int, seed: int):
        self.key, self.size = sampling_key(quality, seed), word_count()
        self.drawn = staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", self.size.alias("size"), self.key.alias("key")), "mix-keys")
        quantiles = [k / BINS for k in range(1, BINS)]
        sources = self.drawn.groupBy("source").agg(F.sum("size").alias("source_size"), F.percentile_approx("key", quantiles, 10_000).alias("splits"))
        sources = staged(sources, "mix-sources")
        self.small = sources.count() <= BROADCAST_SOURCES
        plan = targets(sources.drop("splits"), weights, max_epochs)
        epochs = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0)) + 1e-9), F.lit(0))
        plan = plan.withColumn("epochs", epochs.cast("bigint"))
        plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        plan = staged(plan, "mix-targets")

        splits = _with_source(self.drawn, sources.select("source", "splits"), self.small)
        binned = splits.select("source", "size", "key", F.expr("size(filter(splits, x -> x < key))").alias("bin"))
        sums = binned.groupBy("source", "bin").agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sums = _with_source(sums.withColumn("upto", F.sum("n").over(upto)), plan.select("source", "rest"), self.small)
        full = sums.withColumn("before", F.col("upto") - F.col("n"))
        # the bin in which the budget runs out; none if all of the source fits
        edge = full.where("before < rest AND upto >= rest").groupBy("source").agg(F.min_by(F.struct("bin", "before", "rest"), "bin").alias("e"))
        edge = edge.select("source", F.col("e.bin").alias("edge"), F.col("e.before").alias("taken_before"), F.col("e.rest").alias("rest"))
        edge = staged(edge, "mix-edges")
        inside = _with_source(binned, edge, self.small).where("bin = edge")
        same_key = inside.groupBy("source", "key", "edge", "taken_before", "rest").agg(F.sum("size").alias("size"))
        running = F.sum("size").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
        reached = same_key.withColumn("before", F.col("taken_before") + running - F.col("size"))
        last = reached.where("before + size / 2 <= rest").groupBy("source").agg(F.max("key").alias("in_edge"))
        floor = _with_source(binned, edge.select("source", "edge"), self.small).where("bin < edge")
        floor = floor.groupBy("source").agg(F.max("key").alias("below"))
        cut = _with_source(_with_source(edge.select("source"), last, self.small), floor, self.small)
        cut = cut.select("source", F.coalesce("in_edge", "below", F.lit(-1.0)).alias("cut"))
        self.plan = staged(_with_source(plan, cut, self.small), "mix-plan")

    def mark(self, df: DataFrame, key: str) -> DataFrame:
        """Add ``source_size``, ``target`` and ``copies`` to rows with a source and a key."""
        rest = F.when(F.col("rest") <= 0, 0).when(F.col("cut").isNull(), 1).otherwise((F.col(key) <= F.col("cut")).cast("int"))
        marked = _with_source(df, self.plan, self.small)
        return marked.withColumn("copies", (F.col("epochs") + rest).cast("bigint")).drop("epochs", "rest", "cut")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    quality: Column | None = None,
    max_epochs: int = 3,
    seed: int = 17,
) -> DataFrame:
    """How often a mix takes each of ``docs`` (``doc_id``, ``text``, ``source``).

    The size of a document is its number of words. All sizes together are
    shared among the sources by ``weights``; no source gives more than
    ``max_epochs`` times its size (see ``targets``). Returns ``doc_id``,
    ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies
    times size). A document is taken whole, the last one if more than half of
    it fits. Null texts have size 0, a null source is a source of its own.
    Rows with equal id and text draw equal keys and are taken together. Reruns
    give the same mix. An empty table gives an empty result; other columns are
    ignored. ``quality`` must be positive (default: share of letters).
    """
    mix = _mix(docs, weights, quality, max_epochs, seed)
    marked = mix.mark(mix.drawn, "key")
    return marked.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights=(1, 2, 3), quality: Column | None = None, max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    mix = _mix(docs, weights, quality, max_epochs, seed)
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    rows = docs.withColumnsRenamed(names).withColumn("draw_key", mix.key)
    marked = mix.mark(rows, "draw_key").where("copies > 0")
    repeated = marked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select([F.col(names.get(c, c)).alias(c) for c in docs.columns])


def _mix(docs, weights, quality, max_epochs, seed) -> Mix:
    if not weights or min(weights) <= 0 or max_epochs < 1:
        raise ValueError("positive weights and max_epochs are needed")
    return Mix(docs, tuple(weights), letter_share() if quality is None else quality, max_epochs, seed)
