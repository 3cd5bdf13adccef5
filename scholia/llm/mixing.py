"""Mixing sources to target weights by hierarchical budgeting.

The leaves of a tree (domain, language, source) hold documents. A token budget is propagated from the root by weights. A node can't take more
than its leaves offer over the allowed epochs; what one can't take is shared among its siblings by their weights, and only what no sibling can take is felt
by the level above, because a node's capacity is the sum of its leaves'. Each level is one window over its siblings: a table of
leaves, whatever the number of documents. A leaf then takes whole epochs and a token-prefix of the next one, each in an order seeded by epoch. Running
sums are made over hash buckets first and then inside a bucket, so a leaf that holds a third of all rows is many small windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Documents in one bucket of a leaf's epoch, on average.
BUCKET = 4096
#: Rows up to which a table of leaves or buckets is broadcast; a larger one is joined by shuffle.
SMALL_TABLE = 100_000
#: Stands for a null level inside this module, so that levels join by equality.
NULL = "\0"


def fill_siblings(nodes: DataFrame, parents: list[str], node: str) -> DataFrame:
    """Divide every parent's ``budget`` among its children by ``weight``, none above its ``capacity``; adds ``quota``.

    The water level rises in order of capacity per weight: a child is full if what remains for it and all later ones, by weight, is at least its capacity.
    Children without weight get nothing.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    before = Window.partitionBy(*parents).orderBy("_ratio", node).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*parents).orderBy("_ratio", node).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parents)
    out = nodes.withColumn("_ratio", ratio)
    out = out.withColumn("_before", F.coalesce(F.sum("capacity").over(before), F.lit(0.0))).withColumn("_onward", F.sum("weight").over(onward))
    full = (F.col("weight") > 0) & (F.col("capacity") * F.col("_onward") <= (F.col("budget") - F.col("_before")) * F.col("weight"))
    out = out.withColumn("_full", full)
    taken = F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0.0)).over(whole)
    open_weight = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))).over(whole)
    share = F.when(F.col("_full"), F.col("capacity")).otherwise(F.greatest(F.lit(0.0), F.col("budget") - taken) * F.col("weight") / F.when(open_weight > 0, open_weight))
    return out.withColumn("quota", F.coalesce(share, F.lit(0.0))).drop("_ratio", "_before", "_onward", "_full")


def leaf_quotas(leaves: DataFrame, levels: list[str], weights: DataFrame | None, budget: float | Column, max_epochs: float) -> DataFrame:
    """``leaves`` (the levels, tokens) with ``quota``: tokens that each leaf gives.

    ``weights`` has path (values of the levels down to a node, joined by "/") and weight; nodes that it doesn't name weigh 1 beside their siblings.
    """
    current = leaves.withColumn("capacity", F.col("tokens") * F.lit(float(max_epochs)))
    quotas = current.select(*levels, "tokens", "capacity").withColumn("quota", F.lit(budget).cast("double"))
    for depth in range(1, len(levels) + 1):
        parents, node = levels[: depth - 1], levels[depth - 1]
        level = quotas.groupBy(*levels[:depth]).agg(F.sum("capacity").alias("capacity"), F.first("quota").alias("budget"))
        path = F.concat_ws("/", *[F.when(F.col(c) == NULL, "").otherwise(F.col(c)) for c in levels[:depth]])
        if weights is None:
            level = level.withColumn("weight", F.lit(1.0))
        else:
            named = weights.where("path is not null").groupBy("path").agg(F.max(F.greatest(F.lit(0.0), F.col("weight").cast("double"))).alias("weight"))
            level = level.withColumn("path", path).join(named, "path", "left").drop("path").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        filled = fill_siblings(level, parents or [F.lit(0)], node).select(*levels[:depth], F.col("quota").alias("_quota"))
        quotas = quotas.drop("quota").join(filled, levels[:depth]).select(*levels, "tokens", "capacity", F.col("_quota").alias("quota"))
    return quotas


def mix_sources(
    documents: DataFrame, levels: dict[str, Column], tokens: Column, budget: float | None = None, budget_share: float = 0.5, weights: DataFrame | None = None, max_epochs: int = 2, seed: int = 7, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Select documents so that the tree's leaves give tokens by their weights.

    ``levels`` names the tree's levels from the top with the columns that place a document; ``tokens`` is a document's size (null or negative: 0). The budget is
    ``budget`` tokens, or ``budget_share`` of all tokens. Returns a row for every document and epoch in which it is taken: the columns named in ``keep``,
    the levels, epoch (from 0), n_tokens, and leaf_quota. Where a kept column has such a name, the level is called ``<name>_level`` and the others ``taken_<name>``.

    A leaf's document is taken in an epoch if the tokens before it in that epoch's order lie below what the leaf still owes, so a leaf exceeds its quota by less than one
    document. Null levels are a leaf of their own. Documents without tokens cost nothing and are taken wherever their place in the order lies below the quota; repeated rows
    are documents of their own, and their order among themselves doesn't matter, as they are equal. A leaf whose documents all have no tokens has no quota and gives none. An empty table or a budget of 0 gives no rows.
    """
    names = list(levels)
    placed = documents.select(F.struct(*keep).alias("_kept"), *[F.coalesce(c.cast("string"), F.lit(NULL)).alias(f"_{n}") for n, c in levels.items()], F.greatest(F.lit(0), F.coalesce(tokens, F.lit(0))).cast("long").alias("n_tokens"), F.xxhash64(*[F.col(c) for c in keep], F.lit(seed)).alias("_key"))
    own = [f"_{n}" for n in names]
    leaves = cut(placed.groupBy(*own).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    quotas = leaf_quotas(leaves, own, weights, float(budget if budget is not None else total * budget_share), max_epochs)
    # quotas are whole tokens from here on; the number of buckets follows the leaf's rows
    plan = cut(quotas.drop("capacity", "tokens").join(leaves, own).select(*own, "tokens", F.round("quota").cast("long").alias("quota"), F.ceil(F.col("rows") / BUCKET).cast("long").alias("buckets")).where("quota > 0"))
    sizes = plan.agg(F.count("*").alias("leaves"), F.sum("buckets").alias("buckets")).first()
    few = (sizes["leaves"] or 0) <= SMALL_TABLE
    few_buckets = (sizes["buckets"] or 0) <= SMALL_TABLE  # each leaf has one epoch that isn't whole
    # an epoch is whole if the quota covers it; the last is a prefix
    epochs = F.sequence(F.lit(0), F.when(F.col("tokens") > 0, F.ceil(F.col("quota") / F.col("tokens")) - 1).otherwise(0).cast("int"))
    taken = placed.join(F.broadcast(plan) if few else plan, own).withColumn("epoch", F.explode(epochs)).withColumn("owed", F.col("quota") - F.col("epoch") * F.col("tokens"))
    whole = taken.where("owed >= tokens")
    part = taken.where("owed < tokens").withColumn("order", F.xxhash64("_key", "epoch", F.lit(seed))).withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 40), F.col("buckets")))
    sums = part.groupBy(*own, "epoch", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    ahead = Window.partitionBy(*own, "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)))
    located = part.join(F.broadcast(starts) if few_buckets else starts, [*own, "epoch", "bucket"])
    shown = [F.when(F.col(f"_{n}") != NULL, F.col(f"_{n}")).alias(n if n not in keep else f"{n}_level") for n in names]
    own_names = [F.col(c).alias(n if n not in keep else f"taken_{n}") for c, n in (("epoch", "epoch"), ("n_tokens", "n_tokens"), ("quota", "leaf_quota"))]
    out = [*[F.col("_kept")[c].alias(c) for c in keep], *shown, *own_names]
    inside = located.where("before + in_bucket <= owed")  # buckets that end below the quota need no order inside
    inner = Window.partitionBy(*own, "epoch", "bucket").orderBy("order", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = located.where("before < owed and before + in_bucket > owed").withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).where("at < owed")
    return whole.select(*out).union(inside.select(*out)).union(edge.select(*out))
