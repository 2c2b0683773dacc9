"""Mixing sources to target weights by hierarchical budgeting.

Sources hang in a tree domain - language - source. A token budget goes down it by
weights; a node can take at most its tokens times ``max_epochs``. What a full child
leaves is dealt to its siblings by weight, and goes up only when all siblings are
full. A leaf's budget is some whole epochs and a rest: the rest is the longest prefix, in
an order of its documents seeded by epoch, whose tokens fit.

Budgets are dealt level by level with windows over the nodes of a level; only the sum of all
tokens comes to the driver. The prefix is found in steps, so that a leaf with a third of
all rows isn't sorted by one task: token sums over equal ranges of the order's hash
give the one range in which the budget ends, sums over the parts of that range the one
part, and only that part's rows are ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .token_counts import with_token_counts

#: Bits of the order's hash that each step looks at; leaves that may be broadcast.
STEP_BITS, MOST_BROADCAST = 12, 100_000
#: Production weights by name or path of a node; one not named weighs 1.
WEIGHTS = {
    ("d0",): 4.0, ("d1",): 3.0, ("d2",): 2.0, ("d3",): 1.0,
    ("en",): 4.0, ("de",): 2.0, ("fr",): 2.0, ("es",): 2.0,
    ("src0",): 2.0, ("src9",): 0.5, ("src13",): 0.5, ("d1", "en", "src5"): 3.0,
}
SEED = 20_240_601


def domain_of_source() -> Column:
    """The tables have no domain: sources are dealt to four by the number in their name."""
    return F.concat(F.lit("d"), (F.coalesce(F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"(\d{1,9})$", 1).try_cast("int"), F.lit(0)) % 4).cast("string"))


def path_key(names: list[str]) -> Column:
    """A text that names a node; nulls differ from any name."""
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.lit("")


def weight_of(names: list[str], weights: dict) -> Column:
    """A node's weight among its siblings: that of its path, else of its name, else 1."""
    out = F.lit(1.0)
    for path, w in weights.items():
        if len(path) == 1:
            out = F.when(F.col(names[-1]).eqNullSafe(F.lit(path[0])), F.lit(float(w))).otherwise(out)
    for path, w in weights.items():
        if len(path) == len(names):
            out = F.when(reduce(Column.__and__, [F.col(n).eqNullSafe(F.lit(x)) for n, x in zip(names, path, strict=True)]), F.lit(float(w))).otherwise(out)
    return out


def share_out(children: DataFrame) -> DataFrame:
    """Deal each parent's amount to its children (parent, node, amount, weight, most); what the full ones leave goes to the others.

    In order of most / weight the full ones come first. The first that isn't full gets what
    is left in proportion to the weights from there on, and so do all after it.
    """
    order = Window.partitionBy("parent").orderBy("r", "node")
    open_ = children.where("weight > 0 and most > 0").withColumn("r", F.col("most") / F.col("weight"))
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    open_ = open_.withColumn("level", (F.col("amount") - before) / after)
    level = F.max(F.when(F.col("r") > F.col("level"), F.col("level"))).over(Window.partitionBy("parent"))
    return open_.select("node", F.greatest(F.lit(0.0), F.coalesce(F.least("most", level * F.col("weight")), F.col("most"))).alias("amount"))


def leaf_budgets(leaves: DataFrame, names: list[str], budget: float, weights: dict, max_epochs: int) -> DataFrame:
    """leaves(_leaf, names..., n) with ``_budget``: whole tokens that each may take of ``budget``."""
    amounts = None
    for k in range(len(names)):
        path = names[: k + 1]
        nodes = leaves.groupBy(*path).agg((F.sum("n") * max_epochs).cast("double").alias("most"))
        nodes = nodes.select(path_key(path[:-1]).alias("parent"), path_key(path).alias("node"), weight_of(path, weights).alias("weight"), "most")
        nodes = nodes.withColumn("amount", F.lit(float(budget))) if amounts is None else nodes.join(amounts.select(F.col("node").alias("parent"), "amount"), "parent")
        amounts = share_out(nodes)
    whole = F.floor(F.least(F.coalesce("amount", F.lit(0.0)) + 1e-6, (F.col("n") * max_epochs).cast("double"))).cast("long")
    return leaves.join(amounts, F.col("_leaf") == F.col("node"), "left").withColumn("_budget", whole).drop("node", "amount")


def _ends(rows: DataFrame, part: Column, rest: str) -> DataFrame:
    """For each leaf the part in which its rest of tokens ends, and what is left of it there: (_leaf, _end, _left)."""
    sums = rows.groupBy("_leaf", rest, part.alias("_b")).agg(F.sum("_tokens").alias("n"))
    upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("_leaf").orderBy("_b")))
    ends = upto.where(F.col("upto") > F.col(rest)).groupBy("_leaf").agg(F.min(F.struct("_b", (F.col(rest) - F.col("upto") + F.col("n")).alias("left"))).alias("e"))
    return ends.select("_leaf", F.col("e._b").alias("_end"), F.col("e.left").alias("_left"))


def mix(docs: DataFrame, tokens: Column, levels: dict[str, Column], scratch: Scratch, weights: dict | None = None, share: float = 0.8, max_epochs: int = 2, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """docs' rows that the mixture takes, with ``_tokens``, ``_copies`` and the leaf's levels as ``_l0``...

    share: the budget as a part of all tokens. weights: by name or path of a node, 1
    for others. A row counts one token at least, so that empty and null texts are mixed too. Nulls
    in a level make a leaf of their own. Rows come in the order of a hash of leaf and key, seeded by
    epoch; rows with one key tie and come smaller ones first, and those of one size are
    interchangeable. A document larger than what is left ends the prefix, however long.
    An empty docs gives no rows. Columns of docs that begin with _ and have names used here are replaced.
    docs is read several times: give a written table.
    """
    names = [f"_l{i}" for i in range(len(levels))]
    rows = docs.withColumn("_tokens", F.greatest(F.lit(1), F.coalesce(tokens, F.lit(0))).cast("long")).withColumns(dict(zip(names, levels.values(), strict=True)))
    rows = rows.withColumn("_leaf", path_key(names))
    leaves = scratch.save(rows.groupBy("_leaf", *names).agg(F.sum("_tokens").alias("n")), "mixing-leaves")
    total = leaves.agg(F.sum("n")).first()[0] or 0
    found = leaf_budgets(leaves, names, min(share, max_epochs) * total, weights or {}, max_epochs)
    plan = scratch.save(found.select("_leaf", F.floor(F.col("_budget") / F.col("n")).alias("_epochs"), (F.col("_budget") % F.col("n")).alias("_rest")), "mixing-plan")
    few = plan.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    sent = F.broadcast if few else lambda df: df
    # The order of the epoch that is cut; its first bits, as a number that isn't negative.
    order = F.xxhash64(F.lit(seed), "_epochs", F.col("_leaf"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    rows = rows.join(sent(plan), "_leaf").withColumn("_h", order)
    rows = rows.withColumn("_p", F.shiftright("_h", 64 - 2 * STEP_BITS) + F.lit(1 << 2 * STEP_BITS - 1))
    narrow = rows.select("_leaf", "_rest", "_tokens", "_p")
    coarse = F.shiftright("_p", STEP_BITS)
    first = _ends(narrow, coarse, "_rest").withColumnsRenamed({"_end": "_end1", "_left": "_left1"})
    inside = narrow.join(sent(first), "_leaf").where(coarse == F.col("_end1"))
    ends = scratch.save(_ends(inside, F.col("_p"), "_left1"), "mixing-ends")
    rows = rows.join(sent(ends), "_leaf", "left")
    at_end = F.col("_p") == F.col("_end")  # only these rows are ordered
    last = Window.partitionBy("_leaf").orderBy("_h", "_tokens").rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.where(at_end).withColumn("_in", (F.sum("_tokens").over(last) <= F.col("_left")).cast("long"))
    rest = rows.where(~F.coalesce(at_end, F.lit(False))).withColumn("_in", F.coalesce(F.col("_p") < F.col("_end"), F.lit(True)).cast("long"))
    out = cut.unionByName(rest).withColumn("_copies", F.col("_epochs") + F.col("_in")).where("_copies > 0")
    return out.drop("_leaf", "_epochs", "_rest", "_h", "_p", "_end", "_left", "_in")


def op10_mixing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Documents of the production mixture with the number of times each is taken; sizes are byte-level tokens."""
    scratch = Scratch(spark)
    docs = with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), tokenizer)
    docs = scratch.save(docs.select("doc_id", "lang", "source", "n_tokens"), "sizes")
    out = mix(docs, F.col("n_tokens"), {"domain": domain_of_source(), "lang": F.col("lang"), "source": F.col("source")}, scratch, WEIGHTS)
    return out.select("doc_id", F.col("_l0").alias("domain"), "lang", "source", F.col("_tokens").alias("n_tokens"), F.col("_copies").alias("copies"))
