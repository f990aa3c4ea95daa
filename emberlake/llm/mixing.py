"""Mixing sources to target weights over a tree such as domain, language, source.

Budgets run down the tree: a node's tokens are split among its children by weight. A child that has too few tokens
(``max_epochs`` times its corpus) is given all it has, and what it lacks goes to its siblings first; only what a whole
branch lacks goes to the siblings of the branch. Each leaf then takes whole epochs of its rows and, of one more seeded
epoch, the prefix whose tokens fit.

Budgets are joins and windows over the tree, level by level, so leaves may be many. A window holds a parent's different
ratios of capacity to weight, one row for all children with the same ratio; as capacities are sums of tokens, a corpus
of T tokens has fewer than sqrt(2 T) of them a weight, whatever the number of children.

The prefix needs no sort of a leaf: sums over 1,024 ranges of the order key find the range in which the budget ends,
twice over, and only the keys of that last range (about a millionth of the leaf) are sorted. Equal rows have one key
and are counted; where the budget ends among them, as many as fit are taken.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import BROADCAST_ROWS, discard, quoted, reads, small, words, written

KEY_BITS = 60
STEP_BITS = 10
NONE = "(none)"
#: Rounding that sums of doubles are allowed, in tokens and in epochs.
SLACK = 1e-6

Weights = Sequence[Mapping[str, float]]


def split_budget(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """Shares of ``budget`` for children (weight, capacity): in proportion to weight, none above its capacity.

    What a full child lacks is split among the others by weight. A child without weight gets nothing.
    """
    given, open_ = [0.0] * len(children), [k for k, (w, c) in enumerate(children) if w > 0 and c > 0]
    left = budget
    while open_ and left > 0:
        total = sum(children[k][0] for k in open_)
        # a weight is divided by the total first: tiny weights times tokens would run out of digits
        share = {k: left * (children[k][0] / total) for k in open_}
        full = [k for k in open_ if children[k][1] <= share[k]]
        if not full:
            for k in open_:
                given[k] = share[k]
            break
        for k in full:
            given[k] = children[k][1]
        left -= sum(children[k][1] for k in full)
        open_ = [k for k in open_ if k not in full]
    return given


def leaf_budgets(leaves: Mapping[tuple[str, ...], float], weights: Weights, budget: float, max_epochs: float) -> dict[tuple[str, ...], float]:
    """Tokens for each leaf (a path of names, one a level) of a small tree, to plan a mix from known sums without Spark.

    A name without a weight has weight 1. ``budgets`` gives the same for trees of any size.
    """

    def fill(paths: list[tuple[str, ...]], level: int, amount: float) -> dict[tuple[str, ...], float]:
        if level == len(paths[0]):
            return {paths[0]: amount}
        names: dict[str, list[tuple[str, ...]]] = {}
        for p in paths:
            names.setdefault(p[level], []).append(p)
        children = [(float(weights[level].get(n, 1.0)), capacity(below, level + 1)) for n, below in names.items()]
        shares = split_budget(amount, children)
        return {p: x for below, share in zip(names.values(), shares, strict=True) for p, x in fill(below, level + 1, share).items()}

    def capacity(paths: list[tuple[str, ...]], level: int) -> float:
        """What a branch can take: leaves whose own weight, or a branch's on the way, is 0 can't take anything."""
        return sum(leaves[p] * max_epochs for p in paths if all(weights[k].get(p[k], 1.0) > 0 for k in range(level, len(p))))

    return fill(sorted(leaves), 0, budget) if leaves else {}


def _filled(nodes: DataFrame) -> DataFrame:
    """(node, given) from (parent, node, w, cap, budget): the parent's budget is poured over its children up to one level."""
    # by logarithms, as the quotient of a capacity and a tiny weight may have no double
    ratio = F.log2("cap") - F.log2("w")
    able = nodes.filter("w > 0 and cap > 0").withColumn("ratio", ratio)
    steps = able.groupBy("parent", "ratio").agg(F.sum("cap").alias("cap"), F.sum("w").alias("w"), F.max("budget").alias("budget"))
    up = Window.partitionBy("parent").orderBy("ratio").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("parent").orderBy(F.desc("ratio")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("left", F.col("budget") - (F.sum("cap").over(up) - F.col("cap"))).withColumn("open_w", F.sum("w").over(down))
    # the children below the first that isn't full are full; the others share what is left
    cut = steps.filter("cap > left * (w / open_w)").groupBy("parent").agg(F.min(F.struct("ratio", "left", "open_w")).alias("cut"))
    share = F.least("cap", F.greatest(F.col("cut.left"), F.lit(0.0)) * (F.col("w") / F.col("cut.open_w")))
    given = F.when((F.col("w") <= 0) | (F.col("cap") <= 0), 0.0).when(F.col("cut").isNull() | (ratio < F.col("cut.ratio")), F.col("cap")).otherwise(share)
    return nodes.join(cut, "parent", "left").select("node", given.alias("given"))


def budgets(leaves: DataFrame, weights: Weights, budget: float, max_epochs: float) -> DataFrame:
    """(leaf, n, given) from (leaf: array of names, n: tokens): the tokens that each leaf is to give.

    Weights are finite and not negative, of any size; a name without one has 1. They are joined as tables, so there may be
    as many as there are names. Only weights above 1e290 are scaled, with all of their level.
    """
    if any(not 0 <= w < float("inf") for level in weights for w in level.values()):
        raise ValueError("a weight is finite and not negative")
    own, spark = [], leaves.sparkSession
    for k, level in enumerate(weights):
        if level:
            scale = 1e290 / max(1e290, *level.values())
            table = spark.createDataFrame([(name, float(w) * scale) for name, w in level.items()], f"name{k} string, own{k} double")
            leaves = leaves.join(F.broadcast(table) if len(level) <= BROADCAST_ROWS else table, F.col("leaf")[k] == F.col(f"name{k}"), "left")
            own.append(F.coalesce(f"own{k}", F.lit(scale)))
        else:
            own.append(F.lit(1.0))
    able = F.lit(True)
    for w in own:
        able = able & (w > 0)
    now = leaves.select("leaf", "n", F.when(able, F.col("n") * F.lit(float(max_epochs))).otherwise(0.0).alias("cap"), F.lit(float(budget)).alias("given"), *(w.alias(f"w{k}") for k, w in enumerate(own)))
    levels = []
    for k in range(len(weights)):
        node = F.slice("leaf", 1, k + 1)
        nodes = now.groupBy(F.slice("leaf", 1, k).alias("parent"), node.alias("node")).agg(F.sum("cap").alias("cap"), F.max(f"w{k}").alias("w"), F.max("given").alias("budget"))
        levels.append(written(_filled(nodes), f"mix-level{k}"))
        now = now.drop("given").withColumn("node", node).join(small(levels[-1]), "node").drop("node")
    return reads(now.select("leaf", "n", "given"), *levels)


def _row_digest(row_id: Column, text: Column) -> Column:
    """One value for all equal rows: repeated ids, or none, with different texts have places of their own."""
    return F.md5(F.concat_ws("/", F.coalesce(row_id.cast("string"), F.lit(NONE)), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))).cast("binary"))


def order_key(digest: Column, epoch: Column, seed: int) -> Column:
    """A 60-bit place in the shuffled order of one epoch: from MD5, so that any engine gives the same."""
    text = F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), digest)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def _cut_range(keyed: DataFrame, tag: str) -> DataFrame:
    """For each leaf the first range of ``bin`` whose running sum passes ``room``: (leaf, cut, room inside it).

    The window holds 1,024 sums of a leaf at most. A leaf whose rows all fit has no row.
    """
    sums = keyed.groupBy("leaf", "room", "bin").agg(F.sum("n_tokens").alias("n"))
    run = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("leaf").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    over = run.filter("upto > room").groupBy("leaf").agg(F.min(F.struct("bin", (F.col("room") - F.col("upto") + F.col("n")).alias("room"))).alias("x"))
    return written(over.select("leaf", F.col("x.bin").alias("cut"), F.col("x.room").alias("room")), tag)


def _ends(stats: DataFrame, budget: DataFrame, seed: int) -> DataFrame:
    """(leaf, over, fit) of leaves that don't fit whole: the first key that passes the budget, and how many of its rows still fit."""
    keyed = stats.join(small(budget), "leaf").filter("room > 0").withColumn("key", order_key(F.col("digest"), F.col("epochs"), seed))
    shift = KEY_BITS - STEP_BITS
    first = _cut_range(keyed.withColumn("bin", F.shiftright("key", shift)), "mix-first")
    inner = keyed.drop("room").join(small(first), "leaf").filter(F.shiftright("key", shift) == F.col("cut"))
    second = _cut_range(inner.withColumn("bin", F.shiftright("key", shift - STEP_BITS)), "mix-second")
    last = keyed.drop("room").join(small(second), "leaf").filter(F.shiftright("key", shift - STEP_BITS) == F.col("cut"))
    keys = last.groupBy("leaf", "room", "key").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("one"))
    run = keys.withColumn("upto", F.sum("n").over(Window.partitionBy("leaf").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)))
    fit = F.floor((F.col("room") - F.col("upto") + F.col("n")) / F.greatest("one", F.lit(1))).alias("fit")
    over = run.filter("upto > room").groupBy("leaf").agg(F.min(F.struct("key", fit)).alias("x"))
    out = written(over.select("leaf", F.col("x.key").alias("over"), F.col("x.fit").alias("fit")), "mix-ends")
    discard(first, second)
    return out


def _numbered(rows: DataFrame, by: str) -> DataFrame:
    """Rows with ``__no`` from 1 within ``by``: numbered inside each part of the table and moved on by the parts before."""
    table = written(rows.withColumn("__at", F.monotonically_increasing_id()), "mix-tied")
    rows = table.withColumn("__part", F.shiftright("__at", 33))
    parts = rows.groupBy(by, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    inside = F.row_number().over(Window.partitionBy(by, "__part").orderBy("__at"))
    numbered = rows.withColumn("__no", inside).join(parts.select(by, "__part", before.alias("__before")), [by, "__part"])
    return reads(numbered.withColumn("__no", F.col("__no") + F.col("__before")), table)


def choose(docs: DataFrame, levels: Mapping[str, Column], weights: Weights, total: float | None = None, share: float | None = None, max_epochs: float = 1.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``__leaf``, ``__tokens``, ``__epochs`` (how often the row is taken), rows taken never left out.

    ``levels``: a column for each level of the tree, outermost first; nulls are one name, "(none)". The budget is
    ``total`` tokens (words), or ``share`` of those in the corpus. A row's place comes from its id and text, so rows
    without an id, or with one that repeats, fill a budget as any others do; of equal rows any are taken. Empty and null
    texts have no tokens and enter with any prefix that passes their key. An empty table gives none. Names of columns
    that begin with two underscores are the operator's own; any others may be in ``docs``.
    """
    if (total is None) == (share is None) or len(levels) != len(weights):
        raise ValueError("give either total or share, and weights for each level")
    path = F.array(*(F.coalesce(c.cast("string"), F.lit(NONE)) for c in levels.values()))
    whole = docs.withColumns({"__leaf": path, "__tokens": F.size(words(F.col(text_col).cast("string"))).cast("long"), "__digest": _row_digest(F.col(id_col), F.col(text_col))})
    stats = written(whole.select(F.col("__leaf").alias("leaf"), F.col("__digest").alias("digest"), F.col("__tokens").alias("n_tokens")), "mix-stats")
    leaves = written(stats.groupBy("leaf").agg(F.sum("n_tokens").alias("n")), "mix-leaves")
    amount = (leaves.agg(F.sum("n")).first()[0] or 0) * share if total is None else total
    given = budgets(leaves, weights, amount, max_epochs)
    epochs = F.when(F.col("n") > 0, F.floor(F.col("given") / F.col("n") + SLACK)).otherwise(0).cast("int")
    budget = written(given.withColumn("epochs", epochs).select("leaf", "epochs", F.floor(F.col("given") - F.col("epochs") * F.col("n") + SLACK).alias("room")), "mix-budgets")
    ends = _ends(stats, budget, seed)

    over = F.when(F.col("room") > 0, F.coalesce("over", F.lit(1 << KEY_BITS))).otherwise(F.lit(-1)).alias("__over")
    plan = written(budget.join(small(ends), "leaf", "left").select(F.col("leaf").alias("__leaf"), F.col("epochs").alias("__whole"), over, F.coalesce("fit", F.lit(0)).alias("__fit")), "mix-plan")
    discard(stats, leaves, given, budget, ends)
    kept = [*map(quoted, docs.columns), "__leaf", "__tokens", "__epochs"]
    placed = whole.join(small(plan), "__leaf").withColumn("__key", order_key(F.col("__digest"), F.col("__whole"), seed))
    tied = (F.col("__fit") > 0) & (F.col("__key") == F.col("__over"))
    out = placed.withColumn("__epochs", F.col("__whole") + (F.col("__key") < F.col("__over")).cast("int"))
    if plan.filter("__fit > 0").isEmpty():
        return reads(out.filter("__epochs > 0").select(*kept), plan)
    numbered = _numbered(placed.filter(tied), "__leaf")
    some = numbered.withColumn("__epochs", F.col("__whole") + (F.col("__no") <= F.col("__fit")).cast("int"))
    return reads(out.filter(~tied).select(*kept).unionByName(some.select(*kept)).filter("__epochs > 0"), plan, numbered)


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Weights, **how) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken, with the columns of ``docs``; edge cases as in ``choose``."""
    taken = choose(docs, levels, weights, **how)
    return reads(taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__epochs")))).select(*map(quoted, docs.columns)), taken)
