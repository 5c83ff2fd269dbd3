"""Mixing sources to target weights, in DataFrame functions only.

*Temperature mixing*: source i with share p_i of all tokens gets the weight
p_i^a / sum p_j^a. The exponent a in [0, 1] is bisected: the largest one whose
weights have at least the target entropy, or the smallest one at which no source
is repeated more than a limit.

*Budgeted block permutations*: the weight times the token budget is the budget of
a source. Each of its epochs is a permutation of its documents, given by a seeded
hash: the leading hex digits of the hash are the block, the rest the order inside
it. As many whole epochs as the budget holds are used, then the first documents
of the next permutation while their tokens fit the rest.

The cut in the last permutation is found from block totals first and inside one
block per source afterwards, so no source is ordered in one task, and the texts
are not shuffled: the cut is a bound on the hash, looked up per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..session import durable

#: Bisection steps: the exponent is known to 2^-STEPS.
STEPS = 40
#: Hex digits of the hash that name the block: 4096 blocks per source and epoch.
BLOCK_DIGITS = 3
#: Up to so many sources (under 200 bytes each) are broadcast; more are joined.
BROADCAST_SOURCES = 50_000
#: Tokens of a document: runs of bytes other than ASCII blanks.
TOKEN = r"[^\x20\x09-\x0D]+"


def tokens(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN)).cast("bigint")


def _name(source: str) -> Column:
    """Documents without a source are a source of their own, named by no other."""
    return F.when(F.col(source).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def _order(epoch: Column | str, seed: int, id_col: str = "doc_id") -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string") if isinstance(epoch, str) else epoch, F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def weights(totals: DataFrame, entropy: float | None = None, max_repeat: float | None = None, budget: int | None = None) -> DataFrame:
    """(source, n_tokens, exponent, weight, budget) from (source, n_tokens).

    ``entropy`` is a target as a share (0 to 1) of the entropy of equal weights:
    the exponent is the largest in [0, 1] that reaches it (1 if the corpus does
    already). ``max_repeat``: the smallest exponent in [0, 1] at which no source's
    budget is over ``max_repeat`` times its tokens (1 if none will do). With both,
    the larger exponent holds, so the limit wins. Sources without tokens have the
    weight zero. The table of sources is one array of one row: it has a number per
    source, not per document.
    """
    total = "aggregate(s, 0L, (a, x) -> a + x.n_tokens)"
    row = (
        totals.where("n_tokens > 0").agg(F.array_sort(F.collect_list(F.struct("source", "n_tokens"))).alias("s"))
        .withColumn("total", F.expr(total)).withColumn("given", F.lit(budget).cast("bigint"))
        .withColumn("goal", F.coalesce("given", "total"))
        .withColumn("p", F.expr("transform(s, x -> CAST(x.n_tokens AS DOUBLE) / total)"))
    )
    # Natural logs of the shares once; a weight is exp(a * l) over their sum.
    row = row.withColumn("l", F.expr("transform(p, x -> ln(x))"))
    z = "aggregate(l, 0D, (z, x) -> z + exp({a} * x))"
    mean = "aggregate(l, 0D, (z, x) -> z + {a} * x * exp({a} * x))"
    spread = f"(ln({z}) - {mean} / {z})"
    rarest = "array_min(l)"

    def bisected(holds: str, keep_low: bool) -> Column:
        mid = "((b.lo + b.hi) / 2D)"
        yes = holds.format(a=mid)
        lo, hi = (f"IF({yes}, {mid}, b.lo)", f"IF({yes}, b.hi, {mid})") if keep_low else (f"IF({yes}, b.lo, {mid})", f"IF({yes}, {mid}, b.hi)")
        end = "lo" if keep_low else "hi"
        return F.expr(f"aggregate(sequence(1, {STEPS}), struct(0D AS lo, 1D AS hi), (b, i) -> struct({lo} AS lo, {hi} AS hi), b -> b.{end})")

    exponents = []
    if entropy is not None:
        holds = f"{spread} >= {float(entropy)!r}D * ln(CAST(size(s) AS DOUBLE))"
        exponents.append(F.when(F.expr(holds.format(a="1D")), F.lit(1.0)).otherwise(bisected(holds, keep_low=True)))
    if max_repeat is not None:
        holds = f"goal * exp({{a}} * {rarest}) / {z} <= {float(max_repeat)!r}D * total * exp({rarest})"
        exponents.append(F.when(F.expr(holds.format(a="0D")), F.lit(0.0)).otherwise(bisected(holds, keep_low=False)))
    exponent = F.lit(1.0) if not exponents else exponents[0] if len(exponents) == 1 else F.greatest(*exponents)
    row = row.withColumn("exponent", exponent).withColumn("z", F.expr(z.format(a="exponent")))
    each = F.expr(
        "transform(s, (x, i) -> struct(x.source AS source, x.n_tokens AS n_tokens, exponent, exp(exponent * l[i]) / z AS weight))"
    )
    return row.select("goal", F.explode(each).alias("x")).select(
        "x.*", F.round(F.col("goal") * F.col("x.weight")).cast("bigint").alias("budget")
    )


def plan(docs: DataFrame, source_col: str = "source", seed: int = 42, **targets) -> DataFrame:
    """(source, n_tokens, exponent, weight, budget, epochs, last): ``epochs`` whole
    permutations, then the documents of permutation ``epochs`` whose hash is at
    most ``last`` (an empty string: none)."""
    counted = durable(docs.select("doc_id", _name(source_col).alias("source"), tokens().alias("n")))
    totals = counted.groupBy("source").agg(F.sum("n").alias("n_tokens"))
    wanted = durable(
        weights(totals, **targets).withColumn("epochs", F.expr("budget DIV n_tokens")).withColumn("rest", F.expr("budget % n_tokens"))
    )
    sides = _bounded(wanted, BROADCAST_SOURCES)
    hashed = counted.where("n > 0").join(sides.select("source", "epochs", "rest"), "source").select(
        "source", "rest", "n", _order("epochs", seed).alias("h")
    ).withColumn("block", F.substring("h", 1, BLOCK_DIGITS))
    blocks = hashed.groupBy("source", "block").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = durable(
        blocks.withColumn("before", before).where("before <= rest AND before + n > rest").select("source", "block", "before", "rest")
    )
    inside = hashed.select("source", "block", "h", "n").join(_bounded(cut, BROADCAST_SOURCES), ["source", "block"])
    ties = inside.groupBy("source", "before", "rest", "block", "h").agg(F.sum("n").alias("n"))  # repeated ids share a hash
    upto = F.sum("n").over(Window.partitionBy("source", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    last = (
        ties.withColumn("upto", F.col("before") + upto).groupBy("source", "block")
        .agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("h"))).alias("h"))
        .select("source", F.coalesce("h", F.col("block")).alias("last"))  # no document fits: below the block's first hash
    )
    return wanted.join(last, "source", "left").select(
        "source", "n_tokens", "exponent", "weight", "budget", "epochs", F.coalesce("last", F.lit("")).alias("last")
    )


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast when a count just made is within the bound, else joined as it is."""
    return F.broadcast(df) if df.count() <= rows else df


#: What ``mix`` adds.
ADDED = ("mix_tokens", "mix_epoch", "mix_order")


def mix(docs: DataFrame, source_col: str = "source", seed: int = 42, added: bool = True, **targets) -> DataFrame:
    """The chosen documents: all columns of ``docs`` and ``mix_tokens``, ``mix_epoch``,
    ``mix_order`` (the hash; order by source, epoch and it), a row for each time a
    document is used.

    A document without tokens costs nothing and is used once. Targets are those of
    ``weights``. Null sources are a source of their own, null ids share one hash, and
    repeated rows are each used. Columns of the input with the names of the three added ones
    are replaced; with ``added=False`` none is added, and all columns of ``docs`` come back as they are.
    """
    chosen = durable(plan(docs, source_col, seed, **targets)).select(
        F.col("source").alias("mix_source"), F.col("epochs").alias("mix_epochs"), F.col("last").alias("mix_last")
    )
    own = [c for c in docs.columns if not added or c.lower() not in ADDED]
    rows = docs.select(F.struct(*own).alias("row"), F.col("doc_id").alias("mix_id"), _name(source_col).alias("mix_source"), tokens().alias("mix_tokens"))
    planned = rows.join(_bounded(chosen, BROADCAST_SOURCES), "mix_source", "left")
    extra = F.when(_order("mix_epochs", seed, "mix_id") <= F.col("mix_last"), 1).otherwise(0)
    uses = F.when(F.col("mix_tokens") == 0, 1).otherwise(F.col("mix_epochs") + extra).cast("int")
    return (
        planned.withColumn("mix_uses", F.coalesce(uses, F.lit(1))).where("mix_uses > 0")
        .select("row", "mix_id", "mix_tokens", F.explode(F.expr("sequence(0, mix_uses - 1)")).alias("mix_epoch"))
        .select("row.*", *((F.col("mix_tokens"), F.col("mix_epoch"), _order("mix_epoch", seed, "mix_id").alias("mix_order")) if added else ()))
    )
