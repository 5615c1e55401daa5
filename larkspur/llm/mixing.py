"""Mixing sources to target weights by temperature. DataFrame functions only.

A source's weight is its share of the tokens to the power of alpha, normalised. Alpha is bisected until the weights' entropy reaches a
share of its maximum, or until no source is read more often than the repetition limit. A step evaluates SECTIONS exponents at once in one
aggregation over the sources, so only so many rows come to the driver, however many sources there are.

Tokens are words here, as white space separates them: shares and budgets need no tokenizer's ids.

The weights are realised as budgeted block permutations: each source's tokens are its weight's part of the budget. Whole epochs take every
document; the last epoch goes through the source's blocks in a seeded order and takes documents while they fit. Blocks are ranges of a
seeded hash of the id and the text with about BLOCK_ROWS documents, so prefix sums run over blocks, by ranges of their order (see prefix_sums), and over rows only in the one block where a source's budget
ends; no task has a whole source's rows or blocks.

Defined results: a null source is a source of its own; null or empty texts have 0 tokens and are taken with their block; a source without tokens gets
no weight and no rows; rows with the same or a null id are rows of their own; an empty table gives an empty result; in
mix_documents all columns are passed on, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm._shared import prefix_sums, unpacked
from larkspur.session import cut

SECTIONS, STEPS, BLOCK_ROWS, SEED = 32, 6, 256, 17
WORDS = r"[^\x20\x09-\x0D]+"
_BITS = 48


def _hash48(*parts: Column) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long")


def source_shares(rows: DataFrame) -> DataFrame:
    """(source, tokens, rows, share) of the sources that have tokens."""
    sources = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).filter("tokens > 0")
    total = sources.agg(F.sum("tokens")).first()[0]
    return sources.withColumn("share", F.col("tokens") / F.lit(float(total or 1)))


def find_alpha(shares: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: float | None = 1.0) -> float:
    """The least exponent, to 6 digits, whose weights meet the entropy (a share of the maximum) or the repetition limit.

    budget is in units of all tokens, or None for the least at which every document is read.
    """
    n = shares.count()
    low, high = (0.0, 8.0) if entropy is not None else (0.0, 1.0)
    if n < 2:
        return 1.0
    for _ in range(STEPS):
        grid = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        power = F.pow("share", F.col("alpha"))
        tried = shares.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in grid]))).groupBy("alpha").agg(
            F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("l"), F.max(F.pow("share", F.col("alpha") - 1)).alias("most"), F.min(F.pow("share", F.col("alpha") - 1)).alias("fewest")
        )
        met = {r["alpha"]: _meets(r, n, entropy, repetition, budget) for r in tried.collect()}
        first = next((k for k, a in enumerate(grid) if met[a]), SECTIONS)
        low, high = grid[max(0, first - 1)], grid[first]
    return round(high, 6)


def _meets(r: object, n: int, entropy: float | None, repetition: float | None, budget: float | None) -> bool:
    if entropy is not None:
        return math.log(r["z"]) - r["alpha"] * r["l"] / r["z"] <= entropy * math.log(n)
    epochs = r["most"] / r["fewest"] if budget is None else budget * r["most"] / r["z"]
    return epochs <= repetition


def weigh(shares: DataFrame, alpha: float, budget: float | None = 1.0) -> DataFrame:
    """shares with weight, quota (tokens to be read) and blocks."""
    raw = F.pow("share", F.lit(alpha))
    sums = shares.agg(F.sum(raw).alias("z"), F.max(F.col("share") / raw).alias("cover"), F.sum("tokens").alias("t")).first()
    total, z = float(sums["t"] or 0), float(sums["z"] or 1)
    wanted = total * budget if budget is not None else total * z * float(sums["cover"] or 0)
    weighed = shares.withColumn("weight", raw / F.lit(z))
    # where the budget is the least that covers all, rounding must not cut the source that sets it
    quota = F.round(F.col("weight") * F.lit(wanted)).cast("long")
    quota = F.greatest(quota, F.col("tokens")) if budget is None else quota
    return weighed.withColumn("quota", quota).withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("long"))


def mix(docs: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: float | None = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, keep: bool = False) -> DataFrame:
    """(id, source, tokens, epoch, block_key, row_key) of every reading; sorted by the last three, an epoch is a block permutation.

    keep: docs' rows stand in front as one column, row, and the others' names start with _lk_.
    """
    tokens = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORDS)).cast("long")
    own = [F.struct("*").alias("row")] if keep else []
    names = {n: f"_lk_{n}" for n in ("id", "source", "tokens", "check")}
    rows = docs.select(*own, F.col(id_col).alias(names["id"]), F.col(source_col).alias(names["source"]), tokens.alias(names["tokens"]), _hash48(F.col(text_col)).alias(names["check"]))
    narrow = cut(rows.select(*[F.col(v).alias(k) for k, v in names.items()]), "mix-rows")
    shares = cut(source_shares(narrow), "mix-shares")
    plan = cut(weigh(shares, find_alpha(shares, entropy, repetition, budget), budget), "mix-plan")
    plan = plan.select(F.col("source").alias("_lk_plan"), F.col("tokens").alias("_lk_all"), "quota", "blocks")
    whole, rest = F.expr("quota div _lk_all"), F.expr("quota % _lk_all")
    last = whole + 1

    def placed(df: DataFrame) -> DataFrame:
        spread = F.floor(_hash48(F.lit(seed), F.col("_lk_id"), F.col("_lk_check")) / F.lit(float(1 << _BITS)) * F.col("blocks")).cast("long")
        out = df.join(plan, F.col("_lk_source").eqNullSafe(F.col("_lk_plan"))).withColumn("_lk_block", spread)
        return out.withColumn("_lk_whole", whole).withColumn("_lk_rest", rest)

    def block_key(epoch: Column) -> Column:
        return _hash48(F.lit(seed), epoch, F.col("_lk_source"), F.col("_lk_block"))

    def row_key(epoch: Column) -> Column:
        return _hash48(F.lit(seed), epoch, F.col("_lk_id"), F.col("_lk_check"))

    at = placed(narrow.select(*[F.col(k).alias(v) for k, v in names.items()]))
    blocks = at.groupBy("_lk_source", "_lk_block").agg(F.sum("_lk_tokens").alias("n"), F.first("_lk_rest").alias("rest"), F.first("_lk_whole").alias("whole"), F.first("blocks").alias("blocks"))
    # blocks stand in the order of their keys; ranges of it hold some BLOCK_ROWS blocks each
    blocks = blocks.withColumn("key", block_key(F.col("whole") + 1))
    spread = F.floor(F.col("key") / F.lit(float(1 << _BITS)) * F.ceil(F.col("blocks") / BLOCK_ROWS))
    blocks = prefix_sums(blocks, ["_lk_source"], spread, [F.col("key"), F.col("_lk_block")], F.col("n"), "before")
    blocks = cut(blocks.select(F.col("_lk_source").alias("_lk_s"), F.col("_lk_block").alias("_lk_b"), "n", "before", "rest").filter("before <= rest and rest > 0"), "mix-blocks")
    same = F.col("_lk_source").eqNullSafe(F.col("_lk_s")) & (F.col("_lk_block") == F.col("_lk_b"))
    ends = blocks.filter("before + n > rest")
    within = Window.partitionBy("_lk_source", "_lk_block").orderBy(row_key(last), "_lk_id", "_lk_tokens", "_lk_check").rowsBetween(Window.unboundedPreceding, 0)
    cutting = at.join(ends, same).withColumn("upto", F.sum("_lk_tokens").over(within) + F.col("before"))
    # in the block where a budget ends, rows up to a key of the order are taken
    bound = cutting.filter("upto <= rest").groupBy("_lk_source", "_lk_block").agg(F.max(F.struct(row_key(last).alias("k"), F.col("_lk_id").alias("i"), F.col("_lk_tokens").alias("t"), F.col("_lk_check").alias("c"))).alias("bound"))
    bound = bound.select(F.col("_lk_source").alias("_lk_s2"), F.col("_lk_block").alias("_lk_b2"), "bound")
    limits = blocks.join(bound, F.col("_lk_s").eqNullSafe(F.col("_lk_s2")) & (F.col("_lk_b") == F.col("_lk_b2")), "left").select("_lk_s", "_lk_b", (F.col("before") + F.col("n") <= F.col("rest")).alias("all_in"), "bound")
    limits = cut(limits.filter("all_in or bound is not null"), "mix-limits")
    read = placed(rows).join(limits, same, "left")
    key = F.struct(row_key(last).alias("k"), F.col("_lk_id").alias("i"), F.col("_lk_tokens").alias("t"), F.col("_lk_check").alias("c"))
    more = F.coalesce(F.col("all_in") | (key <= F.col("bound")), F.lit(False))
    read = read.withColumn("_lk_readings", (F.col("_lk_whole") + more.cast("int")).cast("int")).filter("_lk_readings > 0")
    read = read.select("*", F.explode(F.sequence(F.lit(1), F.col("_lk_readings"))).alias("_lk_epoch"))
    added = [F.col("_lk_epoch"), block_key(F.col("_lk_epoch")).alias("_lk_block_key"), row_key(F.col("_lk_epoch")).alias("_lk_row_key")]
    out = read.select(*["row"] * keep, *[names[n] for n in ("id", "source", "tokens")], *added)
    return out if keep else out.toDF(*[c.removeprefix("_lk_") for c in out.columns])


def mix_documents(docs: DataFrame, **options: object) -> DataFrame:
    """docs' columns, a row each time a document is read."""
    return mix(docs, keep=True, **options).select(*unpacked("row", docs.columns))
