"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source with a share p of the tokens gets a weight in proportion to p to the power of an exponent between 0 (all alike) and
1 (as they are). The exponent is bisected until the weights meet a target entropy or a limit on how often a source may be
repeated. The weights times the budget are then realised as block permutations: a source gives as many whole passes as fit,
and for the rest a prefix of a permutation of its blocks, cut at the document where the budget ends. Blocks hold about
`block_rows` rows whatever the size of their source, so only the block that the cut falls in is ever put in order.

Tokens are words unless another expression is given. A null text has none. A null source is a source of its own, also next
to one of any name. Rows with the same id share a place in the permutation and come or go
together; those without an id are placed by their text. Sources without tokens
give no rows of a partial pass. Names that begin with two underscores are the operator's own. Empty tables give no rows. Within a source the rows taken exceed its quota by less than the
tokens of one id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelayer.llm.texts import written

WORDS = "[^ \\t\\n\\x0b\\f\\r]+"
STEPS = 50


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("bigint")


def _weights(tokens: Column, exponent: Column) -> Column:
    """The weights of an array of token counts; the largest is 1 before they are normalised."""
    most = F.array_max(tokens)
    raw = F.transform(tokens, lambda t: F.when(t > 0, F.pow(t / most, exponent)).otherwise(0.0))
    whole = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / whole)


def _entropy(tokens: Column, exponent: Column) -> Column:
    terms = F.transform(_weights(tokens, exponent), lambda w: F.when(w > 0, -w * F.log(w)).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def _repetition(tokens: Column, exponent: Column, budget: Column) -> Column:
    passes = F.zip_with(_weights(tokens, exponent), tokens, lambda w, t: F.when(t > 0, w * budget / t).otherwise(0.0))
    return F.array_max(passes)


def source_weights(totals: DataFrame, budget: int | None, max_repetition: float | None, target_entropy: float | None) -> DataFrame:
    """`key`, `tokens`, `weight`, `quota` per source from `key` and `tokens`.

    With a limit, the least exponent whose repetition stays within it; with a target, the largest exponent whose entropy (in
    nats) reaches it. Where neither end of the range meets the aim, the nearer end. One row holds a number per source.
    """
    if (max_repetition is None) == (target_entropy is None):
        raise ValueError("give either a repetition limit or a target entropy")
    gathered = totals.agg(F.sort_array(F.collect_list(F.struct("key", "tokens"))).alias("sources"), F.sum("tokens").alias("whole"))
    gathered = gathered.withColumn("t", F.transform("sources", lambda s: s["tokens"].cast("double")))
    gathered = gathered.withColumn("budget", F.lit(budget).cast("double") if budget is not None else F.col("whole").cast("double"))

    def halve(state: Column, _: Column) -> Column:
        middle = (state["low"] + state["high"]) / 2
        if max_repetition is not None:  # holds above the exponent sought
            holds = _repetition(F.col("t"), middle, F.col("budget")) <= max_repetition
            return F.struct(F.when(holds, state["low"]).otherwise(middle).alias("low"), F.when(holds, middle).otherwise(state["high"]).alias("high"))
        holds = _entropy(F.col("t"), middle) >= target_entropy  # holds below it
        return F.struct(F.when(holds, middle).otherwise(state["low"]).alias("low"), F.when(holds, state["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), halve)
    limit = float("inf") if max_repetition is None else max_repetition
    rows = gathered.withColumn("exponent", (found["low"] + found["high"]) / 2).withColumn("w", _weights(F.col("t"), F.round("exponent", 9)))
    rows = rows.select("budget", F.explode(F.arrays_zip("sources", "w")).alias("s"))
    weight = F.round("s.w", 12)
    quota = F.round(F.least(weight * F.col("budget"), limit * F.col("s.sources.tokens"))).cast("bigint")
    return rows.select(F.col("s.sources.key").alias("key"), F.col("s.sources.tokens").alias("tokens"), weight.alias("weight"), quota.alias("quota"))


def mix(
    docs: DataFrame, budget: int | None = None, max_repetition: float | None = None, target_entropy: float | None = None, seed: str = "mix",
    block_rows: int = 4096, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None,
) -> DataFrame:
    """The rows of `docs` as often as the mixture takes them, with `__epoch` (pass, from 0), `__tokens`, `__weight` and `__order`.

    Sorting by `__order` gives the training order: blocks of all sources mixed, pass by pass. The budget is in tokens, by
    default as many as there are.
    """
    digits = max(1, math.ceil(math.log(max(1, docs.count()) / block_rows, 16))) if block_rows else 1
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    block = F.substring(F.md5(F.concat(F.lit(f"{seed}|block|"), name).cast("binary")), 1, digits)
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    rows = docs.withColumns({"__key": key, "__block": block, "__name": name, "__tokens": tokens if tokens is not None else words_in(F.col(text_col))})

    def place(epoch: Column) -> Column:
        """Where a row stands in the permutation of a pass: its block's place, then its own."""
        e = epoch.cast("string")
        blocks = F.md5(F.concat(F.lit(f"{seed}|"), e, F.lit("|"), F.col("__key"), F.lit("|"), F.col("__block")).cast("binary"))
        return F.concat(blocks, F.md5(F.concat(F.lit(f"{seed}|"), e, F.lit("|"), F.col("__name")).cast("binary")))

    per_block = rows.groupBy("__key", "__block").agg(F.sum("__tokens").alias("in_block"))
    totals = per_block.groupBy(F.col("__key").alias("key")).agg(F.sum("in_block").alias("tokens"))
    plan = written(source_weights(totals, budget, max_repetition, target_entropy), "weights")  # a row per source, whose size Spark then knows
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0).cast("int")
    plan = plan.withColumn("passes", passes).withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))

    before = Window.partitionBy("__key").orderBy("at", "__block").rowsBetween(Window.unboundedPreceding, -1)
    spot = F.md5(F.concat(F.lit(f"{seed}|"), F.col("passes").cast("string"), F.lit("|"), F.col("__key"), F.lit("|"), F.col("__block")).cast("binary"))
    blocks = per_block.join(plan, F.col("__key") == F.col("key")).withColumn("at", spot)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("in_block").over(before), F.lit(0)))
    cut = blocks.where("before < rest AND before + in_block >= rest").select(
        F.col("__key").alias("cut_key"), F.col("__block").alias("cut_block"), F.col("passes").alias("cut_pass"), F.col("rest") - F.col("before")
    ).toDF("cut_key", "cut_block", "cut_pass", "left")

    inside = rows.select("__key", "__block", "__name", "__tokens").join(cut, (F.col("__key") == F.col("cut_key")) & (F.col("__block") == F.col("cut_block")))
    inside = inside.groupBy("__key", "left", place(F.col("cut_pass")).alias("place")).agg(F.sum("__tokens").alias("n"))
    so_far = Window.partitionBy("__key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("sum_before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    last = inside.where("sum_before < left").groupBy(F.col("__key").alias("last_key")).agg(F.max("place").alias("last"))

    plan = plan.join(last, F.col("key") == F.col("last_key"), "left").select("key", "weight", "passes", "last").toDF("__k", "__weight", "__passes", "__last")
    plan = written(plan, "mixture")
    taken = rows.join(plan, F.col("__key") == F.col("__k"))
    times = F.col("__passes") + F.when(place(F.col("__passes")) <= F.col("__last"), 1).otherwise(0)
    taken = taken.withColumn("__times", times).where("__times > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
    order = F.concat(F.lpad(F.col("__epoch").cast("string"), 6, "0"), place(F.col("__epoch")))
    return taken.select(*[docs[c] for c in docs.columns], "__epoch", "__tokens", "__weight", order.alias("__order"))


def sql(max_repetition: float, digits: str, seed: str = "mix") -> str:
    """The mixture with a repetition limit for DuckDB, over `documents`; `digits` is the SQL for the digits of a block."""
    weights = "list_transform(t, lambda x: CASE WHEN x > 0 THEN pow(x / list_max(t), {e}) ELSE 0.0 END)"
    middle = weights.format(e="(low + high) / 2")
    return f"""
WITH RECURSIVE n AS (SELECT {digits} AS digits FROM documents),
r AS (SELECT doc_id, coalesce('s' || source, 'n') AS k, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name, source,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+')) AS BIGINT) AS tokens FROM documents),
rows_ AS (SELECT r.*, substr(md5('{seed}|block|' || name), 1, CAST((SELECT digits FROM n) AS INTEGER)) AS block FROM r),
totals AS (SELECT k, CAST(sum(tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY k),
g AS (SELECT list(CAST(tokens AS DOUBLE) ORDER BY k) AS t, CAST(sum(tokens) AS DOUBLE) AS budget FROM totals),
halves AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high FROM g
  UNION ALL
  SELECT i + 1, CASE WHEN holds THEN low ELSE (low + high) / 2 END, CASE WHEN holds THEN (low + high) / 2 ELSE high END
  FROM (SELECT i, low, high,
               list_max(list_transform(list_zip({middle}, t), lambda p: CASE WHEN p[2] > 0 THEN p[1] / list_sum({middle}) * budget / p[2] ELSE 0 END)) <= {max_repetition} AS holds
        FROM halves, g WHERE i < {STEPS})),
exponent AS (SELECT round((low + high) / 2, 9) AS e FROM halves WHERE i = {STEPS}),
raw AS (SELECT k, tokens, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT max(tokens) FROM totals), (SELECT e FROM exponent)) ELSE 0.0 END AS x FROM totals),
plan0 AS (SELECT k, tokens, round(x / (SELECT sum(x) FROM raw), 12) AS weight FROM raw),
plan1 AS (SELECT *, CAST(round(least(weight * (SELECT budget FROM g), {max_repetition} * tokens)) AS BIGINT) AS quota FROM plan0),
plan2 AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(quota // tokens AS INTEGER) ELSE 0 END AS passes FROM plan1),
plan AS (SELECT *, quota - passes * tokens AS rest FROM plan2),
placed AS (SELECT rows_.*, weight, passes, rest,
                  md5('{seed}|' || passes || '|' || rows_.k || '|' || block) || md5('{seed}|' || passes || '|' || name) AS place
           FROM rows_ JOIN plan ON rows_.k = plan.k),
names AS (SELECT k, place, sum(tokens) AS n FROM placed GROUP BY k, place),
run AS (SELECT k, place, coalesce(sum(n) OVER (PARTITION BY k ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM names),
taken AS (SELECT p.*, passes + CASE WHEN before < rest THEN 1 ELSE 0 END AS times FROM placed p JOIN run ON p.k = run.k AND p.place = run.place),
out AS (SELECT *, unnest(range(CAST(times AS BIGINT))) AS epoch FROM taken)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, tokens, weight,
       lpad(CAST(epoch AS VARCHAR), 6, '0') || md5('{seed}|' || epoch || '|' || k || '|' || block) || md5('{seed}|' || epoch || '|' || name) AS order_key
FROM out
"""
