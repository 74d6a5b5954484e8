"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domains, languages and sources. At every node it is shared among the children by
weight; a child that can't use its share (all its leaves' tokens, each epoch counted) takes what it can and the rest
goes to its siblings, by weight again; only what a whole subtree can't use reaches the subtree's own siblings. Each
leaf then takes its budget as a prefix of its documents in a seeded order, a new order for each epoch.

All sums are of whole numbers, so that every engine and every partitioning gives the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import WORD, materialize

LEVELS = ("domain", "lang", "source")
#: The tree's top: sources by their number, modulo 4.
DOMAINS = ("web", "books", "news", "forums")
#: Target weights, relative among siblings; a node that isn't named has OTHER.
WEIGHTS = {"domain": {"web": 4, "books": 3, "news": 2, "forums": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
OTHER = 1
#: Budget as a share of the corpus's tokens, in hundredths; epochs that a leaf may be used.
BUDGET_PERCENT, MAX_EPOCHS, SEED = 100, 2, 17
#: Leaves up to which their cuts are broadcast; more are joined by shuffle.
MAX_BROADCAST_LEAVES = 50_000


def domain_of(source: Column) -> Column:
    """Domain of a source by the number in its name; a name without a number (or null) is of the last domain."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})", 1)
    return F.when(number == "", DOMAINS[-1]).otherwise(F.get(F.array(*map(F.lit, DOMAINS)), F.when(number != "", number).cast("int") % len(DOMAINS)))


def token_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """children (keys, name, weight, capacity) with budget: their parents' budgets (keys, budget) water-filled.

    In the order of capacity per weight, children are full as long as their fair share of what is left is more than
    they hold; the others share the rest by weight, rounded down. At most the children of one node meet in a task."""
    rows = children.join(parents, keys) if keys else children.crossJoin(F.broadcast(parents))  # one row: the root
    node = keys or [F.lit(0)]
    w = Window.partitionBy(*node).orderBy(F.col("capacity") * F.lit(1.0) / F.col("weight"), "name")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"_held": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "_w": F.sum("weight").over(after)})
    full = F.col("capacity").cast("decimal(20,0)") * F.col("_w") <= F.col("weight").cast("decimal(20,0)") * (F.col("budget") - F.col("_held"))
    rows = rows.withColumn("_full", full.cast("int"))
    # full children come first: the rest's shares follow from the sums over them
    whole = Window.partitionBy(*node)
    held = F.sum(F.when(F.col("_full") == 1, F.col("capacity")).otherwise(0)).over(whole)
    rest = F.sum(F.when(F.col("_full") == 0, F.col("weight")).otherwise(0)).over(whole)
    rows = rows.withColumns({"_held": held, "_w": rest})
    part = F.expr("cast((cast(weight as decimal(20,0)) * (budget - _held)) div greatest(_w, 1) as bigint)")
    return rows.withColumn("budget", F.when(F.col("_full") == 1, F.col("capacity")).otherwise(part)).drop("_held", "_w", "_full")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], percent: int, max_epochs: int) -> DataFrame:
    """levels, tokens, budget of each leaf (levels, tokens)."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    parents = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * percent).alias("b")).select(F.expr("cast(b div 100 as bigint)").alias("budget"))
    for i, level in enumerate(levels):
        keys = levels[:i]
        named = weights.get(level) or {}
        weight = reduce(lambda c, kv: c.when(F.col("name") == kv[0], kv[1]), named.items(), F.when(F.lit(False), 0)).otherwise(OTHER)
        children = leaves.groupBy(*keys, F.col(level).alias("name")).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight.cast("long"))
        parents = share(parents, children, keys).select(*keys, F.col("name").alias(level), "budget")
    return leaves.drop("capacity").join(parents, levels)


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]] | None = None, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs' rows that the mixture takes, once for each epoch that takes them.

    Columns: docs' own as struct `row`, then the levels' columns, epoch int, n_tokens long. A null level value is the
    node ''. The order within a leaf and epoch is md5(seed:epoch:doc_id), then n_tokens; a row is taken while the
    tokens before it are under the leaf's budget for the epoch. Null doc_ids are ordered as empty strings; repeated
    rows are rows of their own. An empty table gives an empty one.

    Every leaf's order is cut into 4,096 buckets of md5 prefixes: sums of buckets find the one where the budget ends,
    and only rows of that bucket are ordered, so that no leaf's rows meet in one task."""
    weights = WEIGHTS if weights is None else weights
    names = list(levels)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(F.coalesce(c, F.lit("")).alias(n) for n, c in levels.items()), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), token_count(F.col("text")).alias("n_tokens"))
    epoch = F.explode(F.sequence(F.lit(1), F.lit(max_epochs))).alias("epoch")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), F.col("_id")))
    bucket = F.substring("_key", 1, 3)
    narrow = rows.select(*names, "_id", "n_tokens", epoch).withColumn("_key", key).withColumn("_bucket", bucket)
    sums = materialize(narrow.groupBy(*names, "epoch", "_bucket").agg(F.sum("n_tokens").alias("tokens")), "bucket-tokens")
    leaves = sums.where("epoch = 1").groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, names, weights, percent, max_epochs).where("budget > 0")
    part = F.least(F.greatest(F.col("budget") - (F.col("epoch") - 1) * F.col("tokens"), F.lit(0)), F.col("tokens"))
    plan = plan.select(*names, "budget", "tokens", epoch).withColumn("_quota", part).where("_quota > 0").select(*names, "epoch", "_quota")
    w = Window.partitionBy(*names, "epoch").orderBy("_bucket")
    run = sums.join(plan, [*names, "epoch"]).withColumn("_before", F.sum("tokens").over(w) - F.col("tokens")).where("_before < _quota")
    cuts = run.groupBy(*names, "epoch").agg(F.max(F.struct("_bucket", (F.col("_quota") - F.col("_before")).alias("left"))).alias("_cut"))
    cuts = materialize(cuts, "cuts")
    few = cuts.count() <= MAX_BROADCAST_LEAVES * max_epochs
    taken = rows.select("*", epoch).withColumn("_key", key).withColumn("_bucket", bucket).join(F.broadcast(cuts) if few else cuts, [*names, "epoch"])
    out = ["row", *names, "epoch", "n_tokens"]
    inside = taken.where("_bucket < _cut._bucket").select(*out)
    last = Window.partitionBy(*names, "epoch").orderBy("_key", "n_tokens")
    edge = taken.where("_bucket = _cut._bucket").withColumn("_before", F.sum("n_tokens").over(last.rowsBetween(Window.unboundedPreceding, -1)))
    return inside.unionByName(edge.where("coalesce(_before, 0) < _cut.left").select(*out))


def document_levels() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, epoch, domain, lang, source, n_tokens of documents' mixture with the parameters above."""
    m = mix(docs.select("doc_id", "text", "lang", "source"), document_levels())
    return m.select("row.doc_id", "epoch", *LEVELS, "n_tokens")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs in their columns: the rows that the mixture takes, once for each epoch."""
    return mix(docs, document_levels()).select("row.*")


def _sql() -> str:
    case = lambda col, named: f"case {' '.join(f'when {col} = {k!r} then {v}' for k, v in named.items())} else {OTHER} end" if named else str(OTHER)
    domain = f"case when regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})', 1) = '' then '{DOMAINS[-1]}' else ([{', '.join(map(repr, DOMAINS))}])[1 + cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})', 1), '') as int) % {len(DOMAINS)}] end"
    parts = [f"""d as (select doc_id, {domain} as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
  cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as n_tokens from documents)""",
             "leaves as (select domain, lang, source, cast(sum(n_tokens) as bigint) as tokens from d group by all)",
             f"b0 as (select cast(coalesce(sum(tokens), 0) * {BUDGET_PERCENT} // 100 as bigint) as budget from leaves)"]
    for i, level in enumerate(LEVELS):
        keys = LEVELS[:i]
        k = "".join(f"{x}, " for x in keys)
        by = f"partition by {', '.join(keys)} " if keys else ""
        parts += [
            f"c{i} as (select {k}{level} as name, cast(sum(tokens) * {MAX_EPOCHS} as bigint) as capacity, cast({case(level, WEIGHTS[level])} as bigint) as weight from leaves group by all)",
            f"r{i} as (select c{i}.*, budget, coalesce(sum(capacity) over ({by}order by capacity * 1.0::double / weight, name rows between unbounded preceding and 1 preceding), 0) as held, sum(weight) over ({by}order by capacity * 1.0::double / weight, name rows between current row and unbounded following) as w from c{i} " + (f"join b{i} using ({', '.join(keys)})" if keys else f"cross join b{i}") + ")",
            f"f{i} as (select *, capacity::hugeint * w <= weight::hugeint * (budget - held) as is_full from r{i})",
            f"b{i + 1} as (select {k}name as {level}, cast(case when is_full then capacity else weight::hugeint * (budget - coalesce(sum(capacity) filter (is_full) over ({by}), 0)) // greatest(coalesce(sum(weight) filter (not is_full) over ({by}), 0), 1) end as bigint) as budget from f{i})",
        ]
    n = len(LEVELS)
    parts += [
        f"plan as (select l.*, e.epoch, least(greatest(budget - (e.epoch - 1) * tokens, 0), tokens) as quota from leaves l join b{n} using ({', '.join(LEVELS)}) cross join (select cast(unnest(range(1, {MAX_EPOCHS + 1})) as int) as epoch) e)",
        f"o as (select d.*, epoch, quota, coalesce(sum(n_tokens) over (partition by domain, lang, source, epoch order by md5(concat('{SEED}:', epoch, ':', coalesce(cast(doc_id as varchar), ''))), n_tokens rows between unbounded preceding and 1 preceding), 0) as before from d join plan using (domain, lang, source))",
    ]
    return "with " + ",\n".join(parts) + "\nselect doc_id, epoch, domain, lang, source, n_tokens from o where before < quota"


MIXTURE_SQL = _sql()
