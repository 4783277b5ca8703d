"""Mixing sources to target weights: hierarchical budgets, then a token-prefix of seeded epochs from each leaf.

The tree is domain, language, source. A node's capacity is its tokens times max_epochs. From the root down,
each node's budget is dealt among its children by weight; what a child can't hold goes to its siblings by
weight, and only what they can't hold either was, one level up, dealt to the node's own siblings. Budgets
are whole numbers, found in closed form with window functions over the children of one node.

A leaf with budget b over t tokens takes b // t whole epochs, and of the next one the prefix, in the order
of md5(seed:epoch:id), whose running sum of tokens stays within what is left. The running sum is taken in
steps: over 16 ** bucket_digits hash buckets, over as many inside the one where the prefix ends, and then over
the rows of the one among those, so no task orders a leaf.

Native DataFrame operations only. Defined results: null and blank texts have 0 tokens and take no budget;
null language or source is its own node, named (none); sources that the tree doesn't name are of domain other;
rows with equal ids share their place and are taken together; a null id has the place of an empty one;
empty tables give empty results; extra columns stay, clashing ones are replaced.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import col, drop_stored, packed, read_table, stored, unpacked, words

NAME = "op10_mix_sources"
LEAF = ["domain", "lang_node", "source_node"]


@dataclass(frozen=True)
class Mix:
    """Whole-number weights; a name that is not listed weighs 1."""

    domains: dict = field(default_factory=lambda: {**{f"src{i}": "web" for i in range(12)}, **{f"src{i}": "books" for i in range(12, 16)}, **{f"src{i}": "reference" for i in range(16, 20)}})
    domain_weights: dict = field(default_factory=lambda: {"web": 60, "books": 25, "reference": 10, "other": 5})
    lang_weights: dict = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    source_weights: dict = field(default_factory=dict)
    #: The mixture's tokens, as parts of 100 of the input's.
    percent: int = 80
    max_epochs: int = 2
    seed: str = "mix-1"
    #: Hex digits of the order's hash that make a bucket, and again a bucket inside it.
    bucket_digits: int = 2


def _lookup(names: dict, col: Column, other) -> Column:
    out = F.lit(other)
    for value in sorted(set(names.values()), key=str):
        out = F.when(col.isin([k for k, v in names.items() if v == value]), F.lit(value)).otherwise(out)
    return out


def _deal(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes(parent..., name, w, cap, budget of the parent) -> give, by weight within each parent, none beyond its cap."""
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # by cap / w, the full ones come first; left: weight and budget without those before
    ordered = w.orderBy(F.col("cap") / F.col("w"), name)
    nodes = nodes.withColumn("cap_to", F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    nodes = nodes.withColumn("w_from", F.sum("w").over(w) - F.sum("w").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) + F.col("w"))
    nodes = nodes.withColumn("open", (F.col("budget") - F.col("cap_to")) * F.col("w") <= F.col("cap") * F.col("w_from"))
    first = lambda c: F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("r"), name, F.col(c).alias("v")))).over(w)["v"]
    nodes = nodes.withColumns({"at_cap": first("cap_to"), "at_w": first("w_from")})
    share = F.expr("(budget - at_cap) * w div at_w")
    return nodes.withColumn("give", F.when(F.col("at_w").isNull(), F.col("cap")).otherwise(F.least("cap", share))).drop("cap_to", "w_from", "open", "at_cap", "at_w")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves(domain, lang_node, source_node, tokens) with give, the leaf's budget in tokens."""
    cap = F.col("tokens") * F.lit(mix.max_epochs)
    leaves = leaves.withColumn("cap", cap)
    weigh = lambda names, c: _lookup(names, F.col(c), 1).cast("long")
    d = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    d = d.withColumn("budget", F.expr(f"sum(tokens) OVER (PARTITION BY 0) * {mix.percent} div 100")).withColumn("w", weigh(mix.domain_weights, "domain"))
    d = _deal(d, [], "domain").select("domain", F.col("give").alias("budget"))
    g = leaves.groupBy("domain", "lang_node").agg(F.sum("cap").alias("cap")).join(d, "domain").withColumn("w", weigh(mix.lang_weights, "lang_node"))
    g = _deal(g, ["domain"], "lang_node").select("domain", "lang_node", F.col("give").alias("budget"))
    s = leaves.join(g, ["domain", "lang_node"]).withColumn("w", weigh(mix.source_weights, "source_node"))
    return _deal(s, ["domain", "lang_node"], "source_node").select(*LEAF, "tokens", "give")


def mixed(docs: DataFrame, mix: Mix = Mix(), id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs with n_tokens (words), domain, lang_node, source_node and copies: how often the mixture holds the row."""
    made, none = [*LEAF, "n_tokens", "copies"], F.lit("(none)")
    where = F.coalesce(col(source), none)
    rows = packed(
        docs,
        made,
        name=F.coalesce(col(id).cast("string"), F.lit("")),
        n_tokens=F.size(words(col(text))).cast("long"),
        domain=_lookup(mix.domains, where, "other"),
        lang_node=F.coalesce(col(lang), none),
        source_node=where,
    )
    narrow = stored(rows.select("name", "n_tokens", *LEAF), "op10-rows")
    plan = budgets(narrow.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), mix)
    plan = plan.select(*LEAF, F.expr("if(tokens = 0, 0, give div tokens)").alias("whole"), F.expr("if(tokens = 0, 0, give % tokens)").alias("left"))
    plan = stored(plan.withColumns({"end": F.lit(""), "before": F.lit(0).cast("long")}), "op10-plan")
    digits = mix.bucket_digits
    key = F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("whole").cast("string"), F.col("name")).cast("binary"))

    for length in (digits, 2 * digits):
        # of the rows in a leaf's bucket so far, sums by the next digits; end: the bucket where the prefix ends, null if it doesn't
        inside = narrow.join(plan, LEAF).withColumn("key", key).where(F.col("key").startswith(F.col("end")))
        sums = inside.groupBy(*LEAF, F.substring("key", 1, length).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.first("left").alias("left"), F.first("before").alias("before"))
        sums = sums.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bucket"))).where("upto > left")
        ends = sums.groupBy(*LEAF).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")), F.col("bucket")).alias("e"))
        before, plan = plan, stored(plan.drop("end", "before").join(ends, LEAF, "left").select(*LEAF, "whole", "left", F.col("e.bucket").alias("end"), F.col("e.before").alias("before")), "op10-plan")
        drop_stored(before)
    bucket = F.substring("key", 1, 2 * digits)
    last = narrow.join(plan, LEAF).withColumn("key", key).where(bucket == F.col("end"))
    last = last.withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("key", "name"))).where("upto <= left")
    last = stored(last.select(*LEAF, "name", F.lit(1).alias("took")).distinct(), "op10-inside")
    drop_stored(narrow)
    out = rows.join(plan, LEAF).withColumn("key", key).join(last, [*LEAF, "name"], "left")
    more = F.when(F.col("whole") >= mix.max_epochs, 0).when(F.col("end").isNull() | (bucket < F.col("end")), 1).otherwise(F.coalesce("took", F.lit(0)))
    return unpacked(out.withColumn("copies", F.col("whole") + more), *made)


def query(spark, sf_dir):
    out = mixed(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", F.col("domain"), F.col("lang_node"), F.col("source_node"), "n_tokens", "copies")


def _sql(mix: Mix = Mix(), documents: str = "documents") -> str:
    def case(names, col, other):
        return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in names.items()) + f" ELSE {other!r} END" if names else repr(other)

    def deal(name, parent, src):
        by = f"PARTITION BY {parent}" if parent else ""
        return f"""
{name}_a AS (SELECT *, cap::DOUBLE / w AS r FROM {src}),
{name}_b AS (SELECT *, sum(cap) OVER (x ROWS UNBOUNDED PRECEDING) - cap AS cap_to, sum(w) OVER ({by}) - sum(w) OVER (x ROWS UNBOUNDED PRECEDING) + w AS w_from FROM {name}_a WINDOW x AS ({by} ORDER BY r, node)),
{name}_c AS (SELECT *, min(CASE WHEN (budget - cap_to) * w <= cap * w_from THEN cap_to END) OVER ({by}) AS at_cap, max(CASE WHEN (budget - cap_to) * w <= cap * w_from THEN w_from END) OVER ({by}) AS at_w FROM {name}_b),
{name} AS (SELECT *, CASE WHEN at_w IS NULL THEN cap ELSE least(cap, (budget - at_cap) * w // at_w) END AS give FROM {name}_c)"""

    return f"""
WITH t AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS name, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))::BIGINT AS n_tokens,
  {case(mix.domains, "coalesce(source, '(none)')", "other")} AS domain, coalesce(lang, '(none)') AS lang_node, coalesce(source, '(none)') AS source_node FROM {documents}),
l AS (SELECT domain, lang_node, source_node, sum(n_tokens)::HUGEINT AS tokens FROM t GROUP BY ALL),
d0 AS (SELECT domain AS node, sum(tokens) * {mix.max_epochs} AS cap, (SELECT sum(tokens) FROM l) * {mix.percent} // 100 AS budget, {case(mix.domain_weights, "domain", 1)} AS w FROM l GROUP BY domain),
{deal("d", "", "d0")},
g0 AS (SELECT l.domain, lang_node AS node, sum(tokens) * {mix.max_epochs} AS cap, any_value(d.give) AS budget, {case(mix.lang_weights, "lang_node", 1)} AS w FROM l JOIN d ON d.node = l.domain GROUP BY l.domain, lang_node),
{deal("g", "domain", "g0")},
s0 AS (SELECT l.domain, l.lang_node, source_node AS node, tokens, tokens * {mix.max_epochs} AS cap, g.give AS budget, {case(mix.source_weights, "source_node", 1)} AS w FROM l JOIN g ON g.domain = l.domain AND g.node = l.lang_node),
{deal("s", "domain, lang_node", "s0")},
e AS (SELECT t.*, s.tokens, s.give, k.epoch, sum(n_tokens) OVER (PARTITION BY t.domain, t.lang_node, t.source_node, k.epoch ORDER BY md5('{mix.seed}:' || k.epoch || ':' || name), name) + k.epoch * s.tokens AS upto
  FROM t JOIN s ON s.domain = t.domain AND s.lang_node = t.lang_node AND s.node = t.source_node, range({mix.max_epochs}) k(epoch)),
c AS (SELECT DISTINCT domain, lang_node, source_node, name, epoch FROM e WHERE upto <= give)
SELECT doc_id, domain, lang_node, source_node, n_tokens, (SELECT count(*) FROM c WHERE c.name = t.name AND c.domain = t.domain AND c.lang_node = t.lang_node AND c.source_node = t.source_node)::BIGINT AS copies FROM t
"""


ORACLE_SQL = _sql()
