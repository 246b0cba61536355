"""Evaluation metrics as aggregations over item tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions.scratch import drop, keep, none_left


def prf(tp: Column, fp: Column, fn: Column) -> Column:
    """Precision, recall and F1; nothing to find or found counts as 1."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def micro_prf(items: DataFrame, by: list[str]) -> DataFrame:
    sums = items.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return sums.withColumn("m", prf(F.col("tp"), F.col("fp"), F.col("fn"))).select(*by, "tp", "fp", "fn", "m.*")


def confusion(pairs: DataFrame) -> DataFrame:
    """(gold, predicted) -> per label tp, fp, fn; labels seen in either."""
    counts = pairs.groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("gold") == F.col("predicted")
    golds = counts.select(F.col("gold").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn"))
    wrong = counts.where(~hit).select(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("long").alias("fn"))
    return micro_prf(golds.unionByName(wrong), ["label"])


def classification_metrics(pairs: DataFrame) -> DataFrame:
    table = confusion(pairs)
    return table.agg((F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def mean_fields(items: DataFrame, fields: list[str]) -> DataFrame:
    """Means where a missing value is 0; no items give 0."""
    return items.agg(*[(F.coalesce(F.sum(F.coalesce(f, F.lit(0.0))), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(f) for f in fields])


def score_attributes(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(req, parameter, value): a gold attribute is found when a predicted one of its parameter is within 1 %."""
    near = F.abs(F.col("value") - F.col("stated")) <= F.abs(F.col("value")) * 0.01
    both = gold.join(predicted.select("req", "parameter", F.col("value").alias("stated")), ["req", "parameter"], "left").groupBy("req", "parameter", "value").agg(F.coalesce(F.bool_or(near), F.lit(False)).alias("found"), F.count("stated").alias("candidates"))
    per = both.groupBy("req").agg(F.count_if("found").alias("tp"), F.count_if(~F.col("found")).alias("fn"), F.sum("candidates").alias("candidates"))
    return per.select("req", "tp", F.greatest(F.col("candidates") - F.col("tp"), F.lit(0)).alias("fp"), "fn")


def finding_group(kind: Column, rule: Column) -> Column:
    return F.when(rule == "dependency_gap", "dependency").when(kind == "conflicting", "conflict").when(kind == "missing", "gap").otherwise(kind)


#: Cumulative chances of a Poisson number with mean 1, in millionths: so often an item is drawn in a replicate.
TIMES = (367_879, 735_759, 919_699, 981_012, 996_340, 999_406, 999_917)


def _times(x: Column) -> Column:
    """How often an item is drawn in a replicate: a Poisson number from a number below a million."""
    return sum((F.when(x >= limit, 1).otherwise(0) for limit in TIMES), F.lit(0))


def bootstrap_ci(items: DataFrame, value: str, samples: int = 1000) -> DataFrame:
    """2.5 and 97.5 percentiles of the mean over replicates; items (slot, value).

    Draws are Poisson: each item decides by itself how often it is in each replicate, by a hash of both
    that other engines have too. Items are dealt over tasks and meet their replicates in an array; only
    sums by replicate are shuffled, added up in each task first.
    """
    dealt = items.select("slot", F.col(value).alias("v")).repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "slot")
    each = dealt.select("v", "slot", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("b"))
    # The hash is a column of its own, behind another explode, so that it is taken once and not once a limit.
    hashed = F.conv(F.substring(F.md5(F.concat(F.col("b").cast("string"), F.lit(":"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long") % 1_000_000
    drawn = each.select("v", "b", F.explode(F.array(hashed)).alias("x")).select("v", "b", _times(F.col("x")).alias("times")).where("times > 0")
    means = drawn.groupBy("b").agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def paired_bootstrap(items: DataFrame, a: str, b: str, samples: int = 1000) -> DataFrame:
    """The interval of the difference of two means under the same draws."""
    return bootstrap_ci(items.select("slot", (F.col(b) - F.col(a)).alias("difference")), "difference", samples)


def retrieval_metrics(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, did, rank), (qid, did, grade) -> means of recall at 1, 3, 5, reciprocal rank, nDCG at 5; relevant from grade 2."""
    ranked = gold.join(hits, ["qid", "did"], "left")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    best = ranked.groupBy("qid").agg(F.min(F.when(F.col("grade") >= 2, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= 5, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.sort_array(F.collect_list(gain), asc=False).alias("gains"))
    ideal = F.aggregate(F.transform(F.slice("gains", 1, 5), lambda g, i: g / F.log2(i + 2.0)), F.lit(0.0), lambda x, y: x + y)
    at = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}")
    return best.withColumn("ideal", ideal).agg(at(1), at(3), at(5), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0)).alias("ndcg_5"))


def multiset_prf(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Matches of equal keys as often as both hold them."""
    g, p = gold.groupBy(*keys).agg(F.count(F.lit(1)).alias("g")), predicted.groupBy(*keys).agg(F.count(F.lit(1)).alias("p"))
    both = g.join(p, keys, "full").select(F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    sums = both.agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.col("p") - F.least("g", "p")).alias("fp"), F.sum(F.col("g") - F.least("g", "p")).alias("fn"))
    return sums.withColumn("m", prf(F.col("tp"), F.col("fp"), F.col("fn"))).select("tp", "fp", "fn", "m.*")


def mapping_accuracy(items: DataFrame) -> DataFrame:
    """(gold, predicted): accuracy over items that have a gold standard; null without any."""
    return items.agg((F.sum(F.when(F.col("gold").isNotNull(), (F.col("gold").eqNullSafe(F.col("predicted"))).cast("int"))) / F.nullif(F.count("gold"), F.lit(0))).alias("accuracy"), F.count("gold").alias("n"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(item, ok) of two runs -> how many items are gained, lost, new, removed or the same."""
    both = a.select("item", F.col("ok").alias("a")).join(b.select("item", F.col("ok").alias("b")), "item", "full")
    flip = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").when(F.col("b"), "gained").otherwise("lost")
    return both.groupBy(flip.alias("flip")).agg(F.count(F.lit(1)).alias("items"))


def compare_metrics(a: DataFrame, b: DataFrame, samples: int = 1000) -> DataFrame:
    """Items (task, item, metric, value) of two runs -> (task, metric, a, b, delta, low, high, mark).

    low and high bound 95 % of the differences of the means under the same draws of items, where both
    runs have the same items of a task, else they are null; mark is up or down where they exclude zero.
    Items are drawn as in bootstrap_ci(), by a hash of `replicate:item`. Missing values count as 0.
    """
    side = lambda df, name: df.select("task", "item", "metric", F.coalesce("value", F.lit(0.0)).alias(name), F.lit(True).alias(f"has_{name}"))
    both = keep(side(a, "a").join(side(b, "b"), ["task", "item", "metric"], "full"))
    means = both.groupBy("task", "metric").agg(F.avg("a").alias("a"), F.avg("b").alias("b")).where("a is not null and b is not null")
    alike = both.groupBy("task").agg(F.bool_and(F.col("has_a").isNotNull() & F.col("has_b").isNotNull()).alias("alike")).where("alike").select("task")
    pairs = both.join(alike, "task", "left_semi").select("task", "metric", "item", (F.col("b") - F.col("a")).alias("v"))
    each = pairs.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), "item").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    hashed = F.conv(F.substring(F.md5(F.concat(F.col("r").cast("string"), F.lit(":"), F.col("item").cast("string"))), 1, 8), 16, 10).cast("long") % 1_000_000
    drawn = each.select("task", "metric", "v", "r", F.explode(F.array(hashed)).alias("x")).select("task", "metric", "v", "r", _times(F.col("x")).alias("times")).where("times > 0")
    spread = drawn.groupBy("task", "metric", "r").agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("m"))
    ends = spread.groupBy("task", "metric").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    out = means.join(ends, ["task", "metric"], "left").withColumn("delta", F.col("b") - F.col("a"))
    mark = F.when((F.col("low") > 0) | (F.col("high") < 0), F.when(F.col("delta") > 0, "up").otherwise("down"))
    return out.select("task", "metric", "a", "b", "delta", "low", "high", mark.alias("mark"))


def item_flips(a: DataFrame, b: DataFrame) -> DataFrame:
    """Details (task, item, detail) of two runs -> (task, item, detail, flip): gained where only b has one, lost where only a has."""
    keys = ["task", "item", "detail"]
    one, two = a.select(*keys).distinct(), b.select(*keys).distinct()
    return two.join(one, keys, "left_anti").withColumn("flip", F.lit("gained")).unionByName(one.join(two, keys, "left_anti").withColumn("flip", F.lit("lost")))


def training_set(rows: DataFrame, share: int = 20) -> DataFrame:
    """(id, text) -> the first row of each normalised text, held out by a hash of it for share percent."""
    norm = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    first = rows.groupBy(norm.alias("norm")).agg(F.min("id").alias("id"))
    return first.select("id", (F.conv(F.substring(F.md5("norm"), 1, 8), 16, 10).cast("long") % 100 < share).alias("held_out"))


def tune_gate(rows: DataFrame, steps: int = 21) -> DataFrame:
    """(gold, lexicon, confidence, model) -> accuracy of the gated category at each threshold of a grid, best first by (accuracy, -threshold)."""
    grid = rows.sparkSession.range(steps).select((F.col("id") / (steps - 1)).alias("threshold"))
    # A row's outcome only depends on the side of the threshold: counts by confidence step, not a copy of rows a threshold.
    counted = rows.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("lexicon")).alias("lexicon_ok"), F.count_if(F.col("gold") == F.col("model")).alias("model_ok"))
    ok = F.when(F.col("confidence") >= F.col("threshold"), F.col("lexicon_ok")).otherwise(F.col("model_ok"))
    return counted.join(F.broadcast(grid)).groupBy("threshold").agg((F.sum(ok) / F.sum("n")).alias("accuracy"))


def quality_gate(metrics: DataFrame, floors: DataFrame) -> DataFrame:
    """(dataset, metric, value) below their floor (metric, floor)."""
    return metrics.join(floors, "metric").where("value < floor")


def greedy_match(candidates: DataFrame) -> DataFrame:
    """(doc, gold, predicted) candidate pairs -> one-to-one: golds in order take their first free prediction, document by document.

    In rounds: a pair that is the first of both its gold and its prediction, among the pairs left, is
    what the golds one after the other would take; it is taken, and all pairs of its two ends go.
    Each round takes at least one pair of every document that has any left; rounds are as many as golds
    of one document wait for each other. Repeated pairs count once; pairs with a null are left out.
    """
    left = keep(candidates.select("doc", "gold", "predicted").where("doc is not null and gold is not null and predicted is not null").distinct())
    taken = [left.limit(0)]
    while not none_left(left):
        first = left.groupBy("doc", "gold").agg(F.min("predicted").alias("predicted"))
        suitor = left.groupBy("doc", "predicted").agg(F.min("gold").alias("gold"))
        pairs = keep(first.join(suitor, ["doc", "gold", "predicted"]).select("doc", "gold", "predicted"))
        taken.append(pairs)
        rest = keep(left.join(pairs.select("doc", "gold"), ["doc", "gold"], "left_anti").join(pairs.select("doc", "predicted"), ["doc", "predicted"], "left_anti").select("doc", "gold", "predicted"))
        drop(left)
        left = rest
    out = taken[0]
    for pairs in taken[1:]:
        out = out.unionByName(pairs)
    return out


def _ranked_tokens(sides: list[DataFrame]) -> list[DataFrame]:
    """Adds sorted: the tokens of each row from the rarest of its document to the commonest, ties by token; repeats go."""
    used = sides[0].select("doc", F.explode(F.array_distinct("tokens")).alias("token"))
    for side in sides[1:]:
        used = used.unionByName(side.select("doc", F.explode(F.array_distinct("tokens")).alias("token")))
    counts = used.groupBy("doc", "token").agg(F.count(F.lit(1)).alias("df"))
    out = []
    for side in sides:
        one = side.withColumn("_row", F.monotonically_increasing_id())
        one = keep(one)
        each = one.select("doc", "_row", F.explode(F.array_distinct("tokens")).alias("token")).join(counts, ["doc", "token"])
        order = each.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("sorted"))
        out.append(one.join(order, "_row").drop("_row", "tokens"))
    return out


def text_match_candidates(gold: DataFrame, predicted: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc, gid, tokens array), (doc, pid, tokens array): pairs within a document of enough token Jaccard, or where one set of tokens contains the other.

    Tokens are ordered by how few texts of the document have them. Of two sets of enough Jaccard the
    first n - ceil(least * n) + 1 tokens of each have one in common; a contained set has its first token
    in the other. Only pairs that meet so are counted, so a token of all texts brings none together
    unless a text has no other. Sizes that rule out both are dropped before tokens are compared.
    Rows without tokens match nothing; repeated rows of equal ids and tokens count once.
    """
    g, p = (keep(side) for side in _ranked_tokens([gold.select("doc", F.col("gid").alias("id"), "tokens").distinct(), predicted.select("doc", F.col("pid").alias("id"), "tokens").distinct()]))
    n = F.size("sorted")
    prefix = F.slice("sorted", 1, n - F.ceil(n * least - 1e-9).cast("int") + 1)
    first, whole, met = F.slice("sorted", 1, 1), F.col("sorted"), None
    near = (F.col("n") >= F.col("m") * least) & (F.col("m") >= F.col("n") * least)
    for own, other, fits in ((prefix, prefix, near), (first, whole, F.col("n") <= F.col("m")), (whole, first, F.col("m") <= F.col("n"))):
        a = g.select("doc", F.col("id").alias("gid"), n.alias("n"), F.explode(own).alias("token"))
        b = p.select("doc", F.col("id").alias("pid"), n.alias("m"), F.explode(other).alias("token"))
        pairs = a.join(b, ["doc", "token"]).where(fits).select("doc", "gid", "pid")
        met = pairs if met is None else met.unionByName(pairs)
    both = met.distinct().join(g.select("doc", F.col("id").alias("gid"), F.col("sorted").alias("a")), ["doc", "gid"]).join(p.select("doc", F.col("id").alias("pid"), F.col("sorted").alias("b")), ["doc", "pid"])
    counted = both.withColumn("k", F.size(F.array_intersect("a", "b"))).withColumn("n", F.size("a")).withColumn("m", F.size("b"))
    jaccard = F.col("k") / (F.col("n") + F.col("m") - F.col("k"))
    return counted.where((jaccard >= least) | (F.col("k") == F.least("n", "m"))).select("doc", "gid", "pid", F.round(jaccard, 6).alias("jaccard")).distinct()


def _paired(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(doc, gid, pid): the nth gold of each key with its nth prediction."""
    number = lambda by, one: F.row_number().over(Window.partitionBy(*by).orderBy(one))
    g = gold.withColumn("_n", number(keys, "gid")).select(*keys, "_n", "gid")
    return g.join(predicted.withColumn("_n", number(keys, "pid")).select(*keys, "_n", "pid"), [*keys, "_n"]).select("doc", "gid", "pid")


def match_findings(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc, gid, pid) one to one: gold items that name standard and parameter first, then only one of them, then neither.

    gold (doc, gid, grp, standard, parameter; the last two may be null), predicted (doc, pid, grp,
    standard, parameter). So a generic gold item takes no finding that belongs to a specific one.
    """
    named = {"standard": F.col("standard").isNotNull(), "parameter": F.col("parameter").isNotNull()}
    found, left = None, predicted
    for keys in (["standard", "parameter"], ["standard"], ["parameter"], []):
        mine = gold
        for c, condition in named.items():
            mine = mine.where(condition if c in keys else ~condition)
        hit = keep(_paired(mine, left, ["doc", "grp", *keys]))
        found = hit if found is None else found.union(hit)
        left = left.join(hit.select("doc", "pid"), ["doc", "pid"], "left_anti")
    return found


def ablation_grid(features: DataFrame, options: DataFrame, weights: list[str], threshold: float = 0.35) -> DataFrame:
    """One row an option set: its kept hits and mean score, of the same hits under each row of options (option, weights).

    Options are a table of fixed, small size; hits are read once and scored under each of them.
    """
    each = features.join(F.broadcast(options.select("option", *[F.col(w).alias(f"_{w}") for w in weights])))
    raw = sum((F.col(w).cast("double") * F.col(f"_{w}") for w in weights), F.lit(0.0)) / sum((F.col(f"_{w}") for w in weights), F.lit(0.0))
    return each.groupBy("option").agg(F.count_if(raw >= threshold).alias("kept"), F.avg(raw).alias("mean_score"))


def resolution_accuracy(cases: DataFrame, resolved: DataFrame) -> DataFrame:
    """cases (cid, expected, edition) against resolved (cid, sid, edition): the shares of right records and right editions."""
    both = cases.select("cid", "expected", F.col("edition").alias("wanted")).join(resolved.select("cid", "sid", "edition"), "cid", "left")
    ok = lambda a, b: F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double"))
    return both.agg(ok("expected", "sid").alias("record_accuracy"), ok("wanted", "edition").alias("edition_accuracy"), F.count(F.lit(1)).alias("n"))


def graph_prf(mined: DataFrame, curated: DataFrame) -> DataFrame:
    """Per source of an edge: typed matches, spurious and missed edges, untyped matches. curated (type, src, dst, supported): only edges that a text supports can be missed."""
    keys = ["type", "src", "dst"]
    pairs = curated.select("src", "dst").distinct().withColumn("_pair", F.lit(True))
    ours = mined.select(*keys).distinct().join(curated.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left").join(pairs, ["src", "dst"], "left")
    hits = ours.groupBy("src").agg(F.count("_hit").alias("edge_tp"), F.count_if(F.col("_hit").isNull()).alias("edge_fp"), F.count("_pair").alias("pair_tp"), F.count_if(F.col("_pair").isNull()).alias("pair_fp"))
    missed = curated.where("supported").select(*keys).distinct().join(mined.select(*keys).distinct(), keys, "left_anti").groupBy("src").agg(F.count(F.lit(1)).alias("edge_fn"))
    names = ["edge_tp", "edge_fp", "edge_fn", "pair_tp", "pair_fp"]
    return hits.join(missed, "src", "full").select("src", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def run_index(metrics: DataFrame, chosen: list[str]) -> DataFrame:
    """(run, metric, value) -> one row a run with the chosen metrics as columns."""
    return metrics.groupBy("run").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in chosen])


def split_filter(items: DataFrame, splits: DataFrame, role: str | None = None) -> DataFrame:
    """Items of the splits (split, role) with the role asked for; without one, all but blind ones."""
    wanted = splits.where(F.col("role") == role) if role is not None else splits.where("role <> 'blind'")
    return items.join(wanted.select("split").distinct(), "split", "left_semi")


def detail_lists(gold: DataFrame, predicted: DataFrame, matches: DataFrame, most: int = 140) -> DataFrame:
    """(doc, missed, spurious): texts without a partner, in order, each cut for review at `most` characters."""
    cut = F.substring("text", 1, most)
    listed = lambda df, one, name: df.join(matches.select("doc", one), ["doc", one], "left_anti").groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct(one, cut.alias("t")))), lambda x: x["t"]).alias(name))
    both = listed(gold, "gid", "missed").join(listed(predicted, "pid", "spurious"), "doc", "full")
    empty = F.array().cast("array<string>")
    return both.select("doc", F.coalesce("missed", empty).alias("missed"), F.coalesce("spurious", empty).alias("spurious"))
