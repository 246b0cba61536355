"""Retrieval beyond BM25: features of a hit, its score and explanation, search by text, edges mined from clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.operators import knowledge

# Weights of the features; an explicit citation adds beside them.
WEIGHTS = {"bm25": 0.45, "clause_parameter": 0.2, "standard_parameter": 0.1, "product": 0.2, "context_product": 0.08, "document_cited": 0.12}
EXPLICIT, GATE = 0.6, 0.75


def rerank_features(hits: DataFrame, parameters: DataFrame, clause_parameters: DataFrame, terms: DataFrame, context: DataFrame, products: DataFrame, explicit: DataFrame, cited: DataFrame) -> DataFrame:
    """hits (qid, did, standard, score) with the features that rerank_full() weighs, one row a hit.

    parameters (qid, parameter) that a query states; clause_parameters (did, standard, parameter)
    that clauses govern; terms and context (qid, term), products (standard, term); explicit and cited
    (qid, standard). Parameter features count in full only near the best lexical score.
    """
    # What clauses and standards have comes to the hits as sets, then the hits go to their queries: three shuffles, each of one row a hit.
    gathered = lambda df, key, c, name: df.where(F.col(c).isNotNull()).groupBy(key).agg(F.collect_set(c).alias(name))
    out = hits.join(gathered(clause_parameters, "did", "parameter", "_own"), "did", "left")
    for had in (gathered(clause_parameters, "standard", "parameter", "_wide"), gathered(products, "standard", "term", "_products")):
        out = out.join(had, "standard", "left")
    for said in (gathered(parameters, "qid", "parameter", "_stated"), gathered(terms, "qid", "term", "_terms"), gathered(context, "qid", "term", "_context"), gathered(explicit, "qid", "standard", "_explicit"), gathered(cited, "qid", "standard", "_cited")):
        out = out.join(said, "qid", "left")
    out = out.withColumn("bm25", F.col("score") / F.greatest(F.max("score").over(Window.partitionBy("qid")), F.lit(1e-12)))
    gate = F.least(F.lit(1.0), F.col("bm25") / GATE)
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    governed, product = F.array_sort(F.array_intersect("_own", "_stated")), F.array_min(F.array_intersect("_products", "_terms"))
    sure, told = (F.coalesce(F.array_contains(name, F.col("standard")), F.lit(False)) for name in ("_explicit", "_cited"))
    return out.select(
        "qid", "did", "standard", "score", "bm25", (gate * yes(F.size(governed) > 0)).alias("clause_parameter"), (gate * yes(F.arrays_overlap("_wide", "_stated"))).alias("standard_parameter"), yes(product.isNotNull()).alias("product"),
        yes(F.arrays_overlap("_products", "_context")).alias("context_product"), yes(~sure & told).alias("document_cited"), sure.alias("explicit"), F.coalesce(governed, F.array().cast("array<string>")).alias("governed"), product.alias("product_term"),
    )


def rerank_full(features: DataFrame, standards: DataFrame, queries: DataFrame, competitors: DataFrame) -> DataFrame:
    """Adds raw and confidence, in the order of the rules: superseded x .5, test method off topic x .6 or on topic + .08, competitor of a cited standard x .75, out of domain x .6.

    standards (standard, status, kind), queries (qid, testing, known_products: whether it or its
    document names products), competitors (qid, standard). Explicit citations take no reduction.
    """
    rivals = competitors.groupBy("qid").agg(F.collect_set("standard").alias("_rivals"))
    # All that is known by query is settled where the features lie, then a hit goes to its standard.
    rival = F.coalesce(F.array_contains("_rivals", F.col("standard")), F.lit(False))
    base = sum((F.col(f) * w for f, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values()) + F.when(F.col("explicit"), EXPLICIT).otherwise(0.0)
    unknown = (F.col("product") == 0) & (F.col("context_product") == 0) & (F.col("document_cited") == 0)
    out = features.join(queries, "qid", "left").join(rivals, "qid", "left")
    out = out.select(*features.columns, base.alias("_base"), F.coalesce("testing", F.lit(False)).alias("_testing"), ((F.col("document_cited") == 0) & rival).alias("_rival"), (unknown & F.coalesce("known_products", F.lit(False))).alias("_foreign"))
    out = out.join(standards.select("standard", "status", "kind"), "standard", "left")
    raw = F.col("_base")
    free, test = ~F.col("explicit"), F.coalesce(F.col("kind") == "test_method", F.lit(False))
    testing = F.col("_testing")
    for condition, change in (
        (free & F.coalesce(F.col("status") == "superseded", F.lit(False)), lambda r: r * 0.5),
        (free & test & ~testing, lambda r: r * 0.6),
        (free & test & testing, lambda r: r + 0.08),
        (free & F.col("_rival"), lambda r: r * 0.75),
        (free & F.col("_foreign"), lambda r: r * 0.6),
    ):
        raw = F.when(condition, change(raw)).otherwise(raw)
    return out.withColumn("raw", F.round(raw, 9)).withColumn("confidence", F.least(F.greatest(F.col("raw"), F.lit(0.0)), F.lit(1.0))).select(*features.columns, "raw", "confidence")


def matched_terms(query: DataFrame, postings: DataFrame, most: int = 4) -> DataFrame:
    """(qid, did, matched): the query's tokens that a document shares, those of the largest gain first."""
    gains = knowledge.token_gains(query, postings)
    order = Window.partitionBy("qid", "did").orderBy(F.round("gain", 9).desc(), "token")
    first = gains.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return first.groupBy("qid", "did").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "token"))), lambda x: x["token"]).alias("matched"))


def explain_hits(hits: DataFrame) -> DataFrame:
    """(qid, did, number, heading, explicit, product_term, governed, matched) -> qid, did, explanation: a sentence for each reason, at least one."""
    reasons = F.filter(
        F.array(
            F.when(F.col("explicit"), F.concat(F.lit("The requirement cites "), "number", F.lit(" directly."))),
            F.when(F.col("product_term").isNotNull(), F.concat(F.lit("The "), "product_term", F.lit(" described in the requirement falls within the scope of "), "number", F.lit("."))),
            F.when(F.size("governed") > 0, F.concat(F.lit('The clause "'), "heading", F.lit('" governs '), F.array_join(F.transform("governed", lambda p: F.replace(p, F.lit("_"), F.lit(" "))), " and "), F.lit(", which the requirement specifies."))),
            F.when(F.size("matched") > 0, F.concat(F.lit("Shared technical terms: "), F.array_join(F.slice("matched", 1, 3), ", "), F.lit("."))),
        ),
        lambda x: x.isNotNull(),
    )
    return hits.select("qid", "did", F.when(F.size(reasons) > 0, F.array_join(reasons, " ")).otherwise(F.concat(F.lit("Lexical similarity with "), "number", F.lit("."))).alias("explanation"))


def search(query: DataFrame, postings: DataFrame, documents: DataFrame, domains: list[str] | None = None, years: tuple[int, int] | None = None, threshold: float = 0.2, top: int = 20, limit: int = 8) -> DataFrame:
    """(qid, standard, did, score, rank): the best document of each standard, of at least threshold of the query's best score, then filtered by domain and year.

    documents (did, standard, domain, year). The filters come after the first `top` standards, as a
    search page has them.
    """
    scores = knowledge.bm25(query, postings)
    best = scores.withColumn("confidence", F.col("score") / F.max("score").over(Window.partitionBy("qid"))).where(F.col("confidence") >= threshold)
    best = best.join(documents, "did")
    order = knowledge.best_first()
    one = best.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "standard").orderBy(*order))).where("_n = 1")
    kept = one.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("_n") <= top)
    if domains is not None:
        kept = kept.where(F.col("domain").isin(domains))
    if years is not None:
        kept = kept.where(F.col("year").between(*years))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("_n"))).where(F.col("rank") <= limit).select("qid", "standard", "did", "score", "rank")


def rank_clauses(query: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, did, rank) of every clause that shares a token with the query."""
    order = Window.partitionBy("qid").orderBy(*knowledge.best_first())
    return knowledge.bm25(query, postings).select("qid", "did", F.row_number().over(order).alias("rank"))


def mine_edges(relations: DataFrame, resolved: DataFrame, standards: DataFrame) -> DataFrame:
    """(type, src, dst, clause, confidence) from relations (clause, c_no, source, type, confidence) and resolved (clause, c_no, sid, confidence).

    Unresolved and self-references go; "replaces" in the text of a superseded standard runs the other
    way; of each (type, src, dst) the first in order of clause stays.
    """
    target = resolved.where("sid is not null").select("clause", "c_no", F.col("sid").alias("target"), F.col("confidence").alias("sure"))
    rows = relations.join(target, ["clause", "c_no"]).where("source <> target")
    old = standards.where("status = 'superseded'").select(F.col("sid").alias("source"), F.lit(True).alias("_old"))
    rows = rows.join(old, "source", "left")
    flip = (F.col("type") == "SUPERSEDES") & F.col("_old").isNotNull()
    edges = rows.select("type", F.when(flip, F.col("target")).otherwise(F.col("source")).alias("src"), F.when(flip, F.col("source")).otherwise(F.col("target")).alias("dst"), "clause", "c_no", (F.col("confidence") * F.col("sure")).alias("confidence"))
    first = edges.groupBy("type", "src", "dst").agg(F.min_by(F.struct("clause", "confidence"), F.struct("clause", "c_no")).alias("e"))
    return first.select("type", "src", "dst", "e.clause", "e.confidence")


def evidence_graph(mappings: DataFrame, clauses: DataFrame, applicable: DataFrame, edges: DataFrame, schemes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc, id, type) and edges (doc, type, src, dst, confidence) behind each document's findings, without repeats.

    mappings (doc, req, clause, confidence), clauses (clause, standard), applicable (doc, standard),
    edges (src, dst, type, confidence), schemes (standard, scheme). Dependencies count to depth 2,
    supersession both ways, references and relations one step out.
    """
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    mapped = mappings.join(clauses, "clause")
    out = mapped.select("doc", F.lit("MAPS_TO").alias("type"), name("req", "req").alias("src"), name("clause", "clause").alias("dst"), "confidence")
    out = out.unionByName(mapped.select("doc", F.lit("HAS_CLAUSE").alias("type"), name("std", "standard").alias("src"), name("clause", "clause").alias("dst"), F.lit(1.0).alias("confidence")))
    needs = edges.where("type in ('REQUIRES', 'TESTED_BY')")
    first = applicable.select("doc", F.col("standard").alias("src")).join(needs, "src")
    second = first.select("doc", F.col("dst").alias("src")).distinct().join(needs, "src")
    related = applicable.select("doc", F.col("standard").alias("src")).join(edges.where("type in ('REFERENCES', 'SUPERSEDES', 'RELATED_TO')"), "src")
    later = applicable.select("doc", F.col("standard").alias("dst")).join(edges.where("type = 'SUPERSEDES'"), "dst")
    for part in (first, second, related, later):
        out = out.unionByName(part.select("doc", "type", name("std", "src").alias("src"), name("std", "dst").alias("dst"), "confidence"))
    out = out.unionByName(applicable.join(schemes, "standard").select("doc", F.lit("CERTIFIED_BY").alias("type"), name("std", "standard").alias("src"), name("cert", "standard").alias("dst"), F.lit(0.8).alias("confidence")))
    out = out.groupBy("doc", "type", "src", "dst").agg(F.max("confidence").alias("confidence"))
    ends = out.select("doc", F.col("src").alias("id")).union(out.select("doc", "dst")).union(applicable.select("doc", name("std", "standard"))).distinct()
    kind = F.substring_index("id", ":", 1)
    return ends.select("doc", "id", F.when(kind == "req", "requirement").when(kind == "std", "standard").when(kind == "cert", "certification").otherwise(kind).alias("type")), out


def dependency_cards(reach: DataFrame, level: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row a standard: layer, canonical edition, what it depends on by depth, what requires it.

    reach (src, dst, depth) is the closure, level (node, layer), canonical (node, latest).
    """
    below = reach.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list(F.struct("depth", "dst"))).alias("depends"))
    above = reach.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_list("src")).alias("required_by"))
    text = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ","), F.lit(""))
    out = level.join(below, "node", "left").join(above, "node", "left").join(canonical, "node", "left")
    return out.select("node", "layer", F.coalesce("latest", "node").alias("canonical"), text("depends", lambda x: F.concat_ws("@", x["dst"], x["depth"])).alias("depends_on"), text("required_by", lambda x: x.cast("string")).alias("required_by"))

