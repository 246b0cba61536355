"""Typed graph operators over an edge table (src, dst[, type, confidence]); rounds grow with depth, never with a node's degree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions.numeric import half_up
from clausemill.functions.scratch import Dealt, dealt, drop, keep, none_left

CONFIDENCE_FLOOR = 0.7
#: Tasks over which the pairs of one chain of editions are spread.
FAMILY_SLICES = 8
#: Edges of a node in one array of the evidence paths; paths a task before they branch; pairs of confidence and currency that a byte tells apart.
BUNDLE, FRONT_ROWS, GRADES = 256, 20_000, 128


def neighbors(edges: DataFrame, nodes: DataFrame, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(node) -> (node, neighbor, type) by outgoing or incoming edges of the given types."""
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    found = edges if types is None else edges.where(F.col("type").isin(types))
    return found.join(nodes, found[near] == nodes["node"]).select("node", F.col(far).alias("neighbor"), "type")


def latest_replacement(supersedes: DataFrame) -> DataFrame:
    """(src replaces dst) -> (node, latest, hops), by pointer doubling; a node in a cycle stays with itself.

    A node that several replace follows the least of them.
    """
    step = supersedes.where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("latest")).withColumn("hops", F.lit(1).cast("long"))
    state = keep(step)
    limit = state.count()  # no chain is longer than the table
    reached = 1
    while reached <= limit:
        onward = state.select(F.col("node").alias("latest"), F.col("latest").alias("next"), F.col("hops").alias("more"))
        state = keep(state.join(onward, "latest", "left").select("node", F.coalesce("next", "latest").alias("latest"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
        reached *= 2
        if not state.join(onward.select("latest"), "latest", "left_semi").limit(1).count():
            break
    # Whoever still points at a node with a successor circles.
    circling = state.join(step.select(F.col("node").alias("latest")), "latest", "left_semi").select("node")
    return state.join(circling, "node", "left_anti").unionByName(circling.select("node", F.col("node").alias("latest"), F.lit(0).cast("long").alias("hops")))


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """All reachable pairs (src, dst, depth) by shortest path: each round extends only the pairs that are new.

    Known pairs lie in buckets and edges by their source, so that a round moves its own pairs alone:
    once to the edges that extend them, once to the bucket in which they are looked up. Nothing is
    broadcast, or each round would send its tables to the driver.
    """
    step = dealt(edges.select("src", "dst").distinct(), "src")
    onward = step.select(F.col("src").alias("dst"), F.col("dst").alias("next")).hint("merge")
    known = Dealt(step.withColumn("depth", F.lit(1)), ["src", "dst"], "depth")
    d = 1
    while depth is None or d < depth:
        frontier = known.table().where(F.col("depth") == d)
        d += 1
        new = frontier.join(onward, "dst").select("src", F.col("next").alias("dst")).distinct().join(known.table().select("src", "dst").hint("merge"), ["src", "dst"], "left_anti")
        known.add(new.withColumn("depth", F.lit(d)))
        if none_left(known.table().where(F.col("depth") == d)):
            break
    return known.table().select("src", "dst", "depth")


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth): reachability on reversed edges."""
    return closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("src").alias("node"), F.col("dst").alias("ancestor"), "depth")


def contract_supersession(edges: DataFrame, supersedes: DataFrame, floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """Edges of enough confidence between the latest editions; self-loops and repeats dropped."""
    latest = latest_replacement(supersedes).select("node", "latest")
    out = edges.where(F.col("confidence") >= floor)
    for end in ("src", "dst"):
        out = out.join(latest.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("latest", end)).drop("latest")
    return out.where("src <> dst").select("src", "dst").distinct()


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Chains of nodes with one edge in and one out become one edge each: (edges, chains, rings), or None where there are no such nodes.

    chains (node, src, dst): the inner nodes of a chain and its two ends. rings (node, component): nodes
    of cycles without any other edge. Ends are found by pointer doubling, in rounds that grow with the
    logarithm of the longest chain.
    """
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.min("dst").alias("next"))
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.min("src").alias("before"))
    inner = keep(outs.join(ins, "node").where("outs = 1 and ins = 1").select("node", "next", "before"))
    n = inner.count()
    if not n:
        return None
    known = inner.select(F.col("node").alias("next"), F.lit(True).alias("_inner"))
    # last: the last inner node of the chain, once ended; low: the least node on the way there.
    state = keep(inner.join(known, "next", "left").select("node", F.when(F.col("_inner"), F.col("next")).otherwise(F.col("node")).alias("last"), F.col("_inner").isNull().alias("ended"), F.col("node").alias("low")))
    reached = 1
    while reached <= 2 * n and not none_left(state.where("not ended")):
        jump = state.select(F.col("node").alias("last"), F.col("last").alias("_last"), F.col("ended").alias("_ended"), F.col("low").alias("_low"))
        moved = state.where("not ended").join(jump, "last").select("node", F.col("_last").alias("last"), F.col("_ended").alias("ended"), F.least("low", "_low").alias("low"))
        new = keep(state.where("ended").unionByName(moved))
        drop(state)
        state, reached = new, 2 * reached
    rings = state.where("not ended").select("node", F.col("low").alias("component"))
    chains = state.where("ended").select("node", F.col("last").alias("chain"))
    heads = inner.join(inner.select(F.col("node").alias("before")), "before", "left_anti").select("node", "before").join(chains, "node").select("chain", F.col("before").alias("src"))
    tails = inner.select(F.col("node").alias("chain"), F.col("next").alias("dst")).join(heads, "chain").select("chain", "src", "dst")
    chains = keep(chains.join(tails, "chain").select("node", "src", "dst"))
    rings = keep(rings)
    nodes = inner.select("node")
    rest = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_anti").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_anti")
    left = keep(rest.unionByName(chains.select("src", "dst").where("src <> dst")).distinct())
    drop(inner, state)
    return left, chains, rings


def _labelled(edges: DataFrame) -> DataFrame:
    """(node, low, high): the least node that reaches a node, and the least that it reaches, along edges, itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    state = keep(nodes.select("node", F.col("node").alias("low"), F.col("node").alias("high")))
    while True:
        low = edges.join(state.select(F.col("node").alias("src"), "low"), "src").select(F.col("dst").alias("node"), F.col("low").alias("_low"), F.lit(None).cast(state.schema["high"].dataType).alias("_high"))
        high = edges.join(state.select(F.col("node").alias("dst"), "high"), "dst").select(F.col("src").alias("node"), F.lit(None).cast(state.schema["low"].dataType).alias("_low"), F.col("high").alias("_high"))
        heard = low.unionByName(high).groupBy("node").agg(F.min("_low").alias("_low"), F.min("_high").alias("_high"))
        less = state.join(heard, "node", "left").select("node", F.least("low", "_low").alias("low"), F.least("high", "_high").alias("high"), (F.least("low", "_low") < F.col("low")).alias("_a"), (F.least("high", "_high") < F.col("high")).alias("_b"))
        new = keep(less)
        drop(state)
        state = new
        if none_left(state.where("_a or _b")):
            return state.drop("_a", "_b")


def find_cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components with more than one node; component is the least node.

    In rounds: chains are contracted, edges at nodes without an edge in or out are dropped, and where
    that changes nothing more, each node is coloured by the least node that reaches it and the least
    that it reaches. Nodes whose two colours are one node are its component; edges between different
    colours lie on no cycle. No closure is built: all tables are as large as the edges at most. Rounds
    grow with the longest way of the contracted graph. Null ends and loops on one node are left out.
    """
    left = keep(edges.select("src", "dst").where("src <> dst").distinct())
    nothing = left.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    found, levels = [nothing], []
    while not none_left(left):
        made = _contracted(left)
        if made is not None:
            drop(left)
            left, chains, rings = made
            levels.append(chains)
            found.append(rings)
        trimmed = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        trimmed = keep(trimmed.select("src", "dst"))
        changed = made is not None or trimmed.count() < left.count()
        drop(left)
        left = trimmed
        if changed or none_left(left):
            continue
        colours = _labelled(left)
        whole = keep(colours.where("low = high").select("node", F.col("low").alias("component")))
        found.append(whole)
        ends = colours.where("low <> high")
        a, b = ends.select(F.col("node").alias("src"), "low", "high"), ends.select(F.col("node").alias("dst"), "low", "high")
        kept = keep(left.join(a, "src").join(b, ["dst", "low", "high"]).select("src", "dst"))
        drop(left, colours)
        left = kept
    drop(left)
    known = found[0]
    for f in found[1:]:
        known = known.unionByName(f)
    known = keep(known)
    # The inner nodes of a chain belong to the component of its ends, if they have one; last contractions first.
    for chains in reversed(levels):
        src, dst = known.select(F.col("node").alias("src"), F.col("component").alias("_a")), known.select(F.col("node").alias("dst"), F.col("component").alias("_b"))
        closed = chains.join(src, "src", "left").join(dst, "dst", "left").where(F.coalesce("_a", "src") == F.coalesce("_b", "dst"))
        more = closed.select("node", F.coalesce("_a", "src").alias("component")).unionByName(closed.where("_a is null").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct())
        new = keep(known.unionByName(more))
        drop(known, chains)
        known = new
    groups = known.distinct().groupBy("component").agg(F.min("node").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return known.distinct().join(groups, "component").select("node", F.col("_least").alias("component"))


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer): the longest path to a node without outgoing edges; nodes that reach a cycle are left out.

    Each round takes the nodes whose targets all have a layer.
    """
    edges = keep(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    done = keep(nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti").withColumn("layer", F.lit(0)))
    left = keep(edges)
    while True:
        waits = left.join(done.select(F.col("node").alias("dst"), "layer"), "dst", "left").groupBy("src").agg(F.max("layer").alias("layer"), F.count_if(F.col("layer").isNull()).alias("waiting"))
        ready = keep(waits.where("waiting = 0").select(F.col("src").alias("node"), (F.col("layer") + 1).alias("layer")))
        if not ready.limit(1).count():
            return done
        done = keep(done.unionByName(ready))
        left = keep(left.join(ready.select(F.col("node").alias("src")), "src", "left_anti"))


def transitive_reduction(edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """Edges u -> v without those for which another u -> x reaches v. reach: the closure of the edges, where it is there already."""
    edges = keep(edges.select("src", "dst").distinct())
    reach = (closure(edges) if reach is None else reach).select(F.col("src").alias("mid"), "dst")
    longer = edges.select("src", F.col("dst").alias("mid")).join(reach, "mid").where("mid <> dst").select("src", "dst").join(edges, ["src", "dst"], "left_semi").distinct()
    return edges.join(longer, ["src", "dst"], "left_anti")


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, closure pairs, pairs only transitive, deepest layer, edges of the reduction."""
    edges = keep(edges.select("src", "dst").distinct())
    reach, level = closure(edges), layers(edges)
    reduced = transitive_reduction(edges, reach)
    one = edges.agg(F.count(F.lit(1)).alias("edges")).crossJoin(reach.agg(F.count(F.lit(1)).alias("closure_pairs"), F.count_if(F.col("depth") > 1).alias("transitive_only")))
    return one.crossJoin(level.agg(F.count(F.lit(1)).alias("nodes"), F.max("layer").alias("deepest"))).crossJoin(reduced.agg(F.count(F.lit(1)).alias("reduced_edges")))


def dag_export(edges: DataFrame) -> DataFrame:
    """Reduced edges with the layers of their ends."""
    level = layers(edges)
    out = transitive_reduction(edges)
    for end in ("src", "dst"):
        out = out.join(level.select(F.col("node").alias(end), F.col("layer").alias(f"{end}_layer")), end)
    return out.select("src", "dst", "src_layer", "dst_layer")


def neighborhood(edges: DataFrame, centers: DataFrame, depth: int = 2) -> DataFrame:
    """(center, node, distance) within depth undirected steps of each center (node)."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).union(edges.select("dst", "src")).distinct()
    out = centers.select(F.col("node").alias("center"), "node", F.lit(0).alias("distance"))
    front = out
    for d in range(1, depth + 1):
        front = front.join(both, "node").select("center", F.col("next").alias("node")).distinct().join(out, ["center", "node"], "left_anti").withColumn("distance", F.lit(d))
        out = out.unionByName(front)
    return out


def standard_family(supersedes: DataFrame, related: DataFrame) -> DataFrame:
    """(node, relative): editions of one another's chain, related standards, and all that both reach.

    Pairs of one chain come from one join, each once, so that only members are shuffled; the pairs of a
    chain are spread over FAMILY_SLICES tasks. Other pairs are those of the closure, without the chains' own.
    """
    latest = latest_replacement(supersedes).select("node", "latest")
    # The last edition of a chain has no row of its own there.
    members = keep(latest.unionByName(latest.select(F.col("latest").alias("node"), "latest")).distinct())
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = members.withColumn("_slice", F.pmod(F.xxhash64("node"), F.lit(FAMILY_SLICES)).cast("int")).repartition(parts, "latest", "_slice")
    theirs = members.select(F.col("node").alias("relative"), "latest", F.explode(F.sequence(F.lit(0), F.lit(FAMILY_SLICES - 1))).alias("_slice")).repartition(parts, "latest", "_slice")
    same = mine.join(theirs, ["latest", "_slice"]).where("node <> relative").select("node", "relative")
    reached = closure(related.where("src is not null and dst is not null")).where("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("relative"))
    reached = reached.join(members.withColumnRenamed("latest", "_a"), "node", "left").join(members.select(F.col("node").alias("relative"), F.col("latest").alias("_b")), "relative", "left")
    return same.unionByName(reached.where("_a is null or _b is null or _a <> _b").select("node", "relative"))


def _bundles(edges: DataFrame) -> DataFrame:
    """(src, dst, confidence, current) -> (_at, _chunk, _edges): the edges of a node in arrays of at most BUNDLE."""
    order = Window.partitionBy("_at").orderBy("dst")
    numbered = edges.where("src is not null").select(F.col("src").cast("string").alias("_at"), "dst", "confidence", "current").withColumn("_chunk", F.floor((F.row_number().over(order) - 1) / BUNDLE).cast("int"))
    packed = numbered.groupBy("_at", "_chunk").agg(F.collect_list(F.struct("dst", "confidence", "current")).alias("_e"))
    # Arrays of plain values take a fraction of the bytes of an array of structs.
    return packed.select("_at", "_chunk", F.struct(*[F.col("_e")[c].alias(c) for c in ("dst", "confidence", "current")]).alias("_edges"))


def _packed(bundles: DataFrame) -> tuple[DataFrame, Callable[[Column], Column], Callable[[Column, Column], Column]]:
    """Bundles (_at, _chunk, _edges) with fewer bytes an edge: (bundles, array, edge).

    Whole numbers become steps from the node's least one, in the width that the widest bundle takes; where
    few pairs of confidence and currency occur, a byte names one. array(_edges) is what an explode takes, and
    edge(_edges, element) the struct (dst, confidence, current) of an element.
    """
    e, types = F.col("_edges"), bundles.schema["_edges"].dataType
    grades = F.arrays_zip(e["confidence"].alias("confidence"), e["current"].alias("current"))
    few = bundles.select(F.explode(F.array_distinct(grades)).alias("g")).distinct().limit(GRADES + 1).select("g.*").collect()
    step = None
    if types["dst"].dataType.elementType.simpleString() in ("bigint", "int"):
        # Null where a node has a null end or a difference exceeds its type: steps are not taken then.
        width = F.when(~F.exists(e["dst"], lambda x: x.isNull()), F.try_subtract(F.array_max(e["dst"]), F.array_min(e["dst"])))
        n, known, widest = bundles.agg(F.count(F.lit(1)), F.count(width), F.max(width)).first()
        step = next((t for t, most in (("smallint", 2**15), ("int", 2**31)) if n and n == known and widest < most), None)
    least = F.array_min(e["dst"])
    dst = F.transform(e["dst"], lambda x: (x - least).cast(step)) if step else e["dst"]
    fields = ([least.alias("least")] if step else []) + [dst.alias("dst")]
    dense = 0 < len(few) <= GRADES
    if dense:
        known = F.array(*[F.struct(F.lit(g.confidence).cast(types["confidence"].dataType.elementType).alias("confidence"), F.lit(g.current).cast("boolean").alias("current")) for g in few])
        fields.append(F.transform(grades, lambda g: (F.array_position(known, g) - 1).cast("byte")).alias("grade"))
    else:
        fields += [e["confidence"].alias("confidence"), e["current"].alias("current")]
    names = ["dst", "grade"] if dense else ["dst", "confidence", "current"]

    def array(edges: Column) -> Column:
        return F.arrays_zip(*[edges[c].alias(c) for c in names])

    def edge(edges: Column, one: Column) -> Column:
        grade = F.get(known, one["grade"].cast("int")) if dense else one
        return F.struct((edges["least"] + one["dst"] if step else one["dst"]).alias("dst"), grade["confidence"].alias("confidence"), grade["current"].alias("current"))

    return bundles.select("_at", "_chunk", F.struct(*fields).alias("_edges")), array, edge


def evidence_paths(starts: DataFrame, hops: list[tuple[str, str, DataFrame, bool]], most: int = 5) -> DataFrame:
    """(doc, nodes, current, confidence, path_no): typed paths from the rows of starts, enumerated hop by hop.

    starts (doc, kind, node). A hop (kind, after, edges, needed) leads from the path's node of the kind
    `after` along edges (src, dst, confidence, current) to a node of its own kind; a path without such
    an edge ends there, or is dropped where the hop is needed. A path is current if all its edges are;
    its confidence is the product of theirs. After each hop the `most` best paths of each document and
    end go on: current ones first, then longer (they say more), then surer ones, then by their nodes.
    So the frontier grows with documents and the nodes they reach and not with the number of paths.
    nodes: an array of (kind, node), nodes as strings. Null nodes have no edges.

    Paths are not shuffled hop by hop: their edges come to them in arrays as soon as the node is known
    that a hop starts from, before they branch, and all hops from there run where the document lies.
    Only where a node has more than BUNDLE edges does a later hop fetch them when it is its turn.
    """
    step = lambda kind, node: F.struct(kind.alias("kind"), node.cast("string").alias("node"))
    front = starts.select("doc", F.array(step(F.col("kind"), F.col("node"))).alias("nodes"), F.lit(True).alias("current"), F.lit(1.0).alias("confidence"))
    best = [F.desc("current"), F.size("nodes").desc(), half_up(F.col("confidence"), 9).desc(), F.col("nodes")]
    bundles = [keep(_bundles(edges)) for _, _, edges, _ in hops]
    narrow = [none_left(b.where("_chunk > 0")) for b in bundles]
    packed = [_packed(b) for b in bundles]
    # The hop after which the node is known that hop i starts from.
    known = [max([j + 1 for j in range(i) if hops[j][0] == after], default=0) for i, (_, after, _, _) in enumerate(hops)]
    parts = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fetched: set[int] = set()
    for i, (kind, after, _, needed) in enumerate(hops):
        if i not in fetched:
            # This hop's edges, and those of later hops that start from the same node.
            also = [j for j in range(i + 1, len(hops)) if j not in fetched and hops[j][1] == after and known[j] <= i and narrow[j]]
            front = keep(front.withColumn("_at", F.get(F.filter("nodes", lambda x: x["kind"] == after), F.lit(0))["node"]))
            tasks = max(parts, -(-front.count() // FRONT_ROWS))
            front = front.join(packed[i][0].select("_at", F.col("_edges").alias(f"_hop{i}")), "_at", "inner" if needed else "left")
            for j in also:
                front = front.join(packed[j][0].select("_at", F.col("_edges").alias(f"_hop{j}")), "_at", "left")
            front = front.drop("_at").repartition(tasks, "doc")
            fetched |= {i, *also}
        later = [f"_hop{j}" for j in sorted(fetched) if j > i]
        hop = F.col(f"_hop{i}")
        _, array, edge = packed[i]
        # Outer: a path without such an edge goes on with an empty one.
        one = F.explode(array(hop)) if needed else F.explode_outer(array(hop))
        moved = front.select("doc", "nodes", "current", "confidence", *later, hop, one.alias("_one")).withColumn("_e", edge(hop, F.col("_one")))
        dst = F.col("_e")["dst"]
        front = moved.select(
            "doc",
            F.when(dst.isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array(step(F.lit(kind), dst)))).alias("nodes"),
            (F.col("current") & F.coalesce(F.col("_e")["current"], F.lit(True))).alias("current"),
            (F.col("confidence") * F.coalesce(F.col("_e")["confidence"], F.lit(1.0))).alias("confidence"),
            *later,
        )
        end = F.element_at("nodes", -1)
        front = front.withColumn("_n", F.row_number().over(Window.partitionBy("doc", end).orderBy(*best))).where(F.col("_n") <= most).drop("_n")
    return front.withColumn("path_no", F.row_number().over(Window.partitionBy("doc").orderBy(*best)))
