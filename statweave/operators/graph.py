"""Graphs from triples: category search, edge collapse, communities and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statweave.session import cut_lineage
from statweave.sources.services import Generator, generate


def breadth_first(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """edges (parent, child), roots (node): node, depth of first discovery. One join a level; what is seen is
    never expanded again, so cycles end."""
    seen = roots.select("node").distinct().withColumn("depth", F.lit(0).cast("long"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        new = frontier.join(edges, frontier["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        frontier = cut_lineage(new.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def collapse_edges(edges: DataFrame, order: str) -> DataFrame:
    """Undirected edges with parallels collapsed, the last one's attributes kept: src, dst, relation, n."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max_by("relation", F.col(order)).alias("relation"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "relation", "n")


def propagate_labels(edges: DataFrame, rounds: int) -> DataFrame:
    """Communities by synchronous label propagation for a fixed number of rounds: a node takes the label most
    frequent among its neighbours, of several the least. Deterministic; node, community."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for i in range(rounds):
        labels = cut_lineage(labels) if i else labels
        votes = both.join(labels, both["dst"] == labels["node"]).groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        labels = votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("m")).select("node", F.col("m.community").alias("community"))
    return labels


def weighted(edges: DataFrame) -> DataFrame:
    """src, dst, w in both directions from undirected src, dst; loops and parallels dropped."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct().withColumn("w", F.lit(1.0))


def modularity(both: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, modularity: the share of weight inside communities less what degrees alone would put there.
    both: src, dst, w in both directions; labels: node, community. Null without edges."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    sides = both.join(of("src"), "src").join(of("dst"), "dst")
    sums = sides.groupBy("c_src").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("w")).otherwise(0.0)).alias("inside"))
    return sums.agg((F.sum("inside") / F.sum("total") - resolution * F.sum(F.col("total") * F.col("total")) / (F.sum("total") * F.sum("total"))).alias("modularity"))


def _moved(both: DataFrame, labels: DataFrame, weight: float, turn: int, resolution: float) -> DataFrame:
    """labels (node, community, degree) after those nodes whose turn it is took the neighbouring community of most gain."""
    votes = both.where("src <> dst").join(labels.select(F.col("node").alias("dst"), "community"), "dst").select("src", "community", "w")
    votes = votes.unionByName(labels.select(F.col("node").alias("src"), "community", F.lit(0.0).alias("w"))).groupBy("src", "community").agg(F.sum("w").alias("w"))
    own = labels.select(F.col("node").alias("src"), F.col("community").alias("own"), "degree")
    totals = labels.groupBy("community").agg(F.sum("degree").alias("total"))
    here = F.col("community") == F.col("own")
    gain = F.round(F.col("w") - resolution * F.col("degree") * (F.col("total") - F.when(here, F.col("degree")).otherwise(0.0)) / weight, 9)
    rows = votes.join(own, "src").join(totals, "community").withColumn("gain", gain)
    best = rows.groupBy("src", "own", "degree").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "community")).alias("best"), F.max(F.when(here, F.col("gain"))).alias("stay"))
    moves = (F.pmod(F.xxhash64("src", F.lit(turn)), F.lit(2)) == 0) & (-F.col("best.loss") > F.col("stay"))
    return best.select(F.col("src").alias("node"), F.when(moves, F.col("best.community")).otherwise(F.col("own")).alias("community"), "degree", moves.alias("moved"))


def connected_parts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (src, dst) in both directions, nodes (node): node, part, the least node that it reaches. Each round takes the
    least part of the neighbours and then that part's own part, so long chains take few rounds."""
    parts = cut_lineage(nodes.select("node", F.col("node").alias("part")))
    while True:
        near = edges.join(parts.select(F.col("node").alias("dst"), F.col("part").alias("near")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("near").alias("near"))
        least = parts.join(near, "node", "left").select("node", "part", F.least("part", F.coalesce("near", "part")).alias("least"))
        jumped = least.join(parts.select(F.col("node").alias("least"), F.col("part").alias("beyond")), "least").select("node", F.least("least", "beyond").alias("part"), (F.least("least", "beyond") < F.col("part")).alias("moved"))
        parts = cut_lineage(jumped)
        if parts.where("moved").isEmpty():
            return parts.select("node", "part")


def _within(both: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between different nodes of one community."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    return both.where("src <> dst").join(of("src"), "src").join(of("dst"), "dst").where("c_src = c_dst").select("src", "dst", "w")


def _followed(both: DataFrame, resolution: float) -> DataFrame:
    """node, community: of a node with one neighbour that neighbour, of two that have only each other the lesser, else the
    node itself. At resolutions over 1 it may be better alone, and nobody follows."""
    near = both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("near"))
    if resolution > 1:
        return near.select("node", F.col("node").alias("community"))
    pairs = both.groupBy(F.col("dst").alias("near")).agg((F.count(F.lit(1)) == 1).alias("alone"))
    return near.join(pairs, "near").select("node", F.when(F.col("n") > 1, F.col("node")).when(F.col("alone"), F.least("node", "near")).otherwise(F.col("near")).alias("community"))


def _merged(both: DataFrame, labels: DataFrame) -> DataFrame:
    """The weighted edges between communities; those inside one are its loop."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    return both.join(of("src"), "src").join(of("dst"), "dst").groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("w").alias("w"))


def _settled(both: DataFrame, labels: DataFrame, weight: float, rounds: int, resolution: float) -> DataFrame:
    """labels (node, community, degree) after rounds of moves, or fewer if two in a row move nothing."""
    still = 0
    for turn in range(rounds):
        labels = cut_lineage(_moved(both, labels.select("node", "community", "degree"), weight, turn, resolution))
        still = 0 if not labels.where("moved").isEmpty() else still + 1
        if still == 2:
            break
    return labels.select("node", "community", "degree")


def modularity_communities(edges: DataFrame, levels: int = 10, rounds: int = 12, refined: int = 1, resolution: float = 1.0) -> DataFrame:
    """Communities by modularity in levels, each community connected. Nodes move to the neighbouring community of most
    gain, about half of them at a time so that neighbours don't swap for ever. In the first levels, so many as refined,
    each community is then refined: its nodes begin alone again and merge with neighbours inside it only. The refined
    parts, not the communities, are the nodes of the next level, where they begin in their communities; so what was
    merged too early can still move. In later levels communities are the nodes. A level that doesn't raise modularity is
    undone and ends the search, and communities that aren't connected are split at last, which can only raise it.
    Deterministic; node, community.

    Where most nodes have one neighbour, those go with it from the start, as they do in a best partition (up to resolution
    1), and the search is among the others. Where few do, that would save little, and they move like all. Loops and parallel edges are dropped; an empty table gives an empty result. Every
    step is a join or a grouped sum; the driver sees a few numbers for each round."""
    edges = cut_lineage(weighted(edges))
    # written, as columns known to be equal keep the optimiser busy
    follows = cut_lineage(_followed(edges, resolution))
    if 2 * follows.where("node <> community").count() < follows.count():
        follows = follows.select("node", F.col("node").alias("community"))
    both = edges_between = cut_lineage(_merged(edges, follows))
    nodes = cut_lineage(follows.select(F.col("community").alias("node")).distinct().withColumn("community", F.col("node")))
    weight = both.agg(F.sum("w")).first()[0]
    found = members = begun = nodes
    score = modularity(both, found, resolution).first().modularity
    for level in range(levels if weight else 0):
        degrees = cut_lineage(both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree")))
        labels = _settled(both, begun.join(degrees, "node"), weight, rounds, resolution)
        new = modularity(both, labels, resolution).first().modularity
        if new <= score + 1e-9:
            if level == 0 or level > refined:
                break
            labels = begun.join(degrees, "node")  # refined nodes stay where they are, and whole communities move next
        score = max(score, new)
        into = labels.select(F.col("node").alias("community"), F.col("community").alias("into"))
        found = cut_lineage(members.join(into, "community").select("node", F.col("into").alias("community")))
        if level < refined:
            inner = cut_lineage(_within(both, labels))
            alone = cut_lineage(degrees.select("node", F.col("node").alias("community"), "degree"))
            parts = _settled(inner, alone, weight, rounds, resolution).select("node", F.col("community").alias("part"))
            begun = cut_lineage(parts.join(labels, "node").groupBy(F.col("part").alias("node")).agg(F.min("community").alias("community")))
        else:
            parts = labels.select("node", F.col("community").alias("part"))
            begun = cut_lineage(parts.select(F.col("part").alias("node")).distinct().withColumn("community", F.col("node")))
        members = cut_lineage(members.join(parts.select(F.col("node").alias("community"), "part"), "community").select("node", F.col("part").alias("community")))
        both = cut_lineage(_merged(both, parts.withColumnRenamed("part", "community")))
    # a community that isn't connected is worth less than its parts; it is called by its least node
    parts = connected_parts(_within(edges_between, found), nodes).withColumnRenamed("node", "community")
    whole = cut_lineage(follows.join(parts, "community").select("node", "part"))
    return whole.join(whole.groupBy("part").agg(F.min("node").alias("community")), "part").select("node", "community")


def community_table(members: DataFrame, most: int = 20) -> DataFrame:
    """community, size, and its first members in order, ranked before they are gathered so lists stay short."""
    rank = F.row_number().over(Window.partitionBy("community").orderBy("node"))
    size = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    top = members.withColumn("r", rank).where(F.col("r") <= most).groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("node")), "; ").alias("members"))
    return size.join(top, "community")


def entity_descriptions(triples: DataFrame, cap: int = 500) -> DataFrame:
    """entity, description: facts in order joined by "; ", added while what is there is shorter than cap. Triples
    with a null part are left out."""
    by = Window.partitionBy("subject").orderBy("tid")
    # a fact takes four characters at least, so later ones can't be reached; tasks drop them before the shuffle
    triples = triples.dropna(subset=["subject", "relation", "object"]).withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= cap // 4 + 1)
    first = F.col("nth") == 1
    piece = F.when(first, F.concat("subject", F.lit(" ("), "relation", F.lit(": "), "object", F.lit(")"))).otherwise(F.concat(F.lit("; "), "relation", F.lit(": "), "object"))
    rows = triples.select("subject", "tid", piece.alias("piece"))
    before = F.coalesce(F.sum(F.length("piece")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("before", before).where(F.col("before") < cap)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tid", "piece"))), lambda x: x["piece"]), "")
    return kept.groupBy(F.col("subject").alias("entity")).agg(text.alias("description"))


def relationships(statistical: DataFrame, structural: DataFrame) -> DataFrame:
    """Weighted edges: 1.0 from a subject to its topic, 0.5 between related topics."""
    own = statistical.select(F.col("subject").alias("src"), F.col("source_topic").alias("dst"), F.concat_ws(" ", "subject", "relation", "object").alias("description"), F.concat_ws(" ", "relation", "source_topic").alias("keywords"), F.lit(1.0).alias("weight"))
    related = structural.select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.concat("subject", F.lit(" is related to "), "object").alias("description"), F.concat_ws(" ", "relation", "source_topic").alias("keywords"), F.lit(0.5).alias("weight"))
    return own.unionByName(related)


def membership_facts(entities: DataFrame, units: DataFrame, most: int = 3) -> DataFrame:
    """entities (entity) and text units (unit, text, entity_ids): the first units that name each entity.

    Units are ranked before entities are looked up, so the join has a few rows for each, and in as many parts as the
    session states, which adaptive execution doesn't join up again: a task sorts a small share of what is named."""
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = units.select(F.explode("entity_ids").alias("entity"), "unit", "text").repartition(parts, "entity")
    first = named.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy("unit"))).where(F.col("rank") <= most)
    return first.join(entities.select("entity").distinct().hint("merge"), "entity", "left_semi").withColumn("rank", F.col("rank").cast("long"))


def community_facts(members: DataFrame, triples: DataFrame, first_members: int = 10, each: int = 3, most: int = 15, entities: DataFrame | None = None, described: int = 5) -> DataFrame:
    """Facts for a community's report: of its first members as topics a few each, then the first of all. With entities
    (entity, description), a community without facts has the descriptions of its first described members."""
    ranked = members.withColumn("m", F.row_number().over(Window.partitionBy("community").orderBy("node")))
    few = triples.withColumn("t", F.row_number().over(Window.partitionBy("source_topic").orderBy("tid"))).where(F.col("t") <= each)
    facts = ranked.where(F.col("m") <= first_members).join(few, ranked["node"] == few["source_topic"])
    facts = facts.withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy("m", "t")).cast("long")).where(F.col("rank") <= most)
    facts = facts.select("community", "rank", F.concat(F.lit("- "), F.concat_ws(" ", "subject", "relation", "object")).alias("fact"))
    if entities is None:
        return facts
    facts = cut_lineage(facts)
    bare = ranked.join(facts.select("community").distinct(), "community", "left_anti").join(entities.select(F.col("entity").alias("node"), "description"), "node")
    bare = bare.withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy("m")).cast("long")).where(F.col("rank") <= described)
    return facts.unionByName(bare.select("community", "rank", F.concat(F.lit("- "), "node", F.lit(": "), "description").alias("fact")))


def community_reports(members: DataFrame, triples: DataFrame, call: Generator, entities: DataFrame | None = None) -> DataFrame:
    """One report a community: community, title (its first three members), summary, level, rank (its size), error. The
    generator is asked for a summary of the members and facts; where it fails, the summary names the first members."""
    listed = members.withColumn("m", F.row_number().over(Window.partitionBy("community").orderBy("node"))).where(F.col("m") <= 10)
    names = lambda n: F.array_join(F.slice("names", 1, n), ", ")
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("rank"))
    first = listed.groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("names")).join(sizes, "community")
    facts = community_facts(members, triples, entities=entities).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", "fact"))).alias("f"))
    facts = facts.select("community", F.array_join(F.transform("f", lambda x: x["fact"]), "\n").alias("facts"))
    prompt = F.concat(F.lit("Summarise in two or three sentences what these topics have in common, with their key figures.\nTopics: "), names(10), F.lit("\nFacts:\n"), F.coalesce("facts", F.lit("")))
    asked = generate(first.join(facts, "community", "left").withColumn("prompt", prompt), "prompt", call)
    summary = F.when(F.col("error").isNull(), F.col("answer")).otherwise(F.concat(F.lit("Community covering: "), names(5)))
    title = F.concat(F.lit("Community "), F.col("community").cast("string"), F.lit(": "), names(3))
    return asked.select("community", title.alias("title"), summary.alias("summary"), F.lit(0).alias("level"), "rank", "error")
