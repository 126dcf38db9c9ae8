"""Hypergraph tables: nodes, incidence edges (hyperedge, entity, weight), and what is read from or done to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled, spread
from .kv import first_per_key, merge_fields

SEP = "<SEP>"
MARK = "<hyperedge>"


def incidence(rows: DataFrame, hyperedge: str, entity: str, weight: str) -> DataFrame:
    """(hyperedge, entity, weight): mentions merged by summing."""
    return rows.groupBy(F.col(hyperedge).alias("hyperedge"), F.col(entity).alias("entity")).agg(F.sum(weight).alias("weight"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) in both directions."""
    return edges.select(F.col("hyperedge").alias("src"), F.col("entity").alias("dst"), "weight").union(edges.select("entity", "hyperedge", "weight"))


def node_degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, degree); of `nodes` (column node) if given, with 0 for those without edges."""
    ends = edges.select(F.explode(F.array("hyperedge", "entity")).alias("node"))
    found = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return found if nodes is None else nodes.join(found, "node", "left").fillna(0, ["degree"])


def edge_degree(edges: DataFrame) -> DataFrame:
    """Edges with the sum of their ends' degrees. Each end's degree comes from its own side, so hyperedge and entity names must differ."""
    by_h = edges.groupBy("hyperedge").agg(F.count("*").alias("d_h"))
    by_e = edges.groupBy("entity").agg(F.count("*").alias("d_e"))
    return edges.join(by_h, "hyperedge").join(by_e, "entity").select("hyperedge", "entity", "weight", (F.col("d_h") + F.col("d_e")).alias("degree"))


def node_edges(edges: DataFrame, seeds: DataFrame, seed: str = "node") -> DataFrame:
    """One hop from the seeds: (seed, dst, weight)."""
    return seeds.join(symmetric(edges), F.col(seed) == F.col("src")).select(*seeds.columns, "dst", "weight")


def has_node(nodes: DataFrame, asked: DataFrame, key: str = "node") -> DataFrame:
    return asked.join(nodes.select(key).distinct().withColumn("found", F.lit(True)), key, "left").fillna(False, ["found"])


def has_edge(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: (a, b); an edge counts in either direction."""
    pair = lambda x, y: (F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
    known = edges.select(*pair("hyperedge", "entity")).distinct().withColumn("found", F.lit(True))
    return asked.select("a", "b", *pair("a", "b")).join(known, ["lo", "hi"], "left").select("a", "b", F.coalesce("found", F.lit(False)).alias("found"))


def get_edge(edges: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(edges, ["hyperedge", "entity"], "left")


def upsert_nodes(nodes: DataFrame, new: DataFrame, key: str = "node") -> DataFrame:
    return merge_fields(nodes, new, key)


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    fresh = new.select("hyperedge", "entity", F.col("weight").alias("__w"))
    return edges.join(fresh, ["hyperedge", "entity"], "full").select("hyperedge", "entity", F.coalesce("__w", "weight").alias("weight"))


def delete_nodes(edges: DataFrame, gone: DataFrame, key: str = "node") -> DataFrame:
    """Edges without those that touch a deleted node."""
    left = edges.join(gone.select(F.col(key).alias("hyperedge")), "hyperedge", "left_anti")
    return left.join(gone.select(F.col(key).alias("entity")), "entity", "left_anti").select(edges.columns)


def delete_by_entity(entities: DataFrame, nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cascade over the entity store, the nodes and the edges. Names are upper-cased and quoted as on insertion."""
    gone = names.select(F.concat(F.lit('"'), F.upper(F.col("name")), F.lit('"')).alias("node"))
    return entities.join(gone.withColumnRenamed("node", "entity"), "entity", "left_anti"), nodes.join(gone, "node", "left_anti"), delete_nodes(edges, gone)


def rename_hyperedges(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """renames: (old, new). Edges move to the new name; where both names had one to the same entity, the moved one wins."""
    moved = edges.join(renames, edges.hyperedge == renames.old, "left")
    moved = moved.select(F.coalesce("new", "hyperedge").alias("hyperedge"), "entity", "weight", F.col("new").isNotNull().cast("int").alias("m"))
    return moved.groupBy("hyperedge", "entity").agg(F.max_by("weight", "m").alias("weight"))


def set_hyperedge_weights(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """weights: (hyperedge, new_weight), pushed to every incident edge."""
    return edges.join(weights, "hyperedge", "left").select("hyperedge", "entity", F.coalesce("new_weight", "weight").alias("weight"))


def graph_weight(asked: DataFrame, nodes: DataFrame, edges: DataFrame, default: float) -> DataFrame:
    """(hyperedge, weight): the node's, else that of its first edge by entity, else the default."""
    first = edges.groupBy("hyperedge").agg(F.min_by("weight", "entity").alias("w_edge"))
    own = nodes.select(F.col("node").alias("hyperedge"), F.col("weight").alias("w_node"))
    return asked.join(own, "hyperedge", "left").join(first, "hyperedge", "left").select("hyperedge", F.coalesce("w_node", "w_edge", F.lit(default)).alias("weight"))


def nodes_with_text(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every node with the texts of its chunks, in the order of their ids. nodes: (node, source_id joined by SEP)."""
    parts = nodes.select("node", F.explode_outer(F.split("source_id", SEP)).alias("chunk"))
    joined = parts.join(chunks.select(F.col("id").alias("chunk"), "content"), "chunk", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("chunk", "content"))))
    return joined.groupBy("node").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), SEP).alias("content"))


def edges_with_text(edges: DataFrame, chunks: DataFrame, created: str, limit: int) -> DataFrame:
    """The latest edges, each with its chunk's text."""
    return edges.join(chunks.select(F.col("id").alias("source_id"), "content"), "source_id", "left").orderBy(F.desc(created), "hyperedge", "entity").limit(limit)


def statistics(edges: DataFrame) -> DataFrame:
    """One row: distinct hyperedges, entities, nodes and edges."""
    pairs = edges.select("hyperedge", "entity").distinct()
    hyperedges = edges.select("hyperedge").distinct().agg(F.count("hyperedge").alias("hyperedges"))
    # an entity's pairs are counted on the way, so the pairs themselves go nowhere; nulls count for nothing
    by_e = pairs.groupBy("entity").agg(F.count("hyperedge").alias("n"))
    rest = by_e.agg(F.count("entity").alias("entities"), F.coalesce(F.sum(F.when(F.col("entity").isNotNull(), F.col("n"))), F.lit(0)).alias("edges"))
    return hyperedges.crossJoin(rest).withColumn("nodes", F.col("hyperedges") + F.col("entities"))


def sample_rows(df: DataFrame, order: str, text: str, n: int = 5, width: int = 100) -> DataFrame:
    cut = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(F.col(text))
    return df.orderBy(order).limit(n).withColumn(text, cut)


def cross_modal(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents (doc, image_id, title, contents): image anchors, entities, text evidence and sample
    hyperedges, deduplicated by id; every sample grounds its image, its entity and its text."""
    entity = F.upper(F.coalesce(F.expr("nullif(trim(title), '')"), F.expr("nullif(trim(image_id), '')"), F.lit("UNKNOWN")))
    ids = documents.select(
        F.concat(F.lit("image:"), "image_id").alias("image"), F.concat(F.lit("entity:"), entity).alias("entity"),
        F.concat(F.lit("text:"), F.col("doc").cast("string")).alias("text"), F.concat(F.lit("sample:"), F.col("doc").cast("string")).alias("sample"),
    )
    roles = [("image", "image_anchor"), ("entity", "entity"), ("text", "text_evidence"), ("sample", "sample_hyperedge")]
    nodes = ids.select(F.explode(F.array(*(F.struct(F.col(c).alias("node"), F.lit(r).alias("role")) for c, r in roles))).alias("x")).select("x.*").where("node IS NOT NULL").distinct()
    kinds = [("image", "grounds_image"), ("entity", "grounds_entity"), ("text", "grounds_text")]
    edges = ids.select("sample", F.explode(F.array(*(F.struct(F.col(c).alias("target"), F.lit(k).alias("relation")) for c, k in kinds))).alias("x")).select(F.col("sample").alias("source"), "x.*")
    return nodes, edges.where("target IS NOT NULL").distinct()



def link_table(rows: DataFrame, targets: list[tuple[str, str]], source: str = "data_id") -> DataFrame:
    """One link for each row and (column, relation) whose column is not null: (source_id, target_id, relation)."""
    links = F.array(*(F.struct(F.col(c).cast("string").alias("target_id"), F.lit(r).alias("relation")) for c, r in targets))
    return rows.select(F.col(source).cast("string").alias("source_id"), F.explode(links).alias("x")).select("source_id", "x.*").where("target_id IS NOT NULL")


def resolve_by_links(embeddings: DataFrame, links: DataFrame, records: DataFrame, priority: list[str]) -> DataFrame:
    """Embedding id -> record by its links; of several relations the last in `priority` wins."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("relation"))
    found = embeddings.select(F.col("id").alias("source_id")).join(links, "source_id").where(rank > 0).withColumn("rank", rank)
    found = first_per_key(found, ["source_id"], [F.desc("rank"), F.desc("target_id")])
    return found.join(records.withColumnRenamed("id", "target_id"), "target_id").withColumnRenamed("source_id", "id")


def _drawn(*parts: Column | str) -> Column:
    """A number of 32 bits that the parts decide."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def _placed(edges: DataFrame) -> DataFrame:
    """(src, dst, degree, i): every node's distinct neighbours, numbered from 0, with their number. The graph is read once
    for both directions and dealt once, by src."""
    ways = F.explode(F.array(*(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("hyperedge", "entity"), ("entity", "hyperedge")))))
    sides = edges.select(ways.alias("x")).select("x.*").repartition("src").distinct()
    own = Window.partitionBy("src")
    return sides.withColumn("degree", F.count("*").over(own)).withColumn("i", F.row_number().over(own.orderBy("dst")) - 1)


def random_walks(edges: DataFrame, length: int, seed: int = 42) -> DataFrame:
    """One seeded walk from every node: (start, step, node). A node's neighbours are numbered once; a walker draws a number
    below its node's degree and joins on it, so a hub's walkers meet one neighbour each. A walker is one row with its path,
    so each step is made once; the first is chosen where the neighbours are numbered."""
    placed = _placed(edges)
    drawn = lambda k: F.pmod(_drawn(F.lit(str(seed + k)), "start"), F.col("degree")).cast("int")
    first = placed.withColumn("start", F.col("src"))
    walk = first.where(F.col("i") == (drawn(1) if length else 0)).select("start", F.col("dst").alias("n1"))
    degrees = placed.groupBy(F.col("src").alias("of")).agg(F.count("*").alias("degree"))
    there = placed.select(F.col("src").alias("of"), F.col("i").alias("at"), "dst")
    path = ["start", *(f"n{k}" for k in range(1, length + 1))]
    for k in range(2, length + 1):
        # nulls meet as well, so the tables are read alike everywhere and dealt once; what lies behind them goes below
        node = F.col(path[k - 1])
        at = walk.join(degrees, node.eqNullSafe(F.col("of"))).select(*path[:k], drawn(k).alias("i"))
        walk = at.join(there, node.eqNullSafe(F.col("of")) & (F.col("i") == F.col("at"))).select(*path[:k], F.col("dst").alias(path[k]))
    last = F.coalesce(*(F.when(F.col(c).isNull(), k) for k, c in enumerate(path)), F.lit(length))  # a walk ends at a null
    steps = walk.select("start", last.alias("last"), F.posexplode(F.array(*path)).alias("step", "node"))
    return steps.where("step <= last").select("start", "step", "node")


#: Neighbours in one list.
LIST = 1 << 10


def _lists(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(src, block, degree, mixed, near): every node's distinct neighbours in their order, in lists of at most LIST numbered
    from 0, beside their whole number; mixed where the node is a hyperedge as well as an entity. The graph is read once for
    both directions and dealt once, by src, into parts for the rows of the table `of`."""
    ways = F.explode(F.array(*(F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(k).alias("side")) for k, (a, b) in enumerate((("hyperedge", "entity"), ("entity", "hyperedge"))))))
    sides = edges.select(ways.alias("x")).select("x.*").where("src IS NOT NULL")
    sides = spread(sides, "src", of=of).groupBy("src", "dst").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    order = Window.partitionBy("src").orderBy("dst")
    own = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sides.select("src", "dst", F.count("*").over(own).alias("degree"), (F.min("lo").over(own) < F.max("hi").over(own)).alias("mixed"), F.floor((F.row_number().over(order) - 1) / LIST).cast("int").alias("block"))
    near = F.array_sort(F.collect_list("dst"))
    null = F.array(F.lit(None).cast(sides.schema["dst"].dataType))  # comes first, and is not collected
    return rows.groupBy("src", "block", "degree", "mixed").agg(F.when(F.count("*") > F.count("dst"), F.concat(null, near)).otherwise(near).alias("near"))


def biased_walks(edges: DataFrame, length: int, p: float = 1.0, q: float = 1.0, seed: int = 42, walks: int = 1, of: DataFrame | None = None) -> DataFrame:
    """Second-order walks: (start, walk, step, node), `walks` from every node. From v, reached from t, the next node x weighs 1/p
    if it is t, 1 if t and x are neighbours, and 1/q otherwise. of: the table that the edges were made from, if it is large.

    t is one of v's neighbours, so its share against the others, each taken at the greatest weight, is known: a walker
    goes back with it, and no draw is lost on the way back. Else it draws one of the others. A walker and its node's list of
    neighbours meet once in a step, so no edge travels alone; at a node of more than LIST, each meets the list of its draw.

    Where no node is a hyperedge as well as an entity, no neighbours of v are neighbours: the others weigh 1/q each, and
    every draw is kept. Else a draw is kept with its weight's share of the greatest; those that rejected draw again, more at a
    time in each round. Whether t and x are neighbours is a join on the pair. Every round is settled; a draw is kept with a
    share of at least min(1, 1/q) / max(1, 1/q), by all where nothing links t and x."""
    lists = settled(_lists(edges, of))
    mixed, longest = lists.agg(F.max("mixed"), F.max("degree")).first()
    hubs = (longest or 0) > LIST
    most = max(1.0, 1 / q) if mixed else 1 / q
    each = F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk")
    there = lists.select(F.col("src").alias("node"), "block", "degree", "near")
    out = [lists.where("block = 0").select(F.col("src").alias("start"), each, F.lit(0).alias("step"), F.col("src").alias("node"))]
    for k in range(1, length + 1):
        name = [F.lit(str(seed)), "start", F.col("walk").cast("string"), F.concat(F.lit(f"{k}:"), F.col("turn").cast("string"))]
        if k == 1:
            first = lists.select(F.col("src").alias("start"), each, "block", "degree", "near", F.lit(0).alias("turn")).withColumn("i", F.pmod(_drawn(*name), F.col("degree")))
            first = first.where(F.floor(F.col("i") / LIST) == F.col("block"))
            at = settled(first.select("start", "walk", F.col("start").alias("before"), F.get("near", (F.col("i") % LIST).cast("int")).alias("node")))
            out.append(at.select("start", "walk", F.lit(k).alias("step"), "node"))
            continue

        def home(degree: Column, name: list = name) -> Column:
            return _drawn(*name, F.lit("back")) < (1 / p) / (1 / p + (degree - 1) * most) * 2.0**32

        def chosen(back: Column, degree: Column, name: list = name) -> Column:
            other = F.pmod(_drawn(*name), F.greatest(degree - 1, F.lit(1)))
            return F.when(home(degree), back).otherwise(other + (other >= back).cast("int"))

        left, taken, turn, draws = at, [], 0, 1
        while True:
            tries, on, back = left.withColumn("turn", F.explode(F.sequence(F.lit(turn), F.lit(turn + draws - 1)))), ["node"], F.array_position("near", F.col("before")) - 1
            if hubs:
                far = there.where(F.col("degree") > LIST).select("node", "block", F.col("degree").alias("all"), F.posexplode("near").alias("back", "before"))
                far = far.select("node", "before", "all", (F.col("block") * LIST + F.col("back")).cast("long").alias("back"))
                tries = tries.join(far, ["node", "before"], "left").withColumn("block", F.coalesce(F.floor(chosen(F.col("back"), F.col("all")) / LIST), F.lit(0)).cast("int"))
                on, back = ["node", "block"], F.coalesce("back", back)
            tries = tries.join(there, on).withColumn("home", home(F.col("degree"))).withColumn("i", chosen(back, F.col("degree")))
            tries = tries.select(*left.columns, "turn", "home", F.get("near", (F.col("i") % LIST).cast("int")).alias("x"))
            if not mixed:
                at = settled(tries.select("start", "walk", F.col("node").alias("before"), F.col("x").alias("node")))
                break
            pairs = lists.select(F.col("src").alias("before"), F.explode("near").alias("x"), F.lit(True).alias("linked"))
            keep = F.col("home") | (_drawn(*name, F.lit("keep")) < F.when(F.col("linked"), 1.0).otherwise(1 / q) / most * 2.0**32)
            met = tries.join(pairs, ["before", "x"], "left").withColumn("kept", F.when(keep, F.struct("turn", "x")))
            met = settled(met.groupBy(*left.columns).agg(F.min("kept").alias("kept")) if draws > 1 else met.select(*left.columns, "kept"))
            taken.append(met.where("kept IS NOT NULL").select("start", "walk", F.col("node").alias("before"), F.col("kept.x").alias("node")))
            left, turn, draws = met.where("kept IS NULL").drop("kept"), turn + draws, min(4 * draws, 64)
            if left.isEmpty():
                at = reduce(DataFrame.unionByName, taken)
                break
        out.append(at.select("start", "walk", F.lit(k).alias("step"), "node"))
    return reduce(DataFrame.unionByName, out)


def node_embeddings(walks: DataFrame, size: int = 64, window: int = 5, seed: int = 42, rounds: int = 1) -> DataFrame:
    """(node, embedding) by skip-grams over the walks. Spark's Word2Vec keeps the vectors of all nodes on the driver and in
    every task, so this is for graphs of some millions of nodes."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    steps = F.array_sort(F.collect_list(F.struct("step", F.col("node").cast("string").alias("node"))))
    lines = settled(walks.groupBy("start", "walk").agg(F.transform(steps, lambda x: x["node"]).alias("line")))
    held = Word2Vec(vectorSize=size, windowSize=window, seed=seed, minCount=0, maxIter=rounds, numPartitions=1, inputCol="line", outputCol="v").fit(lines)
    return held.getVectors().select(F.col("word").alias("node"), vector_to_array("vector", "float32").alias("embedding"))
