"""Person networks in layers: edges, components, walks, neighbourhoods and statistics.

Edges are rows ``(layer, src, dst)``. Adjacency lists are only built where a step chooses among neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.hashing import hash32, pick, uniform
from ..session import Stage
from .ranking import dense_index, global_order


#: Steps of all walks between two tables that are written.
STEPS_AT_ONCE = 5


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once; loops and nulls are left out."""
    real = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src != dst")
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    keep = [c for c in edges.columns if c not in ("src", "dst")]
    return real.select(*keep, F.inline(both)).distinct()


def reindexed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges on dense ids from 0 by node, and the mapping ``(node, idx)``."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    mapping = dense_index(nodes, "node")
    a, b = mapping.toDF("src", "s"), mapping.toDF("dst", "d")
    return edges.join(a, "src").join(b, "dst").select(*[c for c in edges.columns if c not in ("src", "dst")], F.col("s").alias("src"), F.col("d").alias("dst")), mapping


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(node, component)``: the smallest node reachable. Alternating star operations: every node is hung on the smallest node
    it knows until all hang on one centre. Minima are combined before they travel."""
    current = Stage(symmetric(edges.select("src", "dst")).filter("src > dst").toDF("hi", "lo"), "edges")
    nodes = current.df.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    everyone = Stage(nodes, "nodes").df
    for _ in range(max_rounds):
        both = current.df.select(F.inline(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi != lo").distinct()
        down = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.join(down, large["hi"] == down["u"]).select(F.inline(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo"))))).filter("hi != lo").distinct()
        new = Stage(small, "edges")
        # done when every node hangs on exactly one other and no centre hangs on anything
        centres = new.df.select("lo").distinct().join(new.df.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi")
        done = centres.isEmpty() and new.df.groupBy("hi").count().filter("count > 1").isEmpty()
        current.release()
        current = new
        if done:
            return everyone.join(current.df, everyone["node"] == current.df["hi"], "left").select("node", F.coalesce("lo", "node").alias("component"))
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def largest_component(components: DataFrame) -> DataFrame:
    """``(node)`` of the largest component; of equal ones the one with the smallest node."""
    top = components.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return components.join(top, "component", "left_semi").select("node")


def edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among ``nodes`` (one column)."""
    return edges.join(nodes.toDF("src"), "src", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi")


def users_of_layer(edges: DataFrame, layer: str) -> DataFrame:
    """``(node)``: the ends of a layer's edges, loops left out."""
    return edges.filter((F.col("layer") == layer) & (F.col("src") != F.col("dst"))).select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def csr_neighbours(edges: DataFrame) -> DataFrame:
    """``(place, idx, neighbour)``: the neighbours of all nodes in one list, by node and neighbour, places from 0. Edges on dense ids."""
    both = symmetric(edges.select("src", "dst"))
    return global_order(both, "src", "dst").select((F.col("position") - 1).alias("place"), F.col("src").alias("idx"), F.col("dst").alias("neighbour"))


def combined_neighbours(edges: DataFrame, mapping: DataFrame, most: int | None = None, seed: str = "combine") -> DataFrame:
    """``(node, neighbour)`` over all layers, numbers turned back into nodes; with ``most`` so many of each node, by hash."""
    a, b = mapping.toDF("node", "src"), mapping.toDF("neighbour", "dst")
    pairs = symmetric(edges.select("src", "dst")).join(a, "src").join(b, "dst").select("node", "neighbour")
    if most is None:
        return pairs
    order = W.partitionBy("node").orderBy(hash32(F.concat_ws("-", "node", "neighbour"), seed), "neighbour")
    return pairs.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most).drop("__r")


def layer_degrees(edges: DataFrame, persons: DataFrame, layers: Sequence[str]) -> DataFrame:
    """``(layer, n, mean, median, std, p10, p90, nonzero)`` of the number of neighbours of ``persons``, those without any included."""
    count = symmetric(edges).groupBy(F.col("src").alias("person")).pivot("layer", list(layers)).count()
    full = persons.join(count, "person", "left")
    long = full.select(F.inline(F.array(*[F.struct(F.lit(x).alias("layer"), F.coalesce(F.col(x), F.lit(0)).alias("degree")) for x in layers])))
    return _statistics(long, "layer")


def _statistics(long: DataFrame, key: str) -> DataFrame:
    p = F.percentile("degree", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return long.groupBy(key).agg(F.count("*").alias("n"), F.avg("degree").alias("mean"), F.stddev_pop("degree").alias("std"), F.avg((F.col("degree") > 0).cast("double")).alias("nonzero"), p.alias("p")).select(
        key, "n", "mean", F.col("p")[1].alias("median"), "std", F.col("p")[0].alias("p10"), F.col("p")[2].alias("p90"), "nonzero"
    )


def layer_intersections(edges: DataFrame, persons: DataFrame, layers: Sequence[str]) -> DataFrame:
    """``(pair, ...)``: statistics of how many neighbours a person has in both layers of each pair. Layers of an edge are marked as bits, so no edges are joined."""
    bit = F.element_at(F.create_map(*[x for k, name in enumerate(layers) for x in (F.lit(name), F.lit(1 << k))]), F.col("layer"))
    marks = symmetric(edges).groupBy("src", "dst").agg(F.bit_or(bit).alias("bits"))
    pairs = [(i, j) for i in range(len(layers)) for j in range(i + 1, len(layers))]
    hit = lambda i, j: F.sum((F.col("bits").bitwiseAND((1 << i) | (1 << j)) == (1 << i) | (1 << j)).cast("int"))
    per = marks.groupBy(F.col("src").alias("person")).agg(*[hit(i, j).alias(f"p{i}{j}") for i, j in pairs])
    full = persons.join(per, "person", "left")
    long = full.select(F.inline(F.array(*[F.struct(F.lit(f"{layers[i]}-{layers[j]}").alias("pair"), F.coalesce(F.col(f"p{i}{j}"), F.lit(0)).alias("degree")) for i, j in pairs])))
    return _statistics(long, "pair")


def node_features(edges: DataFrame, codes: Sequence[int], persons: DataFrame) -> DataFrame:
    """Neighbours of each person by relation code, other codes in ``other``; -1 throughout for a person without edges. Edges: ``(src, dst, code)``."""
    name = F.when(F.col("code").isin(list(codes)), F.concat(F.lit("code_"), F.col("code").cast("string"))).otherwise("other")
    names = [*[f"code_{c}" for c in codes], "other"]
    counts = edges.withColumn("__n", name).groupBy(F.col("src").alias("person")).pivot("__n", names).count().na.fill(0)
    return persons.join(counts, "person", "left").na.fill(-1, names).select("person", *names)


def layer_lists(edges: DataFrame) -> DataFrame:
    """``(node, layers, lists)``: the layers a node has neighbours in, sorted, and its sorted neighbours in each."""
    per = symmetric(edges).groupBy(F.col("src").alias("node"), "layer").agg(F.array_sort(F.collect_set("dst")).alias("around"))
    rows = per.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("layer", "around"))).alias("x"))
    return rows.select("node", F.transform("x", lambda e: e["layer"]).alias("layers"), F.transform("x", lambda e: e["around"]).alias("lists"))


def numbered_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(position, dst)``: the neighbours of all nodes and layers, numbered through in one order, and
    ``(node, layers, starts, degrees)``: a node's layers, sorted, with where its neighbours in each begin and how many there are.

    A hub's neighbours are never gathered: one of them is found by its number.
    """
    order = Stage(global_order(symmetric(edges), "layer", "src", "dst").select("layer", "src", "dst", "position"), "edges").df
    per = order.groupBy(F.col("src").alias("node"), "layer").agg(F.min("position").alias("start"), F.count("*").alias("degree"))
    rows = per.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("layer", "start", "degree"))).alias("x"))
    field = lambda f: F.transform("x", lambda e: e[f])
    nodes = rows.select("node", field("layer").alias("layers"), field("start").alias("starts"), field("degree").alias("degrees"))
    return order.select("position", "dst"), Stage(nodes, "nodes").df


def layered_walks(edges: DataFrame, length: int, stay: float = 0.8, seed: str = "walk", weights: dict[str, float] | None = None) -> DataFrame:
    """``(source, step, layer, node)``: one walk from each node; it stays in its layer with probability ``stay`` where it can, else draws a layer.

    Layers are drawn evenly among those of the node, or by ``weights`` (made to sum to 1 over them). Every choice is
    a hash of source, step and seed. All walks move together: a step finds the node's layers, draws a neighbour's number and finds that.
    """
    around, nodes = numbered_edges(edges)
    now = nodes.select(F.col("node").alias("source"), "node", F.lit(None).cast("string").alias("layer"), F.array(F.struct(F.lit(0).alias("step"), F.lit(None).cast("string").alias("layer"), F.col("node").alias("node"))).alias("path"))
    parts = []
    for step in range(1, length):
        key = F.concat_ws("-", "source", F.lit(step))
        here = now.join(nodes, "node")
        if weights is None:
            drawn = F.element_at("layers", (pick(key, F.size("layers"), seed + "-layer") + 1).cast("int"))
        else:
            weight = lambda x: F.element_at(F.create_map(*[v for k, w in weights.items() for v in (F.lit(k), F.lit(w))]), x)
            total = F.aggregate("layers", F.lit(0.0), lambda s, x: s + weight(x))
            u = uniform(key, seed + "-layer")
            run = F.transform("layers", lambda x, i: F.aggregate(F.slice("layers", F.lit(1), i + 1), F.lit(0.0), lambda s, y: s + weight(y)) / total)
            drawn = F.element_at("layers", F.least(F.size(F.filter(run, lambda r: r <= u)) + 1, F.size("layers")))
        stays = F.col("layer").isNotNull() & F.array_contains("layers", F.col("layer")) & (uniform(key, seed + "-stay") < stay)
        chosen = here.withColumn("layer", F.when(stays, F.col("layer")).otherwise(drawn))
        place = F.array_position("layers", F.col("layer")).cast("int")
        number = F.element_at("starts", place) + pick(key, F.element_at("degrees", place), seed + "-node")
        moved = chosen.select("source", "layer", "path", number.alias("position")).join(around, "position").withColumnRenamed("dst", "node")
        now = moved.select("source", "node", "layer", F.concat("path", F.array(F.struct(F.lit(step).alias("step"), "layer", "node"))).alias("path"))
        if step % STEPS_AT_ONCE == 0 or step == length - 1:
            held = Stage(now, "walk").df
            parts.append(held.select("source", F.inline("path")))
            now = held.select("source", "node", "layer", F.slice("path", 1, 0).alias("path"))
    whole = parts[0] if parts else now.select("source", F.inline("path"))
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def context_pairs(walks: DataFrame, window: int) -> DataFrame:
    """``(center, context, weight)`` of nodes at most ``window`` steps apart in a walk; ``1 - (distance - 1) / window`` summed. Walks: ``(source, step, node)``."""
    gathered = walks.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("step", "node"))).alias("w"))
    near = F.flatten(F.transform("w", lambda a: F.transform(F.filter("w", lambda b: (b["step"] != a["step"]) & (F.abs(b["step"] - a["step"]) <= window)), lambda b: F.struct(a["node"].alias("center"), b["node"].alias("context"), (1 - (F.abs(a["step"] - b["step"]) - 1) / window).alias("weight")))))
    return gathered.select(F.inline(near)).groupBy("center", "context").agg(F.sum("weight").alias("weight"))


def hop_neighbourhood(edges: DataFrame, starts: DataFrame, hops: int = 3, per_level: int = 2, seed: str = "hop") -> DataFrame:
    """``(person, hop, other)``: at each hop the unvisited neighbours of the frontier, of which ``per_level`` go on, by hash. A node counts as visited once found."""
    around = Stage(symmetric(edges.select("src", "dst")), "edges").df
    frontier = starts.select("person", F.col("person").alias("other"))
    seen = Stage(frontier.withColumn("hop", F.lit(0)), "hops").df
    for hop in range(1, hops + 1):
        found = frontier.join(around, F.col("other") == F.col("src")).select("person", F.col("dst").alias("other")).distinct()
        new = Stage(found.join(seen.select("person", "other"), ["person", "other"], "left_anti").withColumn("hop", F.lit(hop)), "hops").df
        order = W.partitionBy("person").orderBy(hash32(F.concat_ws("-", "person", "other"), seed), "other")
        frontier = new.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_level).select("person", "other")
        seen = seen.unionByName(new)
    return seen.filter("hop > 0").select("person", "hop", "other")


def negative_samples(edges: DataFrame, seed: str = "negative") -> DataFrame:
    """``(layer, node, positive, negative)``: for each node one neighbour and one node that isn't, by hash; null if all others are neighbours.

    Both are drawn by number and none twice: the negative is the r-th node that is neither the node nor a neighbour, which is
    node number r + c, where c of the excluded ones come before it. Nothing is gathered.
    """
    both = Stage(symmetric(edges), "edges").df
    index = Stage(dense_index(both.select(F.col("src").alias("node")), "node", into="idx"), "index").df
    n = index.agg(F.count("*").alias("__n"))
    out = both.select("layer", F.col("src").alias("node"), F.col("dst").alias("other"))
    excluded = out.unionByName(out.select("layer", "node", F.col("node").alias("other")).distinct())
    placed = Stage(global_order(excluded.join(index.toDF("other", "idx"), "other"), "layer", "node", "idx").select("layer", "node", "other", "idx", "position"), "excluded").df
    own = placed.groupBy("layer", "node").agg(F.min("position").alias("start"), F.count("*").alias("n"), F.min(F.when(F.col("other") == F.col("node"), F.col("position"))).alias("self"))
    key = F.concat_ws("-", "layer", "node")
    k = F.col("start") + pick(key, F.col("n") - 1, seed + "-p")
    drawn = own.join(F.broadcast(n)).select(
        "layer", "node", "start", (k + (k >= F.col("self")).cast("int")).alias("place"), F.when(F.col("__n") > F.col("n"), pick(key, F.col("__n") - F.col("n"), seed)).alias("r")
    )
    met = placed.join(drawn, ["layer", "node"])
    before = F.sum((F.col("idx") - (F.col("position") - F.col("start")) <= F.col("r")).cast("int"))
    found = met.groupBy("layer", "node").agg(F.max(F.when(F.col("position") == F.col("place"), F.col("other"))).alias("positive"), (F.max("r") + before).alias("idx"))
    return found.join(index.withColumnRenamed("node", "negative"), "idx", "left").select("layer", "node", "positive", "negative")
