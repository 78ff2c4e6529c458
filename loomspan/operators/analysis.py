"""Cross-document analysis of deed facts: people, places, chains of transfers, clans, witnesses, relation graph, network figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.similarity import person_similarity
from loomspan.functions.text import EMPTY_ANALYSIS, is_empty, normal_place, present, price, split_people, surname
from loomspan.operators.grouped import per_group, per_groups
from loomspan.operators.resolution import resolved
from loomspan.streaming.tasks import saved

ROLES = ("seller", "buyer", "middleman")
#: Least score at which a mention joins an entity.
MERGE_AT = 0.42


def mentions(facts: DataFrame) -> DataFrame:
    """(id, user_id, role, name, year, place): one row for each person named in each role."""
    place = normal_place(present(F.col("location"), EMPTY_ANALYSIS))
    long = facts.withColumn("place", place).unpivot(["id", "user_id", "year", "place"], list(ROLES), "role", "names")
    return long.select("id", "user_id", "role", F.explode(split_people(F.when(~F.trim("names").isin(*EMPTY_ANALYSIS), F.col("names")))).alias("name"), "year", "place")


def place_counts(facts: DataFrame) -> DataFrame:
    return facts.select(normal_place(present(F.col("location"), EMPTY_ANALYSIS)).alias("place")).filter("place <> ''").groupBy("place").agg(F.count("*").alias("n"))


def decades(facts: DataFrame) -> DataFrame:
    return facts.filter("year is not null").groupBy((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


def values(facts: DataFrame) -> DataFrame:
    """Mean and sum of prices in taels, null without any."""
    return facts.select(price(F.col("price")).alias("v")).agg(F.round(F.avg("v"), 2).alias("avg_price"), F.round(F.sum("v"), 2).alias("total_value"), F.count("v").alias("n"))


def chains(facts: DataFrame, *, most: int = 10) -> DataFrame:
    """Places with two deeds at least: how many, their years in order, and the first transfers (year, from, to)."""
    rows = facts.withColumns({"place": normal_place(present(F.col("location"), EMPTY_ANALYSIS)), "from": F.get(split_people(F.col("seller")), F.lit(0)), "to": F.get(split_people(F.col("buyer")), F.lit(0))})
    rows = rows.filter("place <> ''")
    several = rows.groupBy("place").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("year")).alias("years")).filter("n >= 2")
    order = Window.partitionBy("place").orderBy(F.coalesce("year", F.lit(99999)), "id")
    first = rows.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most)
    moves = first.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("pos", "year", "from", "to"))).alias("moves"))
    return several.join(moves, "place").select("place", "n", "years", F.expr("transform(moves, m -> struct(m.year as year, m.from as `from`, m.to as `to`))").alias("transfers"))


def clans(entities: DataFrame) -> DataFrame:
    """Surnames that two entities at least share."""
    return entities.select(surname(F.col("name")).alias("surname")).filter("surname <> ''").groupBy("surname").agg(F.count("*").alias("n")).filter("n >= 2")


def clan_members(entities: DataFrame, most: int = 5) -> DataFrame:
    """The members (surname, name, n) of the `most` largest clans, a row each, so that no clan is one value."""
    top = F.broadcast(clans(entities).orderBy(F.desc("n"), "surname").limit(most))
    return entities.select(surname(F.col("name")).alias("surname"), "name").join(top, "surname")


def counterparties(said: DataFrame, most: int = 10) -> DataFrame:
    """For each middleman the first `most` parties of its deeds, in order of their names."""
    parties = said.filter("role <> 'middleman'").select("id", F.col("name").alias("party")).distinct()
    met = said.filter("role = 'middleman'").select("id", "name").distinct().join(parties, "id").select("name", "party").distinct()
    first = met.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("party"))).filter(F.col("k") <= most)
    return first.groupBy("name").agg(F.sort_array(F.collect_list("party")).alias("parties"))


def edge_labels(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges with their label: the first deed's year and price for a trade."""
    at = facts.select(F.col("id").alias("first_doc"), "year", present(F.col("price"), EMPTY_ANALYSIS).alias("price"))
    year = F.when(F.col("year").isNotNull(), F.concat(F.lit("·"), F.col("year"))).otherwise("")
    price_part = F.when(F.col("price") != "", F.concat(F.lit(" ["), "price", F.lit("]"))).otherwise("")
    label = F.when(F.col("relation") == "Trade", F.concat(F.lit("出售"), year, price_part)).otherwise("见证")
    return edges.join(at, "first_doc").select("src", "dst", "relation", "first_doc", "n", label.alias("label"))


def edge_docs(said: DataFrame) -> DataFrame:
    """The deeds noted at each edge, a row each (src, dst, pos, doc): its first one, and every later trade."""
    order = Window.partitionBy("src", "dst").orderBy("id", "kind")
    kept = _relations(said).withColumn("k", F.row_number().over(order)).filter("k = 1 or kind = 0")
    return kept.select("src", "dst", (F.row_number().over(order) - 1).alias("pos"), F.col("id").alias("doc"))


def land_edges(facts: DataFrame) -> DataFrame:
    """Sellers to plots and plots to buyers, one for each ordered pair, with the first deed: plots are places with two deeds at least."""
    rows = facts.select("id", normal_place(present(F.col("location"), EMPTY_ANALYSIS)).alias("place"), "seller", "buyer").filter("place <> ''")
    several = rows.groupBy("place").agg(F.count("*").alias("deeds")).filter("deeds >= 2").select("place")
    rows = rows.join(several, "place", "left_semi").withColumn("plot", F.concat(F.lit("[地块]"), "place"))
    people = lambda c: F.explode(split_people(F.when(~is_empty(F.col(c), EMPTY_ANALYSIS), F.col(c))))
    out = rows.select("id", people("seller").alias("src"), F.col("plot").alias("dst"), F.lit("出让").alias("kind"))
    into = rows.select("id", F.col("plot").alias("src"), people("buyer").alias("dst"), F.lit("受让").alias("kind"))
    return out.unionByName(into).groupBy("src", "dst", "kind").agg(F.min("id").alias("first_doc"))


def edges_of_tasks(said: DataFrame, task: str) -> DataFrame:
    """The different edges of each task (task, src, dst)."""
    return _relations(said, task).select(task, "src", "dst").distinct()


def report(facts: DataFrame, said: DataFrame) -> DataFrame:
    """The ranked parts of a report (part, pos, name, n): people 8, places 8, plots 6, clans 5, witnesses 6; ties by name."""
    parts = {
        "people": (said.groupBy("name").agg(F.countDistinct("id").alias("n")), 8),
        "places": (place_counts(facts).withColumnRenamed("place", "name"), 8),
        "plots": (place_counts(facts).withColumnRenamed("place", "name").filter("n >= 2"), 6),
        "clans": (clans(said.select("name").distinct()).withColumnRenamed("surname", "name"), 5),
        "witnesses": (said.filter("role = 'middleman'").groupBy("name").agg(F.count("*").alias("n")), 6),
    }
    out = None
    for part, (rows, most) in parts.items():
        top = rows.orderBy(F.desc("n"), "name").limit(most).select(F.lit(part).alias("part"), "name", "n")
        out = top if out is None else out.unionByName(top)
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "name")))


def witnesses(said: DataFrame) -> DataFrame:
    """For each middleman: mentions, deeds, and different parties of these deeds.

    Parties are gathered as distinct rows (entity, party) before they are counted, so that no group is held as a whole.
    """
    seen = said.filter("role = 'middleman'")
    parties = said.filter("role <> 'middleman'").select("id", F.col("name").alias("party")).distinct()
    met = seen.select("id", "name").distinct().join(parties, "id").select("name", "party").distinct().groupBy("name").agg(F.count("*").alias("n_parties"))
    base = seen.groupBy("name").agg(F.count("*").alias("witness_count"), F.countDistinct("id").alias("doc_count"))
    return base.join(met, "name", "left").withColumn("n_parties", F.coalesce("n_parties", F.lit(0)))


def roles_of(said: DataFrame) -> DataFrame:
    """For each person: deeds, roles in order, and whether these are several."""
    rows = said.groupBy("name").agg(F.countDistinct("id").alias("n_docs"), F.sort_array(F.collect_set("role")).alias("roles"))
    return rows.withColumn("cross_role", F.size("roles") > 1)


def _relations(said: DataFrame, *more: str) -> DataFrame:
    """(id, src, dst, kind) of every deed: sellers to buyers (0), middlemen to both (1); a deed's people meet once."""
    people = said.select("id", *more, "role", F.col("name").alias("src")).join(said.select("id", F.col("role").alias("to"), F.col("name").alias("dst")), "id")
    trade, witness = F.expr("role = 'seller' and to = 'buyer'"), F.expr("role = 'middleman' and to in ('seller', 'buyer')")
    return people.filter((trade | witness) & (F.col("src") != F.col("dst"))).select("id", *more, "src", "dst", F.when(trade, 0).otherwise(1).alias("kind"))


def relation_edges(said: DataFrame) -> DataFrame:
    """Edges (src, dst): sellers to buyers (Trade), middlemen to both (Witness), one for each ordered pair.

    The first deed (by id, trades before testimonies) gives the relation; n counts all.
    """
    first = F.min(F.struct("id", "kind"))
    return _relations(said).groupBy("src", "dst").agg(F.count("*").alias("n"), first.alias("f")).select("src", "dst", F.when(F.col("f.kind") == 0, "Trade").otherwise("Witness").alias("relation"), F.col("f.id").alias("first_doc"), "n")


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of neighbours in both orders, once; the edges are read once."""
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    return edges.filter("src <> dst").select(F.explode(F.array(pair("src", "dst"), pair("dst", "src"))).alias("p")).select("p.*").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Degree and degree centrality of each node."""
    both = undirected(edges)
    n = both.select("a").distinct().agg(F.count("*").alias("nodes"))
    return both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree")).crossJoin(F.broadcast(n)).select("node", "degree", F.round(F.col("degree") / F.greatest(F.col("nodes") - 1, F.lit(1)), 6).alias("centrality"))


def clustering(edges: DataFrame) -> DataFrame:
    """Clustering coefficient of each node: triangles over pairs of neighbours.

    Each edge points to the node of more neighbours, so that hubs spread few, and of two edges from a node only the
    pair in that order is looked up.  The neighbours are saved once: five branches read them.
    """
    both = saved(undirected(edges), "neighbours")
    degree = both.groupBy("a").agg(F.count("*").alias("d"))
    ranked = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
    up = saved(ranked.filter("d < e or (d = e and a < b)").select("a", "b", "e"), "upward")
    wedge = up.alias("x").join(up.alias("y"), F.col("x.a") == F.col("y.a")).filter("x.e < y.e or (x.e = y.e and x.b < y.b)").select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    triangle = wedge.join(up.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"])
    corner = triangle.select(F.explode(F.array("a", "b", "c")).alias("a")).groupBy("a").agg(F.count("*").alias("t"))
    return degree.join(corner, "a", "left").select(F.col("a").alias("node"), F.round(F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0), 6).alias("clustering"))


def density(edges: DataFrame) -> DataFrame:
    both = undirected(edges)
    counts = both.agg(F.countDistinct("a").alias("nodes"), (F.count("*") / 2).cast("long").alias("edges"))
    return counts.select("nodes", "edges", F.round(2 * F.col("edges") / F.greatest(F.col("nodes"), F.lit(1)), 2).alias("avg_degree"), F.round(F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0), 4).alias("density"))


def betweenness(adjacent: dict[str, set[str]]) -> dict[str, float]:
    """Share of shortest paths through each node (undirected, normalised): one breadth-first search from each, then dependencies back to front."""
    total = dict.fromkeys(adjacent, 0.0)
    for source in adjacent:
        ways, level, before, order = {source: 1.0}, {source: 0}, {source: []}, [source]
        for node in order:
            for other in sorted(adjacent[node]):
                if other not in level:
                    level[other], ways[other], before[other] = level[node] + 1, 0.0, []
                    order.append(other)
                if level[other] == level[node] + 1:
                    ways[other] += ways[node]
                    before[other].append(node)
        owed = dict.fromkeys(order, 0.0)
        for node in reversed(order):
            for other in before[node]:
                owed[other] += ways[other] / ways[node] * (1 + owed[node])
            if node != source:
                total[node] += owed[node]
    pairs = (len(adjacent) - 1) * (len(adjacent) - 2)
    return {node: v / pairs if pairs > 0 else 0.0 for node, v in total.items()}


def communities(adjacent: dict[str, set[str]]) -> dict[str, int]:
    """Greedy modularity: the two linked communities that gain most are joined until no join gains; ties by least member."""
    links = sum(map(len, adjacent.values())) / 2
    group = {node: [node] for node in sorted(adjacent)}
    weight = {a: {b: 1.0 for b in adjacent[a]} for a in group}
    degree = {a: float(len(adjacent[a])) for a in group}
    while links:
        gains = [(weight[a][b] / links - degree[a] * degree[b] / (2 * links * links), a, b) for a in group for b in weight[a] if a < b]
        best = max(gains, key=lambda g: (g[0], [-ord(c) for c in g[1]], [-ord(c) for c in g[2]]), default=None)
        if best is None or best[0] <= 1e-12:
            break
        _, a, b = best
        for c, w in weight.pop(b).items():
            weight[c].pop(b)
            if c != a:
                weight[a][c] = weight[c][a] = weight[a].get(c, 0.0) + w
        group[a] += group.pop(b)
        degree[a] += degree.pop(b)
    return {node: k for k, members in enumerate(sorted(group.values(), key=lambda m: (-len(m), min(m)))) for node in members}


def network_of_tasks(edges: DataFrame, task: str) -> DataFrame:
    """Betweenness and community of each node in the graph of each task (task, src, dst): a task holds the deeds that a user picked, so its graph is small."""

    def one(number, c) -> list[tuple]:
        adjacent: dict[str, set[str]] = {}
        for a, b in zip(c["src"], c["dst"], strict=True):
            adjacent.setdefault(a, set()).add(b)
            adjacent.setdefault(b, set()).add(a)
        between, part = betweenness(adjacent), communities(adjacent)
        return [(number, n, round(between[n], 6), part[n]) for n in adjacent]

    return per_group(edges.select(task, "src", "dst"), task, ["src", "dst"], one, f"{task} long, node string, betweenness double, community int")


def scored_pairs(said: DataFrame, task: str) -> DataFrame:
    """Similarity of different (name, year, place) within each task whose names share a character or a surname (others can't score).

    Candidates meet on characters, not in a product of all mentions.
    """
    who = said.select(task, "name", "year", "place").distinct().withColumn("char", F.explode(F.array_distinct(F.split("name", ""))))
    a, b = who.alias("a"), who.alias("b")
    key = lambda x: F.struct(f"{x}.name", F.coalesce(f"{x}.year", F.lit(-1)), F.coalesce(f"{x}.place", F.lit("")))
    met = a.join(b, (F.col(f"a.{task}") == F.col(f"b.{task}")) & (F.col("a.char") == F.col("b.char")) & (key("a") < key("b")))
    pairs = met.select(F.col(f"a.{task}").alias(task), *[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("name", "year", "place")]).distinct()
    return pairs.withColumn("score", person_similarity(*[F.col(f"{c}_{x}") for c in ("name", "year", "place") for x in "ab"]))


def resolve_task(rows: list[tuple[str, str, int | None, str, int]], score) -> list[int]:
    """Entity number of each mention (name, role, year, place, doc), taken in order: the plain form of resolution.resolved.

    A mention joins the entity whose linkage is greatest and MERGE_AT at least: the greatest score if it has one or
    two mentions, else the mean of the two greatest.  Otherwise it starts one.
    """
    entities: list[list[int]] = []
    out = []
    for n, row in enumerate(rows):
        best, at = 0.0, -1
        for k, members in enumerate(entities):
            scores = sorted((score(row, rows[m]) for m in members), reverse=True)
            link = scores[0] if len(scores) <= 2 else (scores[0] + scores[1]) / 2
            if link >= MERGE_AT and link > best:
                best, at = link, k
        if at < 0:
            entities.append([n])
            at = len(entities) - 1
        else:
            entities[at].append(n)
        out.append(at)
    return out


def standard_name(names: list[str]) -> str:
    """The most frequent of the longest names, the first of equals."""
    longest = [x for x in names if len(x) == max(map(len, names))]
    return max(longest, key=names.count)


def resolve(said: DataFrame, task: str) -> DataFrame:
    """Entities of each task: (task, entity, name, n_mentions, n_docs, cross_role).

    Assignment depends on the order of mentions (deed, role, name), so that a task's mentions go through Python together,
    with those of other tasks; a task holds the deeds that one user picked.  See resolution.resolved.
    """
    role = {"seller": 0, "buyer": 1, "middleman": 2}
    rows = said.withColumn("r", F.create_map(*[F.lit(x) for kv in role.items() for x in kv])[F.col("role")]).select(task, "id", "r", "name", F.coalesce("year", F.lit(0)).alias("year"), F.coalesce("place", F.lit("")).alias("place"))
    schema = f"{task} long, entity int, name string, n_mentions long, n_docs long, cross_role boolean"
    return per_groups(rows, task, ["id", "r", "name", "year", "place"], lambda some: resolved(some, task, MERGE_AT), schema)
