"""The query catalogue: each query of the engine over the test tables, with the SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import alignment, text
from loomspan.functions.similarity import cosine
from loomspan.operators import analysis, dashboard, layout, proofread, relational, retrieval
from loomspan.sources import deeds, files, tables
from loomspan.sources.deeds import SQL, table
from loomspan.streaming import tasks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = datetime(1998, 6, 1)


def query(sql: str | None = None, *, model: bool = True) -> Callable[[Query], Query]:
    """Register a query under its function's name, with DuckDB SQL over the deed model (r, i, f) or over plain tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {SQL}{sql}" if model and sql.startswith(",") else f"WITH {SQL} {sql}" if model else sql
        return f

    return add


def facts(spark: SparkSession, d: str) -> DataFrame:
    return deeds.deed_facts(deeds.contents(spark, d))


# C1: relational store ------------------------------------------------------------------------------------------------


@query("SELECT r.id, r.image_id, i.user_id, i.filename, r.status FROM r JOIN i ON i.id = r.image_id")
def jn01_result_with_image(spark, d):
    return relational.lineage(deeds.images(spark, d), deeds.results(spark, d)).select(F.col("ocr_result_id").alias("id"), "image_id", "user_id", "filename", "status")


@query("SELECT user_id, count(DISTINCT image_id) AS n_images, count(*) AS n_docs FROM f GROUP BY user_id")
def jn02_structured_per_user(spark, d):
    df = relational.lineage(deeds.images(spark, d), deeds.results(spark, d), deeds.contents(spark, d))
    return df.groupBy("user_id").agg(F.countDistinct("image_id").alias("n_images"), F.count("*").alias("n_docs"))


@query("SELECT f.id * 3 AS graph_id, f.id AS structured_id, f.ocr_result_id, f.image_id, f.user_id FROM f")
def jn03_graph_lineage(spark, d):
    structured = deeds.contents(spark, d)
    graphs = structured.select((F.col("id") * 3).alias("id"), F.col("id").alias("structured_id"))
    df = relational.lineage(deeds.images(spark, d), deeds.results(spark, d), structured, graphs)
    return df.select("graph_id", "structured_id", "ocr_result_id", "image_id", "user_id")


@query("SELECT image_id, max(id) AS id FROM r WHERE status = 'done' GROUP BY image_id")
def ag03_latest_done_per_image(spark, d):
    return deeds.results(spark, d).filter("status = 'done'").groupBy("image_id").agg(F.max("id").alias("id"))


@query("SELECT image_id, id, status, confidence FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY id DESC) AS n FROM r) WHERE n = 1")
def wn01_latest_result(spark, d):
    return relational.latest_per(deeds.results(spark, d), "image_id").select("image_id", "id", "status", "confidence")


@query("SELECT id, image_id, status FROM r WHERE id IN (SELECT max(id) FROM r WHERE status = 'done' GROUP BY image_id)")
def jn06_semi_join_latest(spark, d):
    r = deeds.results(spark, d)
    return r.join(r.filter("status = 'done'").groupBy("image_id").agg(F.max("id").alias("id")).select("id"), "id", "left_semi").select("id", "image_id", "status")


@query("SELECT i.id, i.user_id FROM i WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.image_id = i.id)")
def jn08_images_without_result(spark, d):
    images = deeds.images(spark, d)
    return relational.missing(images, deeds.results(spark, d).select(F.col("image_id").alias("id"))).join(images, "id").select("id", "user_id")


@query("SELECT c_custkey AS id, count(i.id) AS n_images FROM customer LEFT JOIN i ON i.user_id = c_custkey GROUP BY c_custkey")
def jn10_image_counts(spark, d):
    return relational.with_counts(deeds.users(spark, d), deeds.images(spark, d), "user_id", "n_images").select("id", "n_images")


@query("SELECT i.id AS image_id, s.id AS structured_id FROM i LEFT JOIN (SELECT image_id, max(id) AS id FROM f GROUP BY image_id) s ON s.image_id = i.id")
def jn11_latest_child(spark, d):
    latest = relational.latest_per(deeds.contents(spark, d), "image_id").select("image_id", F.col("id").alias("structured_id"))
    return deeds.images(spark, d).select(F.col("id").alias("image_id")).join(latest, "image_id", "left")


@query("SELECT id, user_id, upload_time FROM i ORDER BY upload_time DESC, id DESC LIMIT 20 OFFSET 40")
def st01_image_page(spark, d):
    return relational.page(deeds.images(spark, d), [F.desc("upload_time"), F.desc("id")], 40, 20).select("id", "user_id", "upload_time")


@query("SELECT id, user_id, filename FROM i WHERE id = 7 AND user_id = (SELECT o_custkey FROM orders WHERE o_orderkey = 7)")
def prj01_point_lookup(spark, d):
    images = deeds.images(spark, d)
    owner = images.filter("id = 7").select("user_id").first()
    return relational.point(images, 7, owner.user_id if owner else -1).select("id", "user_id", "filename")


@query("SELECT id, image_id FROM r WHERE status = 'done' AND raw_text IS NOT NULL AND confidence >= 0.95")
def prj02_conjunctive_filter(spark, d):
    return deeds.results(spark, d).filter("status = 'done' and raw_text is not null and confidence >= 0.95").select("id", "image_id")


@query(
    """SELECT id, CASE WHEN human_corrected AND trim(coalesce(corrected_text, '')) <> '' THEN trim(corrected_text) ELSE trim(coalesce(raw_text, '')) END AS analysis_text,
    CASE WHEN human_corrected AND trim(coalesce(corrected_text, '')) <> '' THEN trim(corrected_text) ELSE coalesce(raw_text, '') END AS context_text FROM r"""
)
def prj06_chosen_text(spark, d):
    raw, corrected, human = F.col("raw_text"), F.col("corrected_text"), F.col("human_corrected")
    return deeds.results(spark, d).select("id", text.chosen_text(raw, corrected, human).alias("analysis_text"), text.chosen_text(raw, corrected, human, trim_raw=False).alias("context_text"))


@query(
    "SELECT id, "
    + ", ".join(f"""location IS NULL OR trim(location) IN ({', '.join(f"'{t}'" for t in getattr(text, n))}) AS {n.lower()}""" for n in ("EMPTY_DASHBOARD", "EMPTY_ANALYSIS", "EMPTY_INDEX", "EMPTY_CONTEXT", "EMPTY_GRAPH"))
    + " FROM f"
)
def prj10_empty_tokens(spark, d):
    names = ("EMPTY_DASHBOARD", "EMPTY_ANALYSIS", "EMPTY_INDEX", "EMPTY_CONTEXT", "EMPTY_GRAPH")
    return facts(spark, d).select("id", *[text.is_empty(F.col("location"), getattr(text, n)).alias(n.lower()) for n in names])


NAMES = "CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN 'user_' || c_custkey WHEN 2 THEN 'ab' WHEN 3 THEN '地契' || c_custkey WHEN 4 THEN repeat('x', CAST(c_custkey % 40 AS INT)) ELSE 'a b' END"


@query(f"SELECT c_custkey AS id, length(n) BETWEEN 3 AND 32 AND regexp_full_match(n, '[A-Za-z0-9_一-鿿]+') AS valid, length(left(c_mktsegment, (c_custkey % 12)::INTEGER)) >= 8 AS valid_password FROM (SELECT *, {NAMES} AS n FROM customer)", model=False)
def prj12_username_rule(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(NAMES).alias("name"), F.expr("left(c_mktsegment, CAST(c_custkey % 12 AS INT))").alias("password"))
    return rows.select("id", proofread.valid_username(F.col("name")).alias("valid"), proofread.valid_password(F.col("password")).alias("valid_password"))


UPLOADS = "'/a.b/f' || page_id || CASE page_id % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' WHEN 3 THEN '' WHEN 4 THEN '.webp' ELSE '.x.tif' END"


@query(f"""SELECT page_id, CASE WHEN NOT lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'webp', 'bmp', 'tif', 'tiff') THEN 'type' WHEN length = 0 THEN 'empty' WHEN length > 2000 THEN 'too large' END AS refused
    FROM (SELECT page_id, {UPLOADS} AS path, CASE WHEN page_id % 4 = 0 THEN 0 ELSE strlen(html) END AS length FROM pages)""", model=False)
def prj13_upload_gate(spark, d):
    size = F.when(F.col("page_id") % 4 == 0, 0).otherwise(F.octet_length("html"))
    return files.gated(table(spark, d, "pages").select("page_id", F.expr(UPLOADS).alias("path"), size.alias("length")), most=2000).select("page_id", "refused")


@query(r"SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g')) > 588 THEN 'hard_reject:too_long:' || length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) || '>588' END AS reason FROM documents", model=False)
def prj15_length_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.too_long(F.col("text")).alias("reason"))


@query("SELECT id, CASE WHEN created_at >= TIMESTAMP '1998-06-01' - INTERVAL 30 MINUTE THEN 'blocked' ELSE 'stale' END AS lock FROM r WHERE status = 'processing'")
def prj17_locks(spark, d):
    return relational.locks(deeds.results(spark, d), NOW).select("id", "lock")


@query(
    """SELECT id, CASE WHEN filename IN ('img_3.jpg', 'img_14.jpg') THEN 'regression' WHEN s % 5 = 0 THEN 'test' WHEN s % 5 = 1 THEN 'dev' ELSE 'audit' END AS split
    FROM (SELECT id, filename, list_sum(list_transform(string_split(sha256(filename), ''), lambda c: strpos('0123456789abcdef', c) - 1)) AS s FROM i)"""
)
def prj18_hash_split(spark, d):
    return deeds.images(spark, d).select("id", text.fold_of(F.col("filename"), ("img_3.jpg", "img_14.jpg")).alias("split"))


@query("SELECT status, human_corrected, count(*) AS n, count(raw_text) AS n_text FROM r GROUP BY ALL")
def ag01_status_counts(spark, d):
    return deeds.results(spark, d).groupBy("status", "human_corrected").agg(F.count("*").alias("n"), F.count("raw_text").alias("n_text"))


@query(
    """SELECT user_id, image_id, n FROM (SELECT user_id, image_id, row_number() OVER (PARTITION BY user_id ORDER BY first_id) AS n
    FROM (SELECT user_id, image_id, min(id) AS first_id FROM f GROUP BY user_id, image_id)) WHERE n <= 3"""
)
def wn03_first_three_images(spark, d):
    first = deeds.contents(spark, d).groupBy("user_id", "image_id").agg(F.min("id").alias("first_id"))
    return relational.top_per(first, "user_id", [F.asc("first_id")], 3, name="n").select("user_id", "image_id", "n")


@query("SELECT image_id, arg_min(price, created_at::VARCHAR || lpad(id::VARCHAR, 12, '0')) AS first_price, arg_max(price, created_at::VARCHAR || lpad(id::VARCHAR, 12, '0')) AS last_price FROM (SELECT r.image_id, r.created_at, r.id, coalesce(f.price, '') AS price FROM r JOIN f ON f.ocr_result_id = r.id) GROUP BY image_id")
def wn06_first_last_price(spark, d):
    r = deeds.results(spark, d).select(F.col("id").alias("ocr_result_id"), "created_at")
    rows = deeds.contents(spark, d).select("id", "ocr_result_id", "image_id", F.coalesce(F.get_json_object("content", "$.Price"), F.lit("")).alias("price")).join(r, "ocr_result_id")
    order = F.struct("created_at", "id")
    return rows.groupBy("image_id").agg(F.min_by("price", order).alias("first_price"), F.max_by("price", order).alias("last_price"))


@query(
    """SELECT * FROM (SELECT vec_id, label, 'old' AS version FROM embeddings WHERE vec_id % 3 <> 0
    UNION ALL SELECT vec_id, label + 100, 'new' FROM embeddings WHERE vec_id % 3 = 0) WHERE vec_id % 7 <> 0""",
    model=False,
)
def src13_vector_upsert_delete(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.lit("old").alias("version"), F.lit(0).alias("n"))
    changes = rows.filter("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit("new").alias("version"), F.lit(1).alias("n"))
    changes = changes.unionByName(changes.withColumns({"n": F.lit(0), "label": F.lit(-1)}))
    left = relational.upsert(rows, changes, "vec_id", order="n")
    return relational.delete(left, rows.filter("vec_id % 7 = 0"), "vec_id").select("vec_id", "label", "version")


@query("SELECT 'all' AS name, count(*) AS n FROM embeddings UNION ALL SELECT 'odd', count(*) FROM embeddings WHERE vec_id % 2 = 1", model=False)
def src15_vector_count(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.create_map(F.lit("parity"), (F.col("vec_id") % 2).cast("string")).alias("metadata"))
    return spark.createDataFrame([("all", tables.count_vectors(rows)), ("odd", tables.count_vectors(rows, {"parity": "1"}))], "name string, n long")


@query(
    """SELECT 'image' AS name, count(*) AS n FROM i WHERE user_id % 10 <> 0 UNION ALL SELECT 'ocr_result', count(*) FROM r WHERE image_id NOT IN (SELECT id FROM i WHERE user_id % 10 = 0)
    UNION ALL SELECT 'structured', count(*) FROM f WHERE user_id % 10 <> 0"""
)
def set07_cascade(spark, d):
    gone = deeds.users(spark, d).filter("id % 10 = 0").select("id")
    chain = [("image", deeds.images(spark, d), "user_id"), ("ocr_result", deeds.results(spark, d), "image_id"), ("structured", deeds.contents(spark, d), "ocr_result_id")]
    left = relational.cascade(chain, gone)
    out = None
    for name, df in left.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT id, raw_text, corrected_text, NULL::VARCHAR AS engine, NULL::BOOLEAN AS reviewed FROM r")
def src03_migration(spark, d):
    rows = deeds.results(spark, d).select("id", "raw_text", "corrected_text")
    return relational.migrated(rows, {"engine": "string", "raw_text": "string", "reviewed": "boolean"})


@query(
    """SELECT id, CASE WHEN m THEN orig ELSE raw_text END AS raw_text, CASE WHEN m THEN raw_text ELSE corrected_text END AS corrected_text,
    human_corrected AND (m OR corrected_text IS NOT NULL) AS human_corrected
    FROM (SELECT *, coalesce(human_corrected AND corrected_text IS NULL AND orig IS NOT NULL AND orig <> raw_text, false) AS m FROM (SELECT id, raw_text, CASE WHEN id % 4 > 0 THEN corrected_text END AS corrected_text, human_corrected, CASE WHEN id % 5 > 0 THEN 'original ' || id END AS orig FROM r))"""
)
def src04_legacy_repair(spark, d):
    rows = deeds.results(spark, d).select("id", "raw_text", F.when(F.col("id") % 4 > 0, F.col("corrected_text")).alias("corrected_text"), "human_corrected", F.when(F.col("id") % 5 > 0, F.concat(F.lit("original "), "id")).alias("original_raw_text"))
    return relational.repaired(rows).drop("original_raw_text")


@query("SELECT 'demo_' || filename AS filename, 1 AS user_id, id FROM i WHERE user_id = 2")
def src24_copy_bundle(spark, d):
    images = deeds.images(spark, d)
    return relational.copied(images.filter("user_id = 2"), images, 1, "demo_").select("filename", "user_id", "id")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'edited: ' || text ELSE text END AS text FROM conversations", model=False)
def set06_merge_edits(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return relational.merged_edits(turns, turns.filter("turn % 2 = 0").withColumn("text", F.concat(F.lit("edited: "), "text")), ["conv_id", "turn"])


@query("SELECT id, image_id, key, row_number() OVER (PARTITION BY image_id ORDER BY string_split(key, '·')[1]::INTEGER, string_split(key, '·')[2]::INTEGER, id) AS pos FROM (SELECT id, image_id, l_partkey % 13 || '·' || l_suppkey % 120 AS key FROM r)")
def st07_natural_order(spark, d):
    rows = deeds.results(spark, d).select("id", "image_id", F.concat_ws("·", F.col("l_partkey") % 13, F.col("l_suppkey") % 120).alias("key"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("image_id").orderBy(text.natural_key(F.col("key")), "id")))


# C2: dashboard -------------------------------------------------------------------------------------------------------


@query("SELECT year, count(*) AS n FROM f WHERE year IS NOT NULL GROUP BY year")
def ag05_year_histogram(spark, d):
    return dashboard.years(facts(spark, d))


@query("SELECT location AS name, count(*) AS n FROM f WHERE location NOT IN ('未识别') GROUP BY location ORDER BY n DESC, min(id) LIMIT 10")
def ag06_top_places(spark, d):
    return dashboard.places(facts(spark, d))


@query("SELECT name, count(*) AS n FROM (SELECT id * 3 AS seen, seller AS name FROM f UNION ALL SELECT id * 3 + 1, buyer FROM f UNION ALL SELECT id * 3 + 2, middleman FROM f) WHERE name IS NOT NULL AND name <> '未识别' GROUP BY name ORDER BY n DESC, min(seen) LIMIT 10")
def ag07_top_people(spark, d):
    return dashboard.people(facts(spark, d))


@query(r"SELECT year, round(avg(regexp_extract(price, '\d+(\.\d+)?')::DOUBLE), 2) AS avg_price, count(*) AS n FROM f WHERE year IS NOT NULL AND regexp_matches(price, '\d') GROUP BY year")
def ag08_price_trend(spark, d):
    return dashboard.price_trend(facts(spark, d))


@query('SELECT min(year) AS start, max(year) AS "end", max(year) - min(year) AS span, count(year) AS docs_with_time FROM f')
def ag09_time_range(spark, d):
    return dashboard.span(facts(spark, d))


@query("SELECT i.user_id, count(*) AS total_images, coalesce(max(n), 0) AS total_analyzed FROM i LEFT JOIN (SELECT user_id, count(DISTINCT image_id) AS n FROM f GROUP BY user_id) s ON s.user_id = i.user_id GROUP BY i.user_id")
def ag02_dashboard_totals(spark, d):
    return dashboard.totals(deeds.images(spark, d), deeds.contents(spark, d))


# C3: cross-document analysis -----------------------------------------------------------------------------------------

MENTIONS = """, m AS (SELECT id, user_id, year, place, role, name FROM (
    SELECT id, user_id, year, place, 'seller' AS role, seller AS name FROM f UNION ALL SELECT id, user_id, year, place, 'buyer', buyer FROM f
    UNION ALL SELECT id, user_id, year, place, 'middleman', unnest(string_split(middleman, '、')) FROM f WHERE middleman <> '未识别') WHERE name IS NOT NULL)"""


@query(f"{MENTIONS} SELECT id, user_id, year, place, role, name FROM m")
def an01_mentions(spark, d):
    return analysis.mentions(facts(spark, d))


@query("SELECT place, count(*) AS n FROM f WHERE place <> '' GROUP BY place")
def ag10_normal_places(spark, d):
    return analysis.place_counts(facts(spark, d))


@query("SELECT (year // 10 * 10)::INTEGER AS decade, count(*) AS n FROM f WHERE year IS NOT NULL GROUP BY ALL")
def ag11_decades(spark, d):
    return analysis.decades(facts(spark, d))


@query("SELECT round(avg(value), 2) AS avg_price, round(sum(value), 2) AS total_value, count(value) AS n FROM f")
def ag12_values(spark, d):
    return analysis.values(facts(spark, d))


@query(f"{MENTIONS} SELECT name, count(DISTINCT id) AS n_docs, list_sort(list(DISTINCT role)) AS roles, count(DISTINCT role) > 1 AS cross_role FROM m GROUP BY name")
def ag13_roles(spark, d):
    return analysis.roles_of(analysis.mentions(facts(spark, d)))


@query(f"{MENTIONS} SELECT left(name, 1) AS surname, count(*) AS n FROM (SELECT DISTINCT name FROM m) GROUP BY 1 HAVING count(*) >= 2")
def ag15_clans(spark, d):
    return analysis.clans(analysis.mentions(facts(spark, d)).select("name").distinct())


@query(f"{MENTIONS} SELECT w.name, count(DISTINCT (w.id, w.k)) AS witness_count, count(DISTINCT w.id) AS doc_count, count(DISTINCT p.name) AS n_parties FROM (SELECT *, row_number() OVER () AS k FROM m WHERE role = 'middleman') w LEFT JOIN (SELECT id, name FROM m WHERE role <> 'middleman') p ON p.id = w.id GROUP BY w.name")
def ag16_witnesses(spark, d):
    return analysis.witnesses(analysis.mentions(facts(spark, d)))


EDGES = f"""{MENTIONS}, e AS (SELECT src, dst, CASE WHEN arg_min(kind, id * 2 + kind) = 0 THEN 'Trade' ELSE 'Witness' END AS relation, min(id * 2 + kind) // 2 AS first_doc, count(*) AS n FROM (
    SELECT a.id, a.name AS src, b.name AS dst, 0 AS kind FROM m a JOIN m b ON a.id = b.id AND a.role = 'seller' AND b.role = 'buyer'
    UNION ALL SELECT a.id, a.name, b.name, 1 FROM m a JOIN m b ON a.id = b.id AND a.role = 'middleman' AND b.role IN ('seller', 'buyer')) WHERE src <> dst GROUP BY src, dst)"""
PAIRS = f"{EDGES}, u AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e))"


@query(f"{EDGES} SELECT src, dst, relation, first_doc, n FROM e")
def ag17_relation_edges(spark, d):
    return analysis.relation_edges(analysis.mentions(facts(spark, d)))


@query(f"{PAIRS} SELECT a AS node, count(*) AS degree, round(count(*) / greatest((SELECT count(DISTINCT a) FROM u) - 1, 1), 6) AS centrality FROM u GROUP BY a")
def gr01_degree(spark, d):
    return analysis.degrees(analysis.relation_edges(analysis.mentions(facts(spark, d))))


@query(f"{PAIRS} SELECT nodes, edges, round(2 * edges / nodes, 2) AS avg_degree, round(2 * edges / (nodes * (nodes - 1)), 4) AS density FROM (SELECT count(DISTINCT a) AS nodes, count(*) // 2 AS edges FROM u)")
def gr02_density(spark, d):
    return analysis.density(analysis.relation_edges(analysis.mentions(facts(spark, d))))


@query(f"{PAIRS}, k AS (SELECT a, count(*) AS d FROM u GROUP BY a), t AS (SELECT x.a, count(*) AS t FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY x.a) SELECT k.a AS node, round(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 6) AS clustering FROM k LEFT JOIN t ON t.a = k.a")
def gr03_clustering(spark, d):
    return analysis.clustering(analysis.relation_edges(analysis.mentions(facts(spark, d))))


@query()
def gr04_network_of_tasks(spark, d):
    """Each user's deeds are a task; tests hold the measures of a graph against plain definitions."""
    return analysis.network_of_tasks(analysis.edges_of_tasks(analysis.mentions(facts(spark, d)), "user_id"), "user_id")


@query(
    """SELECT place, count(*) AS n, list_sort(list(DISTINCT year) FILTER (year IS NOT NULL)) AS years FROM f WHERE place <> '' GROUP BY place HAVING count(*) >= 2"""
)
def wn07_land_chains(spark, d):
    return analysis.chains(facts(spark, d)).select("place", "n", "years")


@query(
    """SELECT place, pos, year, "from", "to" FROM (SELECT place, row_number() OVER (PARTITION BY place ORDER BY coalesce(year, 99999), id) AS pos, year, seller AS "from", buyer AS "to", count(*) OVER (PARTITION BY place) AS n FROM f WHERE place <> '') WHERE n >= 2 AND pos <= 10"""
)
def wn07_transfers(spark, d):
    return analysis.chains(facts(spark, d)).select("place", F.posexplode("transfers")).select("place", (F.col("pos") + 1).alias("pos"), "col.*")


@query()
def jn19_entity_resolution(spark, d):
    return analysis.resolve(analysis.mentions(facts(spark, d)), "user_id")


@query(
    """SELECT p_partkey, p_name, s_name, CASE WHEN p_name = s_name THEN 1.0 ELSE round(1 - levenshtein(p_name, s_name) / greatest(length(p_name), length(s_name)), 6) END AS edit_similarity FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT max(s_suppkey) + 1 FROM supplier)""",
    model=False,
)
def fn01_edit_similarity(spark, d):
    from loomspan.functions.similarity import edit_similarity

    suppliers = table(spark, d, "supplier")
    most = F.broadcast(suppliers.agg((F.max("s_suppkey") + 1).alias("most")))
    joined = table(spark, d, "part").crossJoin(most).join(suppliers, F.col("s_suppkey") == F.col("p_partkey") % F.col("most"))
    return joined.select("p_partkey", "p_name", "s_name", F.round(edit_similarity(F.col("p_name"), F.col("s_name")), 6).alias("edit_similarity"))


# C4: recognised pages ------------------------------------------------------------------------------------------------


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Boxes on pages from order lines: three views, texts of a few characters."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    x1, y1 = (F.col("l_partkey") % 40 * 20).cast("int"), (F.col("l_suppkey") % 25 * 36).cast("int")
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    rows = table(spark, d, "lineitem").withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    return rows.select(
        F.col("l_orderkey").alias("page"),
        n.cast("long").alias("seg"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + 20 + q).alias("x2"),
        (y1 + 24 + q * 2).alias("y2"),
        (1 - F.col("l_discount")).alias("score"),
        F.round(1 - F.col("l_tax"), 2).alias("confidence"),
        F.concat(F.lit("v"), n % 3).alias("view"),
        F.element_at(F.array(F.lit("立"), F.lit("契"), F.lit("□")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("text"),
        F.array(F.concat(F.lit("uncertain:"), F.col("l_returnflag")), F.lit("accepted:x")).alias("reasons"),
    )


SEGMENTS = """WITH s AS (SELECT l_orderkey AS page, l_linenumber::BIGINT AS seg, (l_partkey % 40 * 20)::INTEGER AS x1, (l_suppkey % 25 * 36)::INTEGER AS y1,
    (l_partkey % 40 * 20 + 20 + l_quantity::INTEGER)::INTEGER AS x2, (l_suppkey % 25 * 36 + 24 + l_quantity::INTEGER * 2)::INTEGER AS y2, 1 - l_discount AS score, round(1 - l_tax, 2) AS confidence,
    'v' || l_linenumber % 3 AS view, (['立', '契', '□'])[l_suppkey % 3 + 1] AS text, 'uncertain:' || l_returnflag AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS rn FROM lineitem) WHERE rn = 1)"""


@query(
    f"""{SEGMENTS} SELECT page, a, b, round(inter / (aa + ab - inter), 6) AS iou, round(inter / least(aa, ab), 6) AS containment FROM (
    SELECT s.page, s.seg AS a, t.seg AS b, (s.x2 - s.x1) * (s.y2 - s.y1) AS aa, (t.x2 - t.x1) * (t.y2 - t.y1) AS ab, greatest(0, least(s.x2, t.x2) - greatest(s.x1, t.x1)) * greatest(0, least(s.y2, t.y2) - greatest(s.y1, t.y1)) AS inter
    FROM s JOIN s t ON s.page = t.page AND s.seg < t.seg) WHERE inter / (aa + ab - inter) >= 0.3 OR inter / least(aa, ab) >= 0.6""",
    model=False,
)
def jn20_overlaps(spark, d):
    return layout.overlaps(segments(spark, d), "page", iou=0.3, contained=0.6)


@query()
def st06_reading_order(spark, d):
    return layout.laid_out(segments(spark, d), "page")


@query()
def jn21_clusters(spark, d):
    return layout.clustered(segments(spark, d), "page")


@query(f"{SEGMENTS} SELECT page, seg, row_number() OVER (PARTITION BY page ORDER BY x1 DESC, y1, seg) - 1 AS order_index, 's' || lpad((row_number() OVER (PARTITION BY page ORDER BY x1 DESC, y1, seg) - 1)::VARCHAR, 4, '0') AS segment_id FROM s", model=False)
def st05_fixed_order(spark, d):
    return layout.fixed_order(segments(spark, d), "page").select("page", "seg", "order_index", "segment_id")


@query(f"{SEGMENTS} SELECT page, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM s GROUP BY page", model=False)
def ag21_union_box(spark, d):
    return layout.union_box(segments(spark, d), ["page"])


@query(f"{SEGMENTS} SELECT page, seg, text, confidence FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY confidence DESC, score DESC, (text <> '□')::INTEGER DESC, seg) AS n FROM s) WHERE n = 1", model=False)
def st09_best_segment(spark, d):
    return layout.best_of(segments(spark, d), ["page"])


@query(
    f"""{SEGMENTS}, v AS (SELECT page, text, count(DISTINCT view) AS views, count(*) AS n, sum(confidence::DECIMAL(6, 2)) AS total, min(confidence) AS confidence FROM s WHERE text <> '□' GROUP BY page, text)
    SELECT page, text, views, round(confidence, 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY views DESC, n DESC, total DESC, text DESC) AS k FROM v) WHERE k = 1 AND views >= 2""",
    model=False,
)
def ag24_text_vote(spark, d):
    rows = segments(spark, d).withColumn("confidence", F.col("confidence").cast("decimal(6,2)"))
    return layout.voted(rows, ["page"]).withColumn("confidence", F.col("confidence").cast("double"))


@query(f"{SEGMENTS} SELECT page, median(score) AS median_score FROM s GROUP BY page", model=False)
def ag22_median(spark, d):
    return segments(spark, d).groupBy("page").agg(F.coalesce(F.median("score"), F.lit(0.0)).alias("median_score"))


@query(
    f"""{SEGMENTS} SELECT page, round(least(1, sum(confidence::DECIMAL(6, 2)) / greatest(count(*), 1)), 4)::DOUBLE AS confidence, round(least(1, sum((text <> '□')::INTEGER) / greatest(count(*), 1)), 4) AS coverage, list_sort(list(DISTINCT reason)) AS reasons FROM s GROUP BY page""",
    model=False,
)
def ag19_page_quality(spark, d):
    return layout.page_quality(segments(spark, d).withColumn("medium_text", F.col("text")), "page")


# C5: evaluation ------------------------------------------------------------------------------------------------------


def pairs_of_texts(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items against the texts that follow them."""
    items = table(spark, d, "benchmark")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("guess"))
    return items.select("item_id", F.col("text").alias("truth")).join(after, "item_id")


@query()
def ev01_char_metrics(spark, d):
    measured = alignment.char_measures(pairs_of_texts(spark, d), "guess", "truth", mode="faithful")
    return alignment.with_ratios(measured).drop("guess", "truth")


@query()
def ag18_micro_average(spark, d):
    return alignment.micro_average(alignment.char_measures(pairs_of_texts(spark, d), "guess", "truth"))


@query()
def ag27_confusions(spark, d):
    return alignment.confusions(pairs_of_texts(spark, d), "guess", "truth").orderBy(F.desc("n"), "truth", "guess").limit(20)


# C6: retrieval -------------------------------------------------------------------------------------------------------


@query(
    """SELECT query_id, item_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS item_id, list_sum(list_transform(range(1, len(e.embedding) + 1), lambda k: (q.embedding[k]::DOUBLE - e.embedding[k]::DOUBLE) ** 2)) AS distance
    FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id)) WHERE rank <= 5""",
    model=False,
)
def jn24_nearest(spark, d):
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return retrieval.nearest(items.filter("id % 100 = 0"), items, 5, same="label").withColumn("distance", F.round("distance", 6))


@query(
    """SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda k: a.embedding[k]::DOUBLE * b.embedding[k]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE ** 2))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE ** 2)))), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    model=False,
)
def fn02_cosine(spark, d):
    a = table(spark, d, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(
    """SELECT user_id, image_id, id, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS pos FROM (
    SELECT i.user_id, r.image_id, max(r.id) AS id FROM r JOIN i ON i.id = r.image_id WHERE status = 'done' AND raw_text IS NOT NULL GROUP BY ALL)) WHERE pos <= 5"""
)
def rt01_recent(spark, d):
    return retrieval.recent(deeds.results(spark, d), deeds.images(spark, d), 5)


UNION = """, a AS (SELECT user_id, image_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS pos FROM (SELECT i.user_id, r.image_id, max(r.id) AS id FROM r JOIN i ON i.id = r.image_id WHERE status = 'done' AND raw_text IS NOT NULL GROUP BY ALL)),
    v AS (SELECT user_id, image_id, id, pos FROM (SELECT user_id, image_id, id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, id) AS pos FROM f WHERE value > 90000) WHERE pos <= 8),
    b AS (SELECT user_id, image_id, id, pos, 0 AS src FROM v UNION ALL SELECT a.user_id, a.image_id, a.id, a.pos, 1 FROM a WHERE pos <= CASE WHEN user_id IN (SELECT user_id FROM v) THEN 5 ELSE 20 END),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id, image_id ORDER BY src, pos) AS n FROM b)"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    deed = facts(spark, d).withColumn("value", text.price(F.col("price"))).filter("value > 90000")
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "id")
    first = deed.withColumn("pos", F.row_number().over(order)).filter("pos <= 8").select("user_id", "image_id", "id", "pos")
    return retrieval.ordered_union(first, retrieval.recent(deeds.results(spark, d), deeds.images(spark, d), 20), "user_id", "image_id")


@query(f"{UNION} SELECT user_id, image_id, id, src, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY src, pos) AS place FROM k WHERE n = 1) WHERE place <= 20")
def set01_ordered_union(spark, d):
    return _merged(spark, d).select("user_id", "image_id", "id", "src", "place")


@query()
def rt02_context(spark, d):
    deed = facts(spark, d).withColumnRenamed("id", "structured_id").select((F.col("structured_id") - 5).alias("id"), "location", "seller", "buyer", "price", "subject")
    items = _merged(spark, d).withColumn("id", F.when(F.col("src") == 0, F.col("id") - 5).otherwise(F.col("id")))
    rows = items.join(deeds.results(spark, d).select("id", F.col("raw_text").alias("text")), "id").join(deed, "id", "left")
    return retrieval.packed(rows, "user_id", [("location", "地点"), ("seller", "卖方"), ("buyer", "买方"), ("price", "价格"), ("subject", "标的")])


@query("SELECT conv_id, turn, role, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6 AND role IN ('user', 'assistant') AND coalesce(text, '') <> ''", model=False)
def wn05_history(spark, d):
    return retrieval.history(table(spark, d, "conversations"), "conv_id", F.desc("turn")).select("conv_id", "turn", "role", "back")


# Events --------------------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type", model=False)
def sm01_event_totals(spark, d):
    rows = tasks.drained(tasks.landing(spark, d, "events.parquet"), "events")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT * FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)", model=False)
def sm02_windows(spark, d):
    """The batch form of the windowed stream: the same plan, all windows final."""
    return tasks.windowed(table(spark, d, "events"))


@query()
def sm03_expiring_keys(spark, d):
    return tasks.drained(tasks.expiring(tasks.landing(spark, d, "events.parquet"), "user_id"), "expiring")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events", model=False)
def sm04_rate_limit(spark, d):
    return tasks.rate_limited(table(spark, d, "events"), "user_id", most=2).select("event_id", "user_id", "allowed")


@query(
    """SELECT id, CASE WHEN won = 1 THEN 'done' WHEN lost >= 3 THEN 'failed' WHEN won IS NOT NULL THEN 'pending' ELSE 'processing' END AS status, coalesce(lost, 0)::INTEGER AS tries
    FROM (SELECT c_custkey AS id FROM customer) LEFT JOIN (SELECT user_id, max((event_type <> 'error' AND value > 60)::INTEGER) AS won, sum((event_type = 'error' OR value <= 60)::INTEGER) AS lost FROM events GROUP BY user_id) ON user_id = id""",
    model=False,
)
def sm05_status_machine(spark, d):
    waiting = deeds.users(spark, d).select("id", F.lit("processing").alias("status"), F.lit(0).alias("tries"))
    outcomes = table(spark, d, "events").select(F.col("user_id").alias("id"), ((F.col("event_type") != "error") & (F.col("value") > 60)).alias("ok"))
    return tasks.advanced(waiting, outcomes)


@query()
def sm06_in_flight_once(spark, d):
    return tasks.drained(tasks.in_flight_once(tasks.landing(spark, d, "events.parquet"), ["user_id", "event_type"]), "in-flight")


# Proofreading and the rest of the store -------------------------------------------------------------------------------


@query("SELECT id, CASE WHEN coalesce(corrected_text, '') <> '' THEN corrected_text WHEN human_corrected AND coalesce(raw_text, '') <> '' AND raw_text <> 'original' THEN raw_text END AS correction FROM r")
def prj09_legacy_correction(spark, d):
    rows = deeds.results(spark, d).withColumn("original_raw_text", F.lit("original"))
    return rows.select("id", proofread.legacy_correction(rows).alias("correction"))


@query(f"{SEGMENTS} SELECT page, seg, CASE WHEN seg % 5 = 0 THEN 'rejected' WHEN text = '□' OR seg % 5 = 1 THEN 'uncertain' WHEN seg % 5 = 2 THEN 'partial' ELSE 'accepted' END AS tone FROM s", model=False)
def prj20_tone(spark, d):
    status = F.when(F.col("seg") % 5 == 0, "rejected").when(F.col("seg") % 5 == 1, "uncertain").when(F.col("seg") % 5 == 2, "partial").otherwise("accepted")
    return segments(spark, d).select("page", "seg", proofread.tone(status, F.col("text")).alias("tone"))


ODD_TEXT = "CASE (page + seg) % 8 WHEN 0 THEN '立契' WHEN 1 THEN 'A立契' WHEN 2 THEN '12' WHEN 3 THEN '123456' WHEN 4 THEN '□□立' WHEN 5 THEN ' ' WHEN 6 THEN '立 □' ELSE '，。立' END"


@query(
    f"""{SEGMENTS} SELECT page, seg, t <> '' AND NOT regexp_matches(t, '[A-Za-z]') AND NOT (regexp_full_match(t, '[0-9]{{1,5}}') AND (x1 < 80 OR x2 > 920)) AND len(regexp_replace(t, '[^0-9一-鿿]', '', 'g')) / greatest(len(t), 1) >= 0.5 AS usable
    FROM (SELECT *, regexp_replace({ODD_TEXT}, '\\s', '', 'g') AS t FROM s)""",
    model=False,
)
def prj14_usable_text(spark, d):
    return segments(spark, d).select("page", "seg", text.usable(F.expr(ODD_TEXT), F.col("x1"), F.col("x2"), F.lit(1000)).alias("usable"))


@query(f"{SEGMENTS} SELECT page, seg, length(t) AS chars, length(t) - length(replace(t, '□', '')) AS placeholders, round((length(t) - length(replace(t, '□', ''))) / greatest(length(t), 1), 4) AS placeholder_rate, length(replace(t, '□', '')) > 0 AS visible, regexp_full_match(o, '[0-9一-鿿]') AS single FROM (SELECT *, {ODD_TEXT} AS o, regexp_replace({ODD_TEXT}, '\\s', '', 'g') AS t FROM s)", model=False)
def prj22_visible_chars(spark, d):
    rows = proofread.char_shares(segments(spark, d).withColumn("odd", F.expr(ODD_TEXT)), "odd")
    return rows.select("page", "seg", "chars", "placeholders", "placeholder_rate", "visible", text.single_visible(F.col("odd")).alias("single"))


FUSED = "left(coalesce(text, ''), CAST(doc_id % 9 * 100 AS INT)) || CASE WHEN doc_id % 4 = 0 THEN '今因移就三面言定親手領訖任從買主陰陽兩便百為無阻' ELSE '' END"
_BARE = "regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]', '', 'g')"


@query(
    f"""SELECT doc_id, CASE WHEN too_long OR invented OR (density >= 5 AND c < 0.75) THEN 'trusted' WHEN n > 0 AND c < 0.45 THEN 'agreed' ELSE 'fused' END AS outcome,
    too_long::INTEGER + invented::INTEGER + (density >= 5 AND c < 0.75)::INTEGER AS hard FROM (
    SELECT doc_id, c, n, n > 588 AS too_long, CASE WHEN n = 0 THEN false ELSE greatest(n - k, 0) / n > 0.12 END AS invented,
      CASE WHEN n = 0 THEN 0 ELSE CASE WHEN doc_id % 4 = 0 THEN 6 ELSE 0 END / greatest(n / 120, 1) END AS density FROM (
    SELECT doc_id, doc_id % 10 / 10 AS c, length({_BARE.format(FUSED)}) AS n, length({_BARE.format("left(coalesce(text, ''), CAST(doc_id % 9 * 95 AS INT))")}) AS k FROM documents))""",
    model=False,
)
def prj16_invented_text(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr(FUSED).alias("fused"), F.expr("left(coalesce(text, ''), CAST(doc_id % 9 * 95 AS INT))").alias("trusted"), (F.col("doc_id") % 10 / 10).alias("c"))
    _, reasons = text.filtered_text(F.col("fused"), F.col("trusted"), F.col("c"), F.lit("agreed"))
    low = F.exists(reasons, lambda r: r.startswith("hard_reject:low_model_agreement"))
    return rows.select("doc_id", F.when(low, "agreed").when(F.size(reasons) > 0, "trusted").otherwise("fused").alias("outcome"), F.when(low, 0).otherwise(F.size(reasons)).alias("hard"))


@query("SELECT id, status FROM r WHERE image_id IN (3, 5, 8, 13) AND status <> 'failed'")
def prj03_in_list(spark, d):
    return deeds.results(spark, d).filter(F.col("image_id").isin(3, 5, 8, 13) & (F.col("status") != "failed")).select("id", "status")


@query("SELECT a.c_custkey AS id, count(*) AS same_nation FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey GROUP BY 1", model=False)
def prj04_others_alike(spark, d):
    users = deeds.users(spark, d)
    counts = users.groupBy("nation").agg((F.count("*") - 1).alias("same_nation"))
    return users.join(counts, "nation").filter("same_nation > 0").select("id", "same_nation")


@query("SELECT event_id, task, f.id AS structured_id, f.ocr_result_id, r.image_id, r.confidence FROM (SELECT event_id, user_id % 97 AS task, event_id % 5000 * 10 + event_id % 7 + 6 AS sid FROM events) e JOIN f ON f.id = e.sid JOIN r ON r.id = f.ocr_result_id")
def jn04_bridge(spark, d):
    bridge = table(spark, d, "events").select(F.col("event_id"), (F.col("user_id") % 97).alias("task"), (F.col("event_id") % 5000 * 10 + F.col("event_id") % 7 + 6).alias("structured_id"))
    keyed = bridge.withColumn("task", F.struct("event_id", "task"))
    return relational.bridged(keyed, deeds.contents(spark, d), deeds.results(spark, d), "task").select("task.event_id", "task.task", "structured_id", "ocr_result_id", "image_id", "confidence")


@query(
    f"""{SEGMENTS}, p AS (SELECT page, text, score, row_number() OVER (PARTITION BY page ORDER BY seg) - 1 AS pos FROM s)
    SELECT m.page, m.pos::INTEGER AS pos, m.text AS medium_text, coalesce(t.text, '') AS small_text, coalesce(t.score, 0) AS small_score FROM p m LEFT JOIN (SELECT * FROM p WHERE pos < 2) t ON m.page = t.page AND m.pos = t.pos""",
    model=False,
)
def jn14_positional_join(spark, d):
    lines = segments(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("page").orderBy("seg")) - 1).select("page", "pos", "text", "score")
    return layout.paired(lines, lines.filter("pos < 2"), "page").select("page", "pos", "medium_text", "small_text", "small_score")


@query(f"{SEGMENTS} SELECT page, seg, CASE WHEN seg % 3 = 0 THEN 'edited ' || seg ELSE text END AS text FROM s", model=False)
def jn25_overlay(spark, d):
    rows = segments(spark, d).select("page", "seg", "text")
    edits = rows.filter("seg % 3 = 0").withColumn("text", F.concat(F.lit("edited "), "seg"))
    return proofread.overlaid(rows, edits, ["page", "seg"]).select("page", "seg", "text")


@query(f"{SEGMENTS} SELECT page, string_agg(text, chr(10) ORDER BY seg) AS text FROM s GROUP BY page", model=False)
def pr01_composed_text(spark, d):
    return proofread.composed(segments(spark, d), "page", "seg")


@query(f"{SEGMENTS} SELECT page, seg, round(x1 / 10.0, 6) AS \"left\", round(y1 / 9.0, 6) AS top, round((x2 - x1) / 10.0, 6) AS width, round((y2 - y1) / 9.0, 6) AS height FROM s", model=False)
def pr02_boxes_in_percent(spark, d):
    rows = proofread.in_percent(segments(spark, d), F.lit(1000), F.lit(900))
    return rows.select("page", "seg", *[F.round(c, 6).alias(c) for c in ("left", "top", "width", "height")])


@query(
    f"""{SEGMENTS}, v AS (SELECT page, text AS c, count(*) AS n, sum(sc::DECIMAL(8, 2)) AS total, min(sc) AS score FROM (SELECT page, text, score AS sc, seg FROM s) WHERE seg = 1 OR sc >= 0.95 GROUP BY page, text)
    SELECT p.page, coalesce(b.c, '□') AS char, coalesce(round(b.score, 4), 0) AS score FROM (SELECT DISTINCT page FROM s) p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, total DESC, c DESC) AS k FROM v WHERE n >= 2) b ON b.page = p.page AND b.k = 1""",
    model=False,
)
def ag23_char_vote(spark, d):
    slots = segments(spark, d).select("page", F.when(F.col("seg") == 1, "medium").otherwise("other").alias("source"), F.col("text").alias("char"), F.col("score").cast("decimal(8,2)").alias("score"))
    return layout.voted_chars(slots, ["page"], least=0.95).withColumn("score", F.col("score").cast("double"))


@query()
def ag26_error_kinds(spark, d):
    said = alignment.confusions(pairs_of_texts(spark, d), "guess", "truth")
    return said.groupBy(proofread.error_kind(F.col("truth"), F.col("guess")).alias("kind")).agg(F.sum("n").alias("n"))


@query("SELECT count(*) AS scanned, count(*) FILTER (status = 'done') AS repaired, count(*) FILTER (status = 'processing') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM r")
def ag28_run_counters(spark, d):
    outcome = F.when(F.col("status") == "done", "repaired").when(F.col("status") == "processing", "skipped").otherwise("failed")
    return proofread.run_counters(deeds.results(spark, d).select(outcome.alias("outcome")))


@query("SELECT page_id, length(t) AS chars, length(t) - length(replace(t, '□', '')) AS placeholders, round((length(t) - length(replace(t, '□', ''))) / greatest(length(t), 1), 4) AS placeholder_rate, length(replace(t, '□', '')) > 0 AS visible FROM (SELECT page_id, regexp_replace(replace(html, 'e', '□'), '[ \\t\\n\\x0B\\f\\r]', '', 'g') AS t FROM pages)", model=False)
def ag30_char_shares(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.replace("html", F.lit("e"), F.lit("□")).alias("html"))
    return proofread.char_shares(rows, "html").drop("html")


@query("SELECT id, image_id, coalesce(lag(id) OVER w IS NULL OR lag(created_at) OVER w <> created_at, true) AS refreshed FROM r WINDOW w AS (PARTITION BY image_id ORDER BY id)")
def wn09_refreshed(spark, d):
    return proofread.refreshed(deeds.results(spark, d), "image_id").select("id", "image_id", "refreshed")


@query("(SELECT 'first' AS side, id, value FROM f WHERE value IS NOT NULL ORDER BY value DESC, id LIMIT 10) UNION ALL (SELECT 'last', id, value FROM f WHERE value IS NOT NULL ORDER BY value, id LIMIT 10)")
def st08_best_and_worst(spark, d):
    rows = facts(spark, d).select("id", text.price(F.col("price")).alias("value")).dropna()
    side = lambda name, order: rows.orderBy(order, "id").limit(10).select(F.lit(name).alias("side"), "id", "value")
    return side("first", F.desc("value")).unionByName(side("last", F.asc("value")))


@query("SELECT c_custkey AS id, len(list_intersect(list_distinct(string_split(c_name, '')), list_distinct(string_split(c_mktsegment, '')))) AS both, len(list_distinct(list_concat(string_split(c_name, ''), string_split(c_mktsegment, '')))) AS either FROM customer", model=False)
def set02_char_sets(spark, d):
    a, b = F.split("c_name", ""), F.split("c_mktsegment", "")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.size(F.array_intersect(a, b)).cast("long").alias("both"), F.size(F.array_union(a, b)).cast("long").alias("either"))


@query("SELECT id, place, year, value FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY value DESC, id) AS k FROM f WHERE place <> '' AND value IS NOT NULL) WHERE k <= 3")
def st03_top_three_per_place(spark, d):
    place = text.normal_place(text.present(F.col("location"), text.EMPTY_ANALYSIS))
    rows = facts(spark, d).select("id", place.alias("place"), "year", text.price(F.col("price")).alias("value")).filter("place <> '' and value is not null")
    return relational.top_per(rows, "place", [F.desc("value"), F.asc("id")], 3).select("id", "place", "year", "value")
