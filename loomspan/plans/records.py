"""More queries of the catalogue: mutations of the store, tasks, sinks, and lists inside of analysis results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.operators import analysis, layout, proofread, relational
from loomspan.plans.catalogue import EDGES, MENTIONS, NOW, SEGMENTS, facts, query, segments
from loomspan.sources import deeds, files
from loomspan.sources.deeds import table

# Relational store ----------------------------------------------------------------------------------------------------


@query("SELECT id, upload_time, (SELECT count(*) FROM i) AS total FROM i ORDER BY upload_time DESC, id DESC LIMIT 10 OFFSET 30")
def st01_page_with_total(spark, d):
    return relational.page_with_total(deeds.images(spark, d), [F.desc("upload_time"), F.desc("id")], 30, 10).select("id", "upload_time", "total")


@query("SELECT a.c_custkey AS id, EXISTS (SELECT 1 FROM customer b WHERE b.c_name = w AND b.c_custkey <> a.c_custkey) AS taken FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'Customer#' || lpad((c_custkey + 1)::VARCHAR, 9, '0') ELSE 'new name' END AS w FROM customer) a", model=False)
def prj04_name_taken(spark, d):
    users = deeds.users(spark, d)
    wish = F.when(F.col("id") % 3 == 0, F.col("username")).when(F.col("id") % 3 == 1, F.concat(F.lit("Customer#"), F.lpad((F.col("id") + 1).cast("string"), 9, "0"))).otherwise("new name")
    return relational.taken(users, users.select("id", wish.alias("value")), "username").select("id", "taken")


@query("SELECT c_custkey * 20 + 2 AS id, c_custkey * 10 + 1 AS multi_task_id, c_custkey AS user_id FROM customer WHERE c_custkey % 3 > 0", model=False)
def jn05_graph_of_task(spark, d):
    tasks = deeds.users(spark, d).filter("id % 3 > 0").select((F.col("id") * 10 + 1).alias("id"), F.col("id").alias("user_id"))
    graphs = deeds.users(spark, d).select((F.col("id") * 20 + 2).alias("id"), (F.col("id") * 10 + 1).alias("multi_task_id"))
    return relational.with_tenant(graphs, tasks, "multi_task_id").select("id", "multi_task_id", "user_id")


@query("SELECT r.id, i.user_id, i.filename FROM (SELECT id, image_id + id % 2 * 1000000000 AS image_id FROM r) r LEFT JOIN i ON i.id = r.image_id")
def jn12_with_parent(spark, d):
    rows = deeds.results(spark, d).select("id", (F.col("image_id") + F.col("id") % 2 * 1000000000).alias("image_id"))
    return relational.with_parent(rows, deeds.images(spark, d), "image_id", ["user_id", "filename"]).select("id", "user_id", "filename")


@query("SELECT a.image_id, (a.k - 1)::INTEGER AS pos, a.id, b.price FROM (SELECT image_id, id, row_number() OVER (PARTITION BY image_id ORDER BY id) AS k FROM r) a JOIN (SELECT image_id, coalesce(price, '') AS price, row_number() OVER (PARTITION BY image_id ORDER BY id) AS k FROM f) b USING (image_id, k)")
def jn13_zipped(spark, d):
    ids = deeds.results(spark, d).groupBy("image_id").agg(F.sort_array(F.collect_list("id")).alias("id"))
    prices = facts(spark, d).groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("price", F.lit("")).alias("price")))), lambda x: x.price).alias("price"))
    return relational.zipped(ids.join(prices, "image_id"), ["image_id"], "id", "price")


@query(f"{MENTIONS} SELECT name, arg_max(id, id) AS id FROM m GROUP BY name")
def jn18_last_writer(spark, d):
    said = analysis.mentions(facts(spark, d))
    return relational.last_of(said, "name", "id", F.col("id"))


@query("SELECT k.key, min(r.id) AS id FROM (SELECT DISTINCT l_suppkey % 50 || '·' || l_linenumber AS key FROM r) k JOIN (SELECT id, image_id % 60 || '.' || l_linenumber AS prefix FROM r) r ON replace(k.key, '·', '.') = r.prefix GROUP BY k.key")
def jn23_first_match(spark, d):
    r = deeds.results(spark, d)
    named = r.select("id", F.concat(F.lit("Scan_"), F.col("image_id") % 60, F.lit("."), "l_linenumber", F.lit(".JPG")).alias("filename"))
    keys = r.select(F.concat_ws("·", F.col("l_suppkey") % 50, "l_linenumber").alias("key")).distinct()
    return files.first_match(named, keys)


OPEN = """, c AS (SELECT id, ocr_result_id FROM f WHERE id % 3 > 0), w AS (SELECT id AS ocr_result_id FROM r WHERE id % 4 = 0),
    l AS (SELECT max(id) AS id FROM c WHERE ocr_result_id IN (SELECT ocr_result_id FROM w) GROUP BY ocr_result_id)"""


@query(f"{OPEN} SELECT id, ocr_result_id, CASE WHEN id IN (SELECT id FROM l) THEN 'processing' ELSE 'done' END AS status, id IN (SELECT id FROM l) AS empty FROM c UNION ALL SELECT (SELECT max(id) FROM c) + ocr_result_id, ocr_result_id, 'processing', true FROM w WHERE ocr_result_id NOT IN (SELECT ocr_result_id FROM c)")
def set05_reopened(spark, d):
    current = deeds.contents(spark, d).filter("id % 3 > 0").select("id", "ocr_result_id", "content", "status", F.lit(NOW).alias("created_at"))
    wanted = deeds.results(spark, d).filter("id % 4 = 0").select(F.col("id").alias("ocr_result_id"))
    return relational.reopened(current, wanted, "ocr_result_id", NOW).select("id", "ocr_result_id", "status", (F.col("content") == "{}").alias("empty"))


@query("SELECT 9001::BIGINT AS multi_task_id, id AS structured_id FROM f WHERE user_id = 7")
def set08_task_links(spark, d):
    structured = deeds.contents(spark, d)
    _, links = relational.created_task(9001, 7, structured.filter("user_id = 7").select(F.col("id").alias("structured_id")), structured, NOW)
    return links.select("multi_task_id", "structured_id")


@query(
    """SELECT 'image' AS name, count(*) AS n FROM i WHERE user_id % 10 = 0 UNION ALL SELECT 'ocr_result', count(*) FROM r WHERE image_id IN (SELECT id FROM i WHERE user_id % 10 = 0)
    UNION ALL SELECT 'structured', count(*) FROM f WHERE user_id % 10 = 0"""
)
def ag29_deleted_counts(spark, d):
    chain = [("image", deeds.images(spark, d), "user_id"), ("ocr_result", deeds.results(spark, d), "image_id"), ("structured", deeds.contents(spark, d), "ocr_result_id")]
    return relational.cascade_counts(chain, deeds.users(spark, d).filter("id % 10 = 0").select("id"))


# Sinks and runs ------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, 'data: {"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS event FROM events""", model=False)
def src18_event_lines(spark, d):
    return files.event_lines(table(spark, d, "events"), ["event_id", "event_type"]).select("event_id", "event")


@query("""SELECT event_id, '{"time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","level":"' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || '","logger":"worker","message":"task","user_id":' || user_id || CASE WHEN event_type = 'error' THEN ',"reason":"failed"' ELSE '' END || '}' AS line FROM events""", model=False)
def src26_log_lines(spark, d):
    failed = F.col("event_type") == "error"
    rows = table(spark, d, "events").select("event_id", F.col("ts").alias("time"), F.when(failed, "ERROR").otherwise("INFO").alias("level"), "user_id", F.when(failed, "failed").alias("reason"))
    return files.log_lines(rows, "worker", "task", ["user_id", "reason"]).select("event_id", "line")


@query(
    """SELECT i.id AS image_id, o AS outcome, CASE WHEN o = 'repaired' THEN l.id END AS id, CASE WHEN o = 'repaired' THEN CASE WHEN i.id % 5 = 0 THEN '□' ELSE 'page ' || i.id END END AS raw_text,
    CASE WHEN o = 'repaired' THEN l.fix END AS corrected_text, CASE WHEN o = 'repaired' THEN l.fix IS NOT NULL END AS human_corrected FROM (
    SELECT i.id, l.id AS lid, CASE WHEN i.id % 11 = 0 OR l.id IS NULL THEN 'skipped' WHEN i.id % 7 = 0 THEN 'failed' ELSE 'repaired' END AS o
    FROM i LEFT JOIN (SELECT image_id, max(id) AS id FROM r WHERE status = 'done' GROUP BY image_id) l ON l.image_id = i.id) i LEFT JOIN (
    SELECT id, CASE WHEN coalesce(corrected_text, '') <> '' THEN corrected_text WHEN human_corrected AND coalesce(raw_text, '') <> '' THEN raw_text END AS fix FROM r) l ON l.id = i.lid"""
)
def src25_reprocessed(spark, d):
    images = deeds.images(spark, d).select("id", F.when(F.col("id") % 11 > 0, F.col("filename")).alias("path"))
    fresh = images.select(F.col("id").alias("image_id"), F.when(F.col("id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" page "), "id")).alias("text"), F.lit(0.9).alias("new_confidence"), (F.col("id") % 7 > 0).alias("ok"))
    results = deeds.results(spark, d).withColumn("original_raw_text", F.lit("original"))
    return proofread.reprocessed(images, results, fresh).drop("confidence")


# Lists inside of analysis results ------------------------------------------------------------------------------------


@query(f"{MENTIONS}, n AS (SELECT DISTINCT name, left(name, 1) AS surname FROM m) SELECT surname, name, k.n FROM n JOIN (SELECT surname, count(*) AS n FROM n GROUP BY surname HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 5) k USING (surname)")
def ag15_clan_members(spark, d):
    return analysis.clan_members(analysis.mentions(facts(spark, d)).select("name").distinct())


@query(f"{MENTIONS} SELECT name, list_sort(list(party)) AS parties FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY party) AS k FROM (SELECT DISTINCT w.name, p.name AS party FROM m w JOIN m p ON w.id = p.id WHERE w.role = 'middleman' AND p.role <> 'middleman')) WHERE k <= 10 GROUP BY name")
def ag16_counterparties(spark, d):
    return analysis.counterparties(analysis.mentions(facts(spark, d)))


@query(f"{EDGES} SELECT src, dst, relation, first_doc, n, CASE WHEN relation = 'Trade' THEN '出售' || CASE WHEN year IS NULL THEN '' ELSE '·' || year END || CASE WHEN price IS NULL THEN '' ELSE ' [' || price || ']' END ELSE '见证' END AS label FROM e JOIN f ON f.id = e.first_doc")
def ag17_edge_labels(spark, d):
    deed = facts(spark, d)
    return analysis.edge_labels(analysis.relation_edges(analysis.mentions(deed)), deed)


@query(
    f"""{MENTIONS}, x AS (SELECT a.id, a.name AS src, b.name AS dst, 0 AS kind FROM m a JOIN m b ON a.id = b.id AND a.role = 'seller' AND b.role = 'buyer'
    UNION ALL SELECT a.id, a.name, b.name, 1 FROM m a JOIN m b ON a.id = b.id AND a.role = 'middleman' AND b.role IN ('seller', 'buyer')),
    y AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY id, kind) AS k FROM x WHERE src <> dst)
    SELECT src, dst, (row_number() OVER (PARTITION BY src, dst ORDER BY id, kind) - 1)::INTEGER AS pos, id AS doc FROM y WHERE k = 1 OR kind = 0"""
)
def ag17_edge_docs(spark, d):
    return analysis.edge_docs(analysis.mentions(facts(spark, d)))


@query(
    """, p AS (SELECT * FROM f WHERE place IN (SELECT place FROM f WHERE place <> '' GROUP BY place HAVING count(*) >= 2))
    SELECT seller AS src, '[地块]' || place AS dst, '出让' AS kind, min(id) AS first_doc FROM p WHERE seller IS NOT NULL GROUP BY ALL UNION ALL SELECT '[地块]' || place, buyer, '受让', min(id) FROM p GROUP BY ALL"""
)
def ag17_land_edges(spark, d):
    return analysis.land_edges(facts(spark, d))


@query(
    f"""{MENTIONS}, ranks AS (SELECT 'people' AS part, name, count(DISTINCT id) AS n, 8 AS most FROM m GROUP BY name UNION ALL SELECT 'places', place, count(*), 8 FROM f WHERE place <> '' GROUP BY place
    UNION ALL SELECT 'plots', place, count(*), 6 FROM f WHERE place <> '' GROUP BY place HAVING count(*) >= 2 UNION ALL SELECT 'clans', left(name, 1), count(*), 5 FROM (SELECT DISTINCT name FROM m) GROUP BY 2 HAVING count(*) >= 2
    UNION ALL SELECT 'witnesses', name, count(*), 6 FROM m WHERE role = 'middleman' GROUP BY name)
    SELECT part, pos::INTEGER AS pos, name, n FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, name) AS pos FROM ranks) WHERE pos <= most"""
)
def st03_report_parts(spark, d):
    deed = facts(spark, d)
    return analysis.report(deed, analysis.mentions(deed))


# Recognised pages ----------------------------------------------------------------------------------------------------


@query(
    f"""{SEGMENTS}, v AS (SELECT page, text, count(DISTINCT view) AS views, count(*) AS n, sum(confidence::DECIMAL(6, 2)) AS total, min(confidence) AS c FROM s WHERE text <> '□' GROUP BY page, text),
    w AS (SELECT page, text, c FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY views DESC, n DESC, total DESC, text DESC) AS k FROM v) WHERE k = 1 AND views >= 2),
    t AS (SELECT page, max(CASE WHEN k = 1 THEN text END) AS t1, max(CASE WHEN k = 2 THEN text END) AS t2, min(confidence) FILTER (k <= 2) AS c2 FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY confidence DESC, seg) AS k FROM s WHERE text <> '□') GROUP BY page),
    b AS (SELECT page, text, confidence FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY confidence DESC, score DESC, (text <> '□')::INTEGER DESC, seg) AS n FROM s) WHERE n = 1)
    SELECT b.page, CASE WHEN w.page IS NOT NULL THEN w.text WHEN t1 = t2 THEN t1 WHEN b.confidence >= 0.75 THEN b.text ELSE '□' END AS text,
    CASE WHEN w.page IS NOT NULL OR coalesce(t1 = t2, false) OR b.confidence >= 0.75 THEN 'accepted' ELSE 'uncertain' END AS status,
    CASE WHEN w.page IS NOT NULL THEN round(w.c, 4) WHEN t1 = t2 THEN round(c2, 4) WHEN b.confidence >= 0.75 THEN round(b.confidence, 4) ELSE 0 END AS confidence
    FROM b LEFT JOIN w ON w.page = b.page LEFT JOIN t ON t.page = b.page""",
    model=False,
)
def ag24_consensus(spark, d):
    rows = segments(spark, d).withColumn("confidence", F.col("confidence").cast("decimal(6,2)"))
    return layout.consensus(rows, ["page"]).select("page", "text", "status", F.col("confidence").cast("double").alias("confidence"))


@query(
    f"""{SEGMENTS}, p AS (SELECT page, text || text AS text, score, row_number() OVER (PARTITION BY page ORDER BY seg) - 1 AS pos FROM s)
    SELECT m.page, m.pos::INTEGER AS pos, (coalesce(t.text, '') <> '' AND m.text <> t.text AND sure) OR coalesce(t.text, '') = '' OR NOT sure AS rescue
    FROM p m LEFT JOIN (SELECT * FROM p WHERE pos % 2 = 0) t ON m.page = t.page AND t.pos = m.pos - m.pos % 3, LATERAL (SELECT least(m.score, coalesce(t.score, 0)) >= 0.95 AS sure)""",
    model=False,
)
def prj21_rescue_lines(spark, d):
    rows = segments(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("page").orderBy("seg")) - 1).select("page", "pos", F.concat("text", "text").alias("text"), "score")
    other = rows.filter("pos % 2 = 0").withColumnsRenamed({"pos": "at", "text": "small_text", "score": "small_score"})
    both = rows.withColumnsRenamed({"text": "medium_text", "score": "medium_score"}).withColumn("at", F.col("pos") - F.col("pos") % 3).join(other, ["page", "at"], "left")
    return layout.rescue_candidates(both, least=0.95).select("page", "pos", "rescue")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1", model=False)
def prj24_first_seen(spark, d):
    return relational.first_seen(table(spark, d, "events"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).select("event_id", "user_id", "event_type")
