"""Queries over events, orders and labels as traces, claims, feeds and feedback."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import taxonomy, traces
from graphloom.operators.graph import use_checkpoints
from graphloom.sources.bindings import spans, table
from graphloom.streaming import feed


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each user's events and whether any is an error."""
    return traces.run_totals(spans(spark, sf_dir))


def cost_by_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.cost_rollup(spans(spark, sf_dir), "medium")


def routed_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = spark.createDataFrame([("click", "small"), ("view", "small"), ("purchase", "large")], "stage string, tier string")
    return traces.routed_and_flat(spans(spark, sf_dir), routes)


def budget_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come after their user spent 500 tokens."""
    return traces.budget_audit(spans(spark, sf_dir), 500).filter("blocked").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min("spent").alias("first_spent"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans of an agent: clicks search, views fetch, purchases are subtopics, errors write."""
    names = F.create_map(*map(F.lit, ("click", "tool:search_papers", "view", "tool:fetch_paper", "purchase", "worker", "error", "synthesize")))
    s = spans(spark, sf_dir)
    status = F.when(F.col("seq") % 3 == 0, "empty").otherwise("ok")
    start = F.col("seq").cast("double")
    return s.withColumn("name", F.coalesce(names[F.col("name")], "name")).withColumn("status", status).withColumn("start", start).withColumn("end", start + 0.5).withColumn("input", F.format_string('{"subgoal": "goal %d"}', F.col("seq")))


def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.summary_lines(_named(spark, sf_dir))


def plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.plan_view(_named(spark, sf_dir)).select("run_id", F.md5(F.array_join("lines", "\n")).alias("md5"))


def waterfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.waterfall(_named(spark, sf_dir)).groupBy("run_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "line"))), lambda x: x["line"]), "\n")).alias("md5"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces.tool_spans(_named(spark, sf_dir))
    return t.groupBy("name", "ms").agg(F.count(F.lit(1)).alias("n"))


def feedback_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as verdicts on the events' runs, appended as spans."""
    lb = table(spark, sf_dir, "labels")
    verdicts = lb.select((F.col("doc_id") % 50).alias("run_id"), F.col("doc_id").cast("string").alias("item"), F.when(F.col("quality") == 1, "kept").otherwise("deleted").alias("verdict"))
    fed = traces.with_feedback(_named(spark, sf_dir), verdicts)
    return fed.groupBy("run_id").agg(F.count_if(F.col("name").startswith("feedback:")).alias("n"), F.count_if(F.col("output") == "kept").alias("kept"), F.max("seq").alias("last"))


def _order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: a search that lists the parts of unreturned lines (none for every seventh order), and a saved text that cites
    the parts of all lines, or says that there are no sources; some save nothing, some outside, some malformed."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_partkey").cast("string")))).alias("seen"), F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("all")
    )
    k = F.col("k")
    listed = F.to_json(F.struct(F.transform("seen", lambda x: F.struct(x.alias("id"))).alias("papers")))
    cites = F.array_join(F.transform("all", lambda x: F.concat(F.lit("[S2:"), x, F.when(k % 13 == 0, "-").otherwise(""), F.lit("]"))), " ")
    text = F.when(k % 7 == 0, F.when(k % 2 == 0, "No sources, omitted").otherwise("A fine section")).otherwise(cites)
    file = F.when(k % 11 == 0, "../n.md").otherwise("n.md")
    span = lambda seq, name, inp, out: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(name).alias("name"), F.lit("ok").alias("status"), inp.alias("input"), out.alias("output"))
    none = F.lit(None).cast("string")
    parts = F.array(span(1, "tool:search_papers", none, F.when(k % 7 == 0, '{"hits": 0}').otherwise(listed)), span(2, "tool:save_to_file", F.to_json(F.struct(text.alias("content"), file.alias("filename"))), none))
    return li.select(k.alias("run_id"), F.explode(F.when(k % 17 == 0, F.slice(parts, 1, 1)).otherwise(parts)).alias("s")).select("run_id", "s.*")


def _run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of :func:`_order_runs`, one for every order with a line."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id")).distinct()


def graded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs through all grades; every order should have found its least part."""
    s = _order_runs(spark, sf_dir)
    gold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.min("l_partkey").cast("string").alias("id")).filter("run_id % 5 = 0")
    return traces.grade_runs(_run_ids(spark, sf_dir), s, gold).groupBy("passed", "reason").agg(F.count(F.lit(1)).alias("n"))


def replayed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh order is frozen as a case that must abstain, every third as one that must pass."""
    s = _order_runs(spark, sf_dir)
    runs = _run_ids(spark, sf_dir)
    cases = runs.filter("run_id % 7 = 0").select(F.lit("abstains").alias("case"), "run_id", F.lit("abstain").alias("kind")).unionByName(runs.filter("run_id % 3 = 0").select(F.lit("passes").alias("case"), "run_id", F.lit("full").alias("kind")))
    return traces.replay_cases(cases, runs, s).groupBy("case").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"))


def seen_and_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _order_runs(spark, sf_dir)
    seen, cited = traces.seen_ids(s), traces.cited_ids(traces.saved_content(s))
    return seen.groupBy("run_id").agg(F.count(F.lit(1)).alias("seen")).join(cited.groupBy("run_id").agg(F.count(F.lit(1)).alias("cited")), "run_id", "full").select("run_id", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("cited", F.lit(0)).alias("cited"))


def year_spec_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order years as specs with their expected bounds; those of March are wrong on purpose."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    y = F.col("y").cast("string")
    spec = F.when(F.col("m") % 4 == 0, y).when(F.col("m") % 4 == 1, F.concat(F.lit("before "), y)).when(F.col("m") % 4 == 2, F.concat(y, F.lit("-"), (F.col("y") + 2).cast("string")))
    low, high = F.when(F.col("m") % 4 == 1, 1900).when(F.col("m") % 4 != 3, F.col("y")), F.when(F.col("m") % 4 == 2, F.col("y") + 2).when(F.col("m") % 4 != 3, F.col("y"))
    cases = o.select(F.col("m").cast("string").alias("name"), spec.alias("spec"), F.when(F.col("m") == 3, 1).otherwise(low).alias("low"), high.alias("high"))
    return traces.parser_regression(cases).groupBy("name", "passed").agg(F.count(F.lit(1)).alias("n"))


def reply_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties read as tool outputs: error, empty or ok."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    out = F.when(k % 10 == 0, F.lit('{"error": "x"}')).when(k % 10 == 1, F.lit('{"hits": 0}')).when(k % 10 == 2, F.lit(" ")).when(k % 10 == 3, F.lit('{"papers": []}')).otherwise(F.col("props"))
    return e.select("event_type", traces.span_status(out).alias("status")).groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"))


def citation_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: parts of all lines are cited, parts of lines not returned were seen."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").cast("string").alias("id"), "l_returnflag", F.col("l_linenumber").alias("n"))
    contents = li.groupBy("run_id").agg(F.concat(F.lit("text "), F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda x: F.concat(F.lit("[S2:"), x, F.lit("]"))), " ")).alias("content"))
    bad = traces.invented(traces.cited_ids(contents), li.filter("l_returnflag <> 'R'").select("run_id", "id").distinct())
    graded = contents.join(bad.groupBy("run_id").agg(F.count(F.lit(1)).alias("invented")), "run_id", "left")
    return graded.select("run_id", traces.well_formed(F.col("content")).alias("well_formed"), F.coalesce("invented", F.lit(0)).alias("invented"))


def claim_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that a supplier ships a part: stated, resolved, asked or abstained."""
    li = table(spark, sf_dir, "lineitem")
    edges = li.filter("l_returnflag = 'N'").select(F.col("l_suppkey").cast("string").alias("src"), F.lit("ships").alias("rel"), F.col("l_partkey").cast("string").alias("dst"))
    fetched = li.filter("l_returnflag = 'A'").select(F.col("l_suppkey").cast("string").alias("src"), F.lit("ships").alias("rel"), F.col("l_partkey").cast("string").alias("dst"))
    claims = table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).cast("string").alias("src"), F.lit("ships").alias("rel"), F.col("p_partkey").cast("string").alias("dst"), (F.col("p_size") > 40).alias("ambiguous"))
    return traces.claim_gate(claims, edges, fetched).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each user's most frequent event type."""
    samples = table(spark, sf_dir, "events").select(F.col("user_id").alias("question"), F.col("event_type").alias("sample"))
    return traces.self_consistency(samples).select("question", F.round("consistency", 6).alias("consistency"))


def write_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: saves outside the folder, overwritten files and irreversible tools."""
    e = table(spark, sf_dir, "events")
    tool = F.when(F.col("event_type") == "click", "save_file").when(F.col("event_type") == "purchase", "send_mail").otherwise(F.col("event_type"))
    name = F.when(F.col("event_id") % 50 == 0, F.lit("../x")).otherwise(F.concat(F.lit("out/"), (F.col("event_id") % 7).cast("string")))
    calls = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), tool.alias("tool"), name.alias("file"))
    return traces.write_audit(calls, ["send_mail"]).groupBy("tool", "verdict", "reason").agg(F.count(F.lit(1)).alias("n"))


def screening_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records: one for each name and brand, those that any row excludes by type or size are out."""
    why = F.when(F.col("p_type") == "ECONOMY", "type").when(F.col("p_size") > 45, "size")
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name")).alias("title"), F.col("p_brand").alias("doi"), why.alias("excluded_by"))
    flow = traces.screening(p)
    return flow.withColumn("by_reason", F.array_join(F.transform(F.map_entries("by_reason"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


def response_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    act = traces.response_policy(k % 2 == 0, k % 3 == 0, k % 5 != 0, k % 7 == 0)
    return o.groupBy(act.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def _items(orders: DataFrame, lines: DataFrame) -> DataFrame:
    refs = lines.groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))).alias("references"))
    return orders.join(refs, F.col("o_orderkey") == F.col("o")).select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"), F.array("o_orderpriority").alias("topics"), "references"
    )


def _feed_edges(lines: DataFrame) -> DataFrame:
    return lines.filter("l_returnflag <> 'R'").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))


def feed_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders since 1997 as feed items: drafted, verified against kept lines, routed; a stream read to its end.

    The items go through ``run_feed`` as a file stream in the shared folder, the routes are read from its sink."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    use_checkpoints(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/feed-{uuid.uuid4().hex}"
    items = _items(o, li)
    items.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(items.schema).parquet(f"{base}/in")
    feed.run_feed(stream, _feed_edges(li), ["1-URGENT"], 1997, f"{base}/out", f"{base}/seen", f"{base}/cp", "2024-01-01").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("flags")).alias("flags"))


def feed_in_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders come in three passes of which the second and third hold earlier ones again: items routed by each pass.

    Pass k brings the orders whose key leaves k and k - 1 by 3, so each order but those of the first and last remainder comes twice; the
    stream is started anew for each pass and goes on from its checkpoint."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    use_checkpoints(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/feed-{uuid.uuid4().hex}"
    items = _items(o, li)
    rest = F.col("id").substr(F.lit(2), F.length("id")).cast("long") % 3
    for k in range(3):
        items.filter((rest == k) | (rest == k - 1)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(items.schema).parquet(f"{base}/in")
        feed.run_feed(stream, _feed_edges(li), ["1-URGENT"], 1992, f"{base}/out", f"{base}/seen", f"{base}/cp", "2024-01-01").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy(F.col("batch").cast("int").alias("batch"), "route").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("flags")).alias("flags"))


def reading_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sensors, their events as readings, in two passes by time: every state that the stream emits, in either pass.

    A user without an event for six hours before the watermark is stale, its state goes, and it starts anew with a later event."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sensor"), F.col("ts").cast("timestamp").alias("ts"), "value")
    use_checkpoints(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/readings-{uuid.uuid4().hex}"
    ends = e.agg((F.min(F.unix_micros("ts")) + F.expr("(max(unix_micros(ts)) - min(unix_micros(ts))) div 2")).alias("_half"))
    dated = e.join(F.broadcast(ends)).withColumn("late", F.unix_micros("ts") > F.col("_half")).drop("_half")
    for late in (False, True):
        dated.filter(F.col("late") == late).drop("late").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("sensor string, ts timestamp, value double").parquet(f"{base}/in")
        states = feed.current_readings(stream, stale_minutes=360.0)
        states.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("sensor", F.unix_micros("last_ts").alias("last_us"), "last_value", "readings", "stale")


def triage_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as feedback on documents: sources with a deleted and no kept document."""
    lb, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    feedback = lb.select(F.col("doc_id").alias("item"), F.when(F.col("quality") == 1, "kept").otherwise("deleted").alias("verdict"), F.col("doc_id").alias("ts"))
    topic = F.concat_ws("-", "source", "lang", (F.col("doc_id") % 3).cast("string"))
    items = d.select(F.col("doc_id").alias("id"), F.array(topic).alias("topics"))
    return feed.tune_triage(feedback, items, items.select(F.explode("topics").alias("topic")))


def taxonomy_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as classes under region families: coined families by grounded children."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    families = n.groupBy(F.concat(F.lit("coined:"), F.col("n_regionkey").cast("string")).alias("parent")).agg(F.array_sort(F.collect_set(F.col("n_nationkey").cast("string"))).alias("children"))
    grounded = c.groupBy("c_nationkey").count().filter("count > 60").select(F.col("c_nationkey").cast("string").alias("id"))
    return taxonomy.coined_verdicts(families, grounded)


def family_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjointness among the nations of each region, by suppliers that connect them."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier").select(F.col("s_nationkey")).distinct(), F.col("n_nationkey") == F.col("s_nationkey"))
    families = n.groupBy(F.col("n_regionkey").alias("parent")).agg(F.array_sort(F.collect_set("n_nationkey")).alias("children"))
    return taxonomy.family_disjointness(families)


QUERIES = {f.__name__: f for f in (
    run_totals, cost_by_span, routed_costs, budget_blocks, summary_lines, plan_lines, waterfalls, tool_calls, feedback_spans, graded_runs, replayed_cases, seen_and_cited, year_spec_cases, reply_states, citation_grades, claim_actions, consistency, write_checks, screening_flow, response_policies, feed_routes, feed_in_passes, reading_states, triage_topics,
    taxonomy_review, family_axioms,
)}

_S = "s AS (SELECT user_id AS run_id, event_id AS seq, event_type AS name, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, floor(value)::BIGINT AS tokens FROM events)"
_N = "n AS (SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'tool:search_papers' WHEN 'view' THEN 'tool:fetch_paper' WHEN 'purchase' THEN 'worker' WHEN 'error' THEN 'synthesize' ELSE event_type END AS name, CASE WHEN event_id % 3 = 0 THEN 'empty' ELSE 'ok' END AS status FROM events)"
_R = "p AS (SELECT l_orderkey AS k, l_partkey AS id, bool_or(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1, 2), r AS (SELECT k, count(*) AS alls, count(*) FILTER (NOT ok) AS lost, arg_min(ok, id) AS first_seen FROM p GROUP BY 1)"
ORACLE_SQL = {
    "run_totals": f"WITH {_S} SELECT run_id, sum(tokens)::BIGINT AS tokens, bool_or(status = 'error') AS has_anomaly FROM s GROUP BY 1",
    "cost_by_span": f"WITH {_S} SELECT run_id, name, sum(tokens)::BIGINT AS tokens, round_even(sum(tokens) / 1000.0::DOUBLE * 0.004::DOUBLE, 4) AS usd FROM s GROUP BY GROUPING SETS ((run_id, name), (run_id))",
    "routed_costs": f"WITH {_S} SELECT run_id, round(sum(tokens / 1000.0::DOUBLE * CASE name WHEN 'click' THEN 0.001::DOUBLE WHEN 'view' THEN 0.001::DOUBLE WHEN 'purchase' THEN 0.02::DOUBLE ELSE 0.004::DOUBLE END), 6) AS routed_usd, round(sum(tokens / 1000.0::DOUBLE * 0.02::DOUBLE), 6) AS flat_usd FROM s GROUP BY 1",
    "budget_blocks": f"WITH {_S}, b AS (SELECT run_id, coalesce(sum(tokens) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM s) SELECT run_id, count(*) AS n, min(spent) AS first_spent FROM b WHERE spent >= 500 GROUP BY 1",
    "summary_lines": f"WITH {_N} SELECT run_id, 'Surveying ' || CASE WHEN count(*) FILTER (name = 'worker') > 0 THEN count(*) FILTER (name = 'worker') ELSE count(*) FILTER (name = 'tool:search_papers') END || ' subtopics \u00b7 ' || count(*) FILTER (name = 'tool:fetch_paper') || ' papers retrieved \u00b7 ' || CASE WHEN bool_or(name = 'synthesize') THEN 'synthesizing now' ELSE 'gathering sources' END AS line FROM n GROUP BY 1",
    "plan_lines": f"WITH {_N} SELECT run_id, md5(coalesce(string_agg(CASE WHEN status = 'empty' THEN '  [!] goal ' || seq || ' 0 papers' ELSE '  [x] goal ' || seq END, chr(10) ORDER BY seq) FILTER (name = 'worker'), '  [ ] (no plan recorded)')) AS md5 FROM n GROUP BY 1",
    "waterfalls": f"WITH {_N} SELECT run_id, md5(string_agg('  ' || rpad(name, greatest(24, len(name))::INT, ' ') || ' ' || lpad('500', 6, ' ') || 'ms' || CASE WHEN status = 'ok' THEN '' ELSE '  <empty>' END, chr(10) ORDER BY seq)) AS md5 FROM n GROUP BY 1",
    "tool_calls": f"WITH {_N} SELECT name, 500::BIGINT AS ms, count(*) AS n FROM n WHERE name LIKE 'tool:%' GROUP BY 1",
    "feedback_spans": f"WITH {_N}, e AS (SELECT run_id, max(seq) AS last FROM n GROUP BY 1), v AS (SELECT doc_id % 50 AS run_id, count(*) AS c, count(*) FILTER (quality = 1) AS kept FROM labels GROUP BY 1) SELECT run_id, coalesce(c, 0)::BIGINT AS n, coalesce(kept, 0)::BIGINT AS kept, last + coalesce(c, 0) AS last FROM e LEFT JOIN v USING (run_id)",
    "graded_runs": f"""WITH {_R} SELECT reason IS NULL AS passed, reason, count(*) AS n FROM (SELECT CASE WHEN k % 17 = 0 OR k % 11 = 0 THEN 'no file saved to output/' WHEN k % 7 <> 0 AND k % 13 = 0 THEN 'malformed citation' WHEN k % 7 <> 0 AND lost > 0 THEN 'invented citation'
 WHEN k % 7 = 0 AND k % 2 = 1 THEN 'improvised a section with zero sources' WHEN k % 5 = 0 AND (k % 7 = 0 OR NOT first_seen) THEN 'missed required papers' END AS reason FROM r) GROUP BY ALL""",
    "replayed_cases": f"""WITH {_R} SELECT 'abstains' AS "case", count(*) AS n, count(*) FILTER (k % 17 <> 0 AND k % 2 = 0) AS passed FROM r WHERE k % 7 = 0 UNION ALL
SELECT 'passes', count(*), count(*) FILTER (k % 17 <> 0 AND k % 11 <> 0 AND (k % 7 = 0 AND k % 2 = 0 OR k % 7 <> 0 AND k % 13 <> 0 AND lost = 0)) FROM r WHERE k % 3 = 0""",
    "seen_and_cited": f"WITH {_R} SELECT k AS run_id, s AS seen, c AS cited FROM (SELECT k, CASE WHEN k % 7 = 0 THEN 0 ELSE alls - lost END AS s, CASE WHEN k % 17 = 0 OR k % 7 = 0 OR k % 13 = 0 THEN 0 ELSE alls END AS c FROM r) WHERE s > 0 OR c > 0",
    "year_spec_cases": "SELECT month(o_orderdate)::VARCHAR AS name, month(o_orderdate) <> 3 AS passed, count(*) AS n FROM orders GROUP BY ALL",
    "reply_states": "SELECT event_type, CASE ((props->>'$.k')::INT % 10) WHEN 0 THEN 'error' WHEN 1 THEN 'empty' WHEN 2 THEN 'empty' WHEN 3 THEN 'empty' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY ALL",
    "citation_grades": "WITH p AS (SELECT l_orderkey AS run_id, l_partkey, bool_or(l_returnflag <> 'R') AS seen FROM lineitem GROUP BY 1, 2) SELECT run_id, true AS well_formed, count(*) FILTER (NOT seen) AS invented FROM p GROUP BY 1",
    "claim_actions": """WITH l AS (SELECT l_suppkey AS s, l_partkey AS p, bool_or(l_returnflag = 'N') AS n, bool_or(l_returnflag = 'A') AS a FROM lineitem GROUP BY 1, 2)
SELECT CASE WHEN n THEN 'state' WHEN a THEN 'resolve' WHEN p_size > 40 THEN 'ask' ELSE 'abstain' END AS action, count(*) AS n FROM part LEFT JOIN l ON s = p_partkey % 100 AND p = p_partkey GROUP BY 1""",
    "consistency": "SELECT user_id AS question, round(max(n)::DOUBLE / sum(n), 6) AS consistency FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1",
    "write_checks": """WITH c AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'save_file' WHEN 'purchase' THEN 'send_mail' ELSE event_type END AS tool, CASE WHEN event_id % 50 = 0 THEN '../x' ELSE 'out/' || event_id % 7 END AS f FROM events),
r AS (SELECT tool, CASE WHEN tool = 'save_file' AND f = '../x' THEN 'path_escape' WHEN tool = 'save_file' AND lag(event_id) OVER (PARTITION BY user_id, tool, f ORDER BY event_id) IS NOT NULL THEN 'overwrite' WHEN tool = 'send_mail' THEN 'irreversible' END AS reason FROM c)
SELECT tool, CASE WHEN reason IS NULL THEN 'allow' ELSE 'block' END AS verdict, reason, count(*) AS n FROM r GROUP BY ALL""",
    "screening_flow": """WITH u AS (SELECT p_name, p_brand, min(CASE WHEN p_type = 'ECONOMY' THEN 'type' WHEN p_size > 45 THEN 'size' END) AS x FROM part GROUP BY 1, 2), b AS (SELECT string_agg(x || '=' || n, ',' ORDER BY x) AS by_reason FROM (SELECT x, count(*) AS n FROM u WHERE x IS NOT NULL GROUP BY 1))
SELECT (SELECT count(*) FROM part) AS identified, count(*) AS screened, count(x) AS excluded, count(*) - count(x) AS included, any_value(by_reason) AS by_reason FROM u, b""",
    "response_policies": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'resolve' ELSE 'ask' END WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN 'hedge' ELSE 'abstain' END AS action, count(*) AS n FROM orders GROUP BY 1",
    "feed_routes": """WITH p AS (SELECT l_orderkey AS o, l_partkey, bool_or(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1, 2), i AS (SELECT o, count(*) FILTER (NOT ok) AS f FROM p JOIN orders ON o_orderkey = o WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) >= 1997 GROUP BY 1)
SELECT CASE WHEN f = 0 THEN 'digest' ELSE 'inbox' END AS route, count(*) AS n, sum(f)::BIGINT AS flags FROM i GROUP BY 1""",
    "feed_in_passes": """WITH p AS (SELECT l_orderkey AS o, l_partkey, bool_or(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1, 2), i AS (SELECT o, count(*) FILTER (NOT ok) AS f FROM p JOIN orders ON o_orderkey = o WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) >= 1992 GROUP BY 1)
SELECT (o % 3)::INT AS batch, CASE WHEN f = 0 THEN 'digest' ELSE 'inbox' END AS route, count(*) AS n, sum(f)::BIGINT AS flags FROM i GROUP BY 1, 2""",
    "reading_states": """WITH e AS (SELECT user_id::VARCHAR AS sensor, epoch_us(ts) AS us, value FROM events), h AS (SELECT min(us) + (max(us) - min(us)) // 2 AS half FROM e),
g AS (SELECT sensor, us > half AS late, max({'us': us, 'v': value}) AS m, count(*) AS n FROM e, h GROUP BY 1, 2),
w AS (SELECT max(m.us) FILTER (NOT late) // 1000 - 300000 AS w1, max(m.us) // 1000 - 300000 AS w2 FROM g),
one AS (SELECT sensor, m, n, m.us // 1000 + 21600000 <= w1 AS gone FROM g, w WHERE NOT late),
two AS (SELECT g.sensor, g.m, g.n + CASE WHEN one.gone THEN 0 ELSE coalesce(one.n, 0) END AS n FROM g LEFT JOIN one USING (sensor) WHERE late),
held AS (SELECT * FROM two UNION ALL SELECT sensor, m, n FROM one WHERE NOT gone AND sensor NOT IN (SELECT sensor FROM two)),
every AS (SELECT sensor, m, n, false AS stale FROM one UNION ALL SELECT sensor, m, n, true FROM one WHERE gone UNION ALL SELECT sensor, m, n, false FROM two UNION ALL SELECT sensor, m, n, true FROM held, w WHERE m.us // 1000 + 21600000 <= w2)
SELECT sensor, m.us AS last_us, m.v AS last_value, n AS readings, stale FROM every""",
    "triage_topics": "SELECT source || '-' || lang || '-' || (doc_id % 3) AS topic FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING bool_or(quality = 0) AND NOT bool_or(quality = 1)",
    "taxonomy_review": "WITH g AS (SELECT c_nationkey AS k FROM customer GROUP BY 1 HAVING count(*) > 60), f AS (SELECT 'coined:' || n_regionkey AS parent, count(g.k) AS n FROM nation LEFT JOIN g ON g.k = n_nationkey GROUP BY 1) SELECT parent, n, CASE WHEN n >= 2 THEN 'accept' WHEN n = 1 THEN 'demote' ELSE 'reject' END AS verdict FROM f",
    "family_axioms": "WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)), z AS (SELECT r FROM n GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6) SELECT a.k AS a, b.k AS b FROM n a JOIN n b ON a.r = b.r AND a.k < b.k WHERE a.r IN (SELECT r FROM z)",
}
