"""Trace analytics and grading over spans (run_id, seq, name, status, input, output, start, end, tokens)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import year_bounds
from graphloom.operators.sums import sum_before

#: Price per 1,000 tokens of the three tiers, and the tier of each stage.
PRICES = {"small": 0.001, "medium": 0.004, "large": 0.020}
CITATION = r"\[S2:([A-Za-z0-9]+)\]"


def is_empty(output: Column, status: Column) -> Column:
    """Null or blank, status empty, no hits or count, or an empty paper list."""
    get = lambda p: F.get_json_object(output, p)
    return output.isNull() | (F.trim(output) == "") | F.coalesce(status == "empty", F.lit(False)) | F.coalesce((get("$.hits") == "0") | (get("$.count") == "0"), F.lit(False)) | F.coalesce((get("$.papers") == "[]") | (get("$.status") == "empty"), F.lit(False))


def is_error(output: Column) -> Column:
    return F.get_json_object(output, "$.error").isNotNull()


def span_status(output: Column) -> Column:
    return F.when(is_error(output), "error").when(is_empty(output, F.lit("ok")), "empty").otherwise("ok")


def tool_spans(spans: DataFrame, tool: str | None = None) -> DataFrame:
    wanted = F.col("name").startswith("tool:") if tool is None else F.col("name") == f"tool:{tool}"
    return spans.filter(wanted).withColumn("ms", F.floor((F.col("end") - F.col("start")) * 1000))


def run_totals(spans: DataFrame) -> DataFrame:
    return spans.groupBy("run_id").agg(F.sum("tokens").alias("tokens"), F.bool_or(F.col("status").isin("error", "empty")).alias("has_anomaly"))


def _listed_ids(spans: DataFrame) -> DataFrame:
    out = spans.filter(F.col("name").isin("tool:search_papers", "tool:fetch_paper"))
    listed = F.from_json(F.get_json_object("output", "$.papers"), "array<struct<id:string,paperId:string>>")
    listed = F.when(F.col("name") == "tool:search_papers", F.transform(listed, lambda p: F.coalesce(p["id"], p["paperId"])))
    fetched = F.when(F.col("name") == "tool:fetch_paper", F.coalesce(F.get_json_object("output", "$.id"), F.get_json_object("output", "$.paperId")))
    ids = F.concat(F.coalesce(listed, F.array().cast("array<string>")), F.array(fetched))
    return out.select("run_id", F.explode(ids).alias("id")).filter("id is not null and id <> ''")


def seen_ids(spans: DataFrame) -> DataFrame:
    """(run_id, id) of papers that searches listed or fetches returned; an id is read as ``id`` or ``paperId``."""
    return _listed_ids(spans).distinct()


#: Names under which saving a file is traced.
SAVES = ["tool:save_to_file", "tool:save_file"]


def _saved() -> tuple[Column, Column]:
    """Aggregates over the spans of a run: its first saved content, and the first file that stays inside the output folder."""
    save = F.col("name").isin(SAVES)
    content, file = (F.when(save, F.get_json_object("input", f"$.{x}")) for x in ("content", "filename"))
    first = lambda x, ok: F.min_by(F.when(ok, x), F.when(ok, F.col("seq")))
    return first(content, content.isNotNull()), first(file, F.coalesce(safe_path(file), F.lit(False)))


def saved_content(spans: DataFrame) -> DataFrame:
    """(run_id, content, file): the first saved content of a run, and the first file that stays inside the output folder."""
    content, file = _saved()
    return spans.filter(F.col("name").isin(SAVES)).groupBy("run_id").agg(content.alias("content"), file.alias("file"))


def _cited(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(CITATION), F.lit(1)))


def cited_ids(contents: DataFrame) -> DataFrame:
    return contents.select("run_id", F.explode(_cited(F.col("content"))).alias("id"))


def well_formed(content: Column) -> Column:
    """Every bracketed S2 tag follows the strict form."""
    return F.forall(F.regexp_extract_all(content, F.lit(r"\[S2[^\]]*\]"), F.lit(0)), lambda t: t.rlike("^" + CITATION + "$"))


def invented(cited: DataFrame, seen: DataFrame) -> DataFrame:
    """(run_id, id) cited but never seen."""
    return cited.join(seen, ["run_id", "id"], "left_anti")


def safe_path(path: Column) -> Column:
    return (path != "") & ~path.startswith("/") & ~path.contains("..")


def _checked(runs: DataFrame, spans: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """(run_id, asked, saved, formed, says, all_empty, n_cited, n_invented, recall) of all runs; ``asked`` are those of ``runs``.

    A run's own facts, what it cites and has seen and what ``gold`` wants are rows of one table that is grouped by run and id, then by run: spans are
    read twice and no side of a join is made anew. A run's ids may be many, so they are grouped before their run is."""
    content, file = _saved()
    search = F.col("name") == "tool:search_papers"
    given = spans.filter("run_id is not null")
    own = given.filter(search | F.col("name").isin(SAVES)).groupBy("run_id").agg(content.alias("content"), file.alias("file"), F.bool_and(F.when(search, is_empty(F.col("output"), F.lit("ok")))).alias("all_empty"))
    flags = ("asked", "saved", "formed", "says", "all_empty", "cited", "seen", "gold")
    row = lambda i, **known: F.struct(i.alias("id"), *[known.get(f, F.lit(None)).cast("boolean").alias(f) for f in flags])
    text, none, true = F.coalesce("content", F.lit("")), F.lit(None).cast("string"), F.lit(True)
    facts = row(none, saved=F.col("file").isNotNull(), formed=well_formed(text), says=says_nothing_found(text), all_empty=F.col("all_empty"))
    cited = F.transform(F.coalesce(_cited(F.col("content")), F.array().cast("array<string>")), lambda i: row(i, cited=true))
    parts = [own.select("run_id", F.inline(F.concat(F.array(facts), cited))), runs.select("run_id", F.inline(F.array(row(none, asked=true))))]
    parts.append(_listed_ids(given).select("run_id", F.inline(F.array(row(F.col("id"), seen=true)))))
    if gold is not None:
        parts.append(gold.filter("run_id is not null").select("run_id", F.inline(F.array(row(F.col("id"), gold=true)))))
    ids = reduce(DataFrame.unionByName, parts).groupBy("run_id", "id").agg(*[F.bool_or(f).alias(f) for f in flags])
    hit = F.coalesce("seen", F.lit(False))
    recall = F.lit(1.0) if gold is None else F.coalesce(F.avg(F.when(F.col("gold"), hit.cast("double"))), F.lit(1.0))
    return ids.groupBy("run_id").agg(*[F.bool_or(f).alias(f) for f in flags[:5]], F.count("cited").alias("n_cited"), F.count_if(F.col("cited") & ~hit).alias("n_invented"), recall.alias("recall"))


def _reason(least_recall: float) -> Column:
    return (
        F.when(~F.coalesce("saved", F.lit(False)), "no file saved to output/")
        .when(~F.coalesce("formed", F.lit(True)), "malformed citation")
        .when(F.col("n_invented") > 0, "invented citation")
        .when(~_quiet(), "improvised a section with zero sources")
        .when(F.col("recall") < least_recall, "missed required papers")
    )


def _quiet() -> Column:
    """Not all searches were empty, or the text says so and cites nothing."""
    return ~F.coalesce("all_empty", F.lit(False)) | (F.coalesce("says", F.lit(False)) & (F.col("n_cited") == 0))


def grade_runs(runs: DataFrame, spans: DataFrame, gold: DataFrame | None = None, judged: DataFrame | None = None, least_recall: float = 0.8) -> DataFrame:
    """(run_id, passed, reason): checks from cheap to dear, the first that fails gives the reason.

    ``gold`` is (run_id, id); ``judged`` (run_id, scores map<string,int>, evidence) holds a judge's verdicts, where there are any."""
    joined, reason = _checked(runs, spans, gold).filter("asked"), _reason(least_recall)
    if judged is not None:
        joined = joined.join(judged.select("run_id", "scores", "evidence"), "run_id", "left")
        reason = reason.when(F.array_min(F.map_values("scores")) < 1, F.coalesce("evidence", F.lit("{}")))
    return joined.select("run_id", reason.isNull().alias("passed"), reason.alias("reason"))


#: What a text says that leaves a section out for want of sources.
ABSTENTIONS = ["no sources", "no results", "omitted", "abstain"]


def says_nothing_found(content: Column) -> Column:
    return F.lower(content).rlike("|".join(ABSTENTIONS))


def replay_cases(cases: DataFrame, runs: DataFrame, spans: DataFrame) -> DataFrame:
    """(case, run_id, passed) of frozen cases (case, run_id, kind): ``abstain`` asks that a run invents no citation and does not
    write a section without sources, ``full`` that it passes all grades."""
    full = F.coalesce("asked", F.lit(False)) & _reason(0.8).isNull()
    checked = _checked(runs, spans).select("run_id", full.alias("_full"), ((F.col("n_invented") == 0) & _quiet()).alias("_calm"))
    joined = cases.join(checked, "run_id", "left")
    return joined.select("case", "run_id", F.when(F.col("kind") == "full", F.coalesce("_full", F.lit(False))).otherwise(F.coalesce("_calm", F.lit(True))).alias("passed"))


def parser_regression(cases: DataFrame) -> DataFrame:
    """(name, passed) of cases (name, spec, low, high): bounds that a year spec must have; a null spec has none."""
    low, high = year_bounds(F.col("spec"))
    return cases.select("name", (low.eqNullSafe(F.col("low")) & high.eqNullSafe(F.col("high"))).alias("passed"))


def with_feedback(spans: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``spans`` with a span ``feedback:<item>`` after the others of its run for each verdict (run_id, item, verdict)."""
    last = spans.groupBy("run_id").agg(F.max("seq").alias("_last"))
    place = F.row_number().over(W.partitionBy("run_id").orderBy("item"))
    rows = verdicts.join(last, "run_id").select("run_id", (F.col("_last") + place).cast(spans.schema["seq"].dataType).alias("seq"), F.concat(F.lit("feedback:"), "item").alias("name"), F.lit("ok").alias("status"), F.col("verdict").alias("output"))
    return spans.unionByName(rows, allowMissingColumns=True)


def cost_rollup(spans: DataFrame, tier: str) -> DataFrame:
    """Tokens and cost by run and span name, and of each run as a whole (name null)."""
    by = spans.groupBy("run_id", "name").agg(F.sum("tokens").alias("tokens"))
    total = by.groupBy("run_id").agg(F.lit(None).cast("string").alias("name"), F.sum("tokens").alias("tokens"))
    return by.unionByName(total.select("run_id", "name", "tokens")).withColumn("usd", F.bround(F.col("tokens") / 1000 * PRICES[tier], 4))


def routed_and_flat(spans: DataFrame, routes: DataFrame, flat: str = "large", default: str = "medium") -> DataFrame:
    """(run_id, routed_usd, flat_usd): stages (the name before a colon) at their tier's price, or all at one."""
    prices = F.create_map(*[x for k, v in PRICES.items() for x in (F.lit(k), F.lit(v))])
    staged = spans.withColumn("stage", F.element_at(F.split("name", ":"), 1)).join(routes, "stage", "left")
    rate = F.element_at(prices, F.coalesce("tier", F.lit(default)))
    return staged.groupBy("run_id").agg(F.round(F.sum(F.col("tokens") / 1000 * rate), 6).alias("routed_usd"), F.round(F.sum(F.col("tokens") / 1000 * PRICES[flat]), 6).alias("flat_usd"))


def summary_lines(spans: DataFrame) -> DataFrame:
    """(run_id, line): subtopics, or searches where none is traced, papers fetched, and whether writing has begun."""
    count = lambda name: F.count_if(F.col("name") == name)
    a = spans.groupBy("run_id").agg(count("worker").alias("w"), count("tool:search_papers").alias("s"), count("tool:fetch_paper").alias("p"), F.bool_or(F.col("name") == "synthesize").alias("z"))
    state = F.when(F.col("z"), "synthesizing now").otherwise("gathering sources")
    return a.select("run_id", F.format_string("Surveying %d subtopics \u00b7 %d papers retrieved \u00b7 %s", F.when(F.col("w") > 0, F.col("w")).otherwise(F.col("s")), "p", state).alias("line"))


def plan_view(spans: DataFrame) -> DataFrame:
    """(run_id, lines): every subtopic with its mark; one line of its own for a run without any."""
    n = F.row_number().over(W.partitionBy("run_id").orderBy("seq"))
    workers = spans.filter(F.col("name") == "worker").withColumn("_n", n)
    mark = F.when(F.col("status").isin("ok", "error"), "[x]").when(F.col("status") == "empty", "[!]").otherwise("[ ]")
    label = F.coalesce(F.get_json_object("input", "$.subgoal"), F.concat(F.lit("subtopic "), F.col("_n").cast("string")))
    line = F.rtrim(F.concat(F.lit("  "), mark, F.lit(" "), label, F.lit(" "), F.when(F.col("status") == "empty", "0 papers").otherwise("")))
    lines = workers.select("run_id", F.struct("_n", line.alias("line")).alias("_l")).groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list("_l")), lambda x: x["line"]).alias("lines"))
    return spans.select("run_id").distinct().join(lines, "run_id", "left").withColumn("lines", F.coalesce("lines", F.array(F.lit("  [ ] (no plan recorded)"))))


def waterfall(spans: DataFrame) -> DataFrame:
    """(run_id, step, line): spans in order with their milliseconds, and their status where it is not ok."""
    ms = F.floor((F.col("end") - F.col("start")) * 1000).cast("string")
    line = F.concat(F.lit("  "), F.rpad("name", F.greatest(F.length("name"), F.lit(24)), F.lit(" ")), F.lit(" "), F.lpad(ms, F.greatest(F.length(ms), F.lit(6)), F.lit(" ")), F.lit("ms"), F.when(F.col("status") == "ok", "").otherwise(F.concat(F.lit("  <"), "status", F.lit(">"))))
    return spans.select("run_id", F.row_number().over(W.partitionBy("run_id").orderBy("seq")).alias("step"), line.alias("line"))


def self_consistency(samples: DataFrame) -> DataFrame:
    counts = samples.groupBy("question", F.trim("sample").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("question").agg((F.max("n") / F.sum("n")).alias("consistency"))


def claim_gate(claims: DataFrame, edges: DataFrame, fetched: DataFrame) -> DataFrame:
    """``claims`` (src, rel, dst, ambiguous) with action (state, resolve, ask, abstain), verified, and the text to show."""
    key = ["src", "rel", "dst"]
    joined = claims.join(edges.select(*key).distinct().withColumn("_e", F.lit(True)), key, "left").join(fetched.select(*key).distinct().withColumn("_f", F.lit(True)), key, "left")
    action = F.when(F.col("_e"), "state").when(F.col("_f"), "resolve").when(F.col("ambiguous"), "ask").otherwise("abstain")
    verb = F.when(F.col("rel") == "CITES", "cites").otherwise(F.col("rel"))
    said = lambda source: F.concat(F.concat_ws(" ", "src", verb, "dst"), F.lit(f"  [source: {source}, verified]"))
    maybe = F.concat(F.concat_ws(" ", "src", F.lit("may"), F.when(F.col("rel") == "CITES", "cite").otherwise(F.col("rel")), "dst"), F.lit("  [unverified: no supporting graph record]"))
    ask = F.concat(F.lit("Which paper do you mean by '"), "src", F.lit("' / '"), "dst", F.lit("'?"))
    text = F.when(F.col("action") == "state", said("graph")).when(F.col("action") == "resolve", said("tool:semantic_scholar")).when(F.col("action") == "ask", ask).otherwise(maybe)
    return joined.withColumn("action", action).withColumn("verified", F.col("action").isin("state", "resolve")).withColumn("text", text).drop("_e", "_f")


def resolved_edges(edges: DataFrame, gated: DataFrame) -> DataFrame:
    """``edges`` (src, rel, dst) with those that the gate resolved."""
    return edges.select("src", "rel", "dst").unionByName(gated.filter("action = 'resolve'").select("src", "rel", "dst")).distinct()


def response_policy(reducible: Column, by_agent: Column, bounded: Column, high_stakes: Column) -> Column:
    """What can be found out is resolved, or asked if only the user knows; a bounded doubt of low stakes is hedged; else abstain."""
    return F.when(reducible & by_agent, "resolve").when(reducible, "ask").when(bounded & ~high_stakes, "hedge").otherwise("abstain")


def budget_audit(spans: DataFrame, cap: int) -> DataFrame:
    """Tokens spent before each span of its run, and whether the cap blocks it."""
    return sum_before(spans, "run_id", "seq", "tokens", "spent").withColumn("blocked", F.col("spent") >= cap)


def write_audit(calls: DataFrame, irreversible: list[str]) -> DataFrame:
    """Calls (run_id, seq, tool, file) with allow or block and the reason: path escape, overwrite, irreversible tool."""
    earlier = F.lag("seq").over(W.partitionBy("run_id", "tool", "file").orderBy("seq")).isNotNull()
    save = F.col("tool") == "save_file"
    reason = F.when(save & ~safe_path(F.col("file")), "path_escape").when(save & earlier, "overwrite").when(F.col("tool").isin(irreversible), "irreversible")
    return calls.withColumn("reason", reason).withColumn("verdict", F.when(reason.isNull(), "allow").otherwise("block"))


def screening(records: DataFrame) -> DataFrame:
    """Screening flow of (title, doi, excluded_by): identified, screened after dedup, excluded, included, and a map of exclusions by
    reason. Records are one if title, whatever its case and white space, and doi are the same; one with a reason wins."""
    key = F.regexp_replace(F.lower(F.trim("title")), r"\s+", " ")
    unique = records.groupBy(key.alias("_t"), "doi").agg(F.min("excluded_by").alias("excluded_by"))
    a = records.agg(F.count(F.lit(1)).alias("identified"))
    b = unique.agg(F.count(F.lit(1)).alias("screened"), F.count("excluded_by").alias("excluded"), F.count_if(F.col("excluded_by").isNull()).alias("included"))
    reasons = unique.filter("excluded_by is not null").groupBy("excluded_by").agg(F.count(F.lit(1)).alias("n"))
    by = reasons.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("excluded_by", "n")))).alias("by_reason"))
    return a.join(b).join(by)
