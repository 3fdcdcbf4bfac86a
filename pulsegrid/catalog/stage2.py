"""Queries of the second stage, over signals that the events give, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import plain_text, severity_level
from ..operators import canonical as can
from ..operators import casework as case
from ..operators import evaluation as ev
from ..operators import learning as learn
from ..operators import logs
from ..operators import policy as pol
from ..operators import profile as prof
from ..operators import vectors as vec
from ..operators import windows as win
from ..plans import detectors as det
from ..sources import wire
from ..sources.events import events
from .common import EVENTS, recursion

#: Time that stands for now: the end of the events' month.
NOW = 1_706_659_200


def _canon(s, d):
    return can.canonical(wire.wire_signals(events(s, d)), NOW)


def _joined(df, *names: str):
    """Array columns as text, so that they compare."""
    return df.withColumns({n: F.array_join(F.transform(n, lambda x: x.cast("string")), ",") for n in names})


def _hits(s, d):
    return vec.clusters(_canon(s, d))


def _decided(s, d):
    return case.decided(case.derived(_hits(s, d), _canon(s, d)))


def _incidents(s, d):
    return case.incidents(_decided(s, d))


def _judged(s, d):
    """Incidents, of which those of odd entities stand for what an analyst suppressed."""
    odd = pol.entity_of_key(F.col("entity_key")) % 2 == 1
    return _incidents(s, d).withColumn("status", F.when(odd, "suppressed").otherwise(F.col("status")))


def _rules(s, d):
    """Compiled rules, one rule of ours for a detector, one for an entity and a detector, and one for all sure signals."""
    made = pol.rules_of(_judged(s, d), F.lit(NOW), 250)
    e = F.array().cast("array<bigint>")
    own = lambda n, action, entities, detector, least, scale: F.struct(
        F.lit(f"own{n}").alias("pattern_id"), F.lit(action).alias("action"), entities.alias("entities"), F.lit(detector).cast("int").alias("detector"), F.lit(least).alias("min_confidence"),
        F.lit(scale).cast("double").alias("score_scale"), F.lit(scale).cast("double").alias("confidence_scale"), F.lit(0).cast("long").alias("ttl"), F.lit(NOW).cast("long").alias("created"), F.lit(1000 + n).alias("rule"),
    )
    extra = made.groupBy().agg(F.count("*")).select(  # one row, whatever was made
        F.inline(F.array(own(1, "suppress", e, 3, 0.5, None), own(2, "boost", F.array(F.lit(5).cast("bigint")), 4, 0.4, 1.5), own(3, "boost", e, None, 0.95, 1.2)))
    )
    rows = made.unionByName(extra)
    return s.createDataFrame(rows.collect(), rows.schema)  # a policy is a document of at most 250 rules


def _subjects(s, d):
    return _canon(s, d).withColumn("entity", F.col("entity_hash").cast("bigint"))


def _effects(combine):
    return lambda s, d: pol.effects(_subjects(s, d), _rules(s, d), F.lit(NOW), combine).select(
        "event_id", F.round("score_scale", 6).alias("score_scale"), F.round("confidence_scale", 6).alias("confidence_scale"), "suppress"
    )


def _registry(s, d):
    """Three versions of a policy, of growing numbers of incidents."""
    i = pol.latest(_judged(s, d), 250)
    i = s.createDataFrame(i.collect(), i.schema)  # what the largest policy is made of, found once
    made = [pol.artifact(pol.rules_of(i, F.lit(NOW), n), f"policy-{n}", NOW + n) for n in (50, 100, 250)]
    return made[0].unionByName(made[1]).unionByName(made[2])


def _versions(df):
    return df.select("version", "status", "rule_count", "compiled", "rollback_of")


def _rule_log(s, d):
    """Suppressions and patches of rhythms, set and lifted, from the events' own ids."""
    c = _canon(s, d).where("rhythm LIKE 'r%'").groupBy("rhythm").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    n = F.substring("rhythm", 2, 9).cast("int")
    entry = lambda kind, change, at, seconds: F.struct(F.lit(kind).alias("kind"), F.lit(change).alias("change"), at.alias("at"), F.lit(seconds).cast("long").alias("seconds"))
    rows = F.array(
        entry("suppress", "set", F.col("first") + n, 86400), entry("suppress", "set", F.col("first") + n * 86400, 864000), entry("patch", "set", F.col("first"), None),
        entry("patch", "lift", F.when(n % 2 == 0, F.col("first") + 1), None),
    )
    return c.select("rhythm", F.inline(F.filter(rows, lambda r: r["at"].isNotNull())))


def _scored(s, d):
    """Events with detector scores by the wire's rule: for the expressions behind the fold, and as feedback's originals."""
    e = events(s, d)
    i = F.col("event_id")
    fired = lambda k: (i + k) % 3 == 0
    scores = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda k: F.struct(
            F.when(fired(k), ((i * 7 + k * 13) % 100) / 100).otherwise(0.0).alias("score"), F.when(fired(k), (50 + (i + k) % 50) / 100).otherwise(0.0).alias("confidence"), fired(k).alias("fired"),
            F.lit(0.0).alias("expected"), F.when(fired(k), F.col("value")).otherwise(0.0).alias("observed"),
        ),
    )
    found = prof.with_ensemble(e.withColumn("detector_scores", scores)).withColumn("score_limit", F.lit(0.5)).withColumn("sequence", i)
    anomaly = prof.decided(F.col("detector_scores"), F.col("score"), F.col("confidence"), F.col("score_limit"), i % 17 == 0)
    return found.withColumn("severity", severity_level(F.col("score"))).withColumn("anomaly", anomaly).withColumn("built", prof.built(F.col("detector_scores"), F.col("score")))


def _feedback(s, d):
    """What stage 2 would say of each event: right where its value is high, with its original scores."""
    return _scored(s, d).select(
        "event_id", F.col("entity"), F.col("t").alias("signal_t"), (F.col("value") > 100).alias("true_positive"), "anomaly",
        F.transform("detector_scores", lambda x: x["score"]).alias("detector_scores"), ((30 + F.col("event_id") % 71) / 100).alias("confidence"),
    )


def _windows(s, d):
    """Truth windows around each day's largest value, every third with services (detectors) of its own."""
    w = ev.truth_windows(events(s, d)).withColumn("services", F.when(F.col("anomaly_id") % 3 == 0, F.array(F.lit("click"), F.lit("error"))).otherwise(F.array().cast("array<string>")))
    return w.select(F.col("anomaly_id").alias("seq"), F.concat(F.lit("a"), F.col("anomaly_id").cast("string")).alias("anomaly_id"), "start", "end", "services")


def _logs(s, d):
    i = F.col("event_id")
    rows = events(s, d).select(
        "event_id", "t", F.col("detector").alias("service"), F.when(i % 40 == 0, F.concat(F.lit("own"), (i % 7).cast("string"))).alias("own_id"), (i % 3 != 0).alias("flagged_truth"),
        (F.col("value") > 60).alias("detected"),
    )
    return ev.with_truth(rows, _windows(s, d))


def _lines(s, d):
    """Log lines of several sources made of the events: nested batches, a supercomputer's lines, and neither."""
    i, ident = F.col("event_id"), F.lpad(F.hex("trace_id"), 8, "0")
    ids = F.concat(F.lit("got "), F.lower(ident), F.lit("-0000-0000-00000000"), F.lower(F.lpad(F.hex("entity"), 4, "0")))
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value"))
    record = F.struct((F.col("t") * 10**9).cast("string").alias("timeUnixNano"), F.lit("INFO").alias("severityText"), F.struct(ids.alias("stringValue")).alias("body"))
    nested = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(attr("service.name", F.col("detector"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    flat = F.to_json(F.struct(F.struct(F.struct(F.col("detector").alias("service.name")).alias("attributes")).alias("resource"), F.when(i % 4 == 0, "ERROR").alias("severityText"), F.struct(ids.alias("stringValue")).alias("body")))
    bgl = F.concat_ws(" ", F.col("t").cast("string"), F.lit("2024.01.01"), F.concat(F.lit("R"), F.col("entity").cast("string")), F.lit("dev"), F.lit("RAS"), F.lit("KERNEL"), F.when(i % 2 == 0, "INFO").otherwise("FATAL"), F.lit("a message"))
    kind = F.col("entity") % 4
    return events(s, d).select(
        F.concat(F.lit("s"), F.col("entity").cast("string")).alias("source"), i.alias("line_no"),
        F.when(kind == 0, nested).when(kind == 1, bgl).when(kind == 2, flat).otherwise(F.concat(F.lit("no log "), i.cast("string"))).alias("line"), "entity",
    )


def _points(s, d):
    """The embeddings as points: groups by label, times and shares by id."""
    e = s.read.parquet(f"{d}/embeddings.parquet")
    i = F.col("vec_id")
    return e.select(
        i.cast("string").alias("event_id"), (F.lit(NOW - 864000) + i * 600).alias("t"), wire.day_bucket(F.lit(NOW - 864000) + i * 600).alias("day"), F.col("label").cast("string").alias("group_key"),
        F.col("embedding").alias("dense"), ((i * 37 % 100) / 100).alias("confidence"), ((i * 53 % 100) / 100).alias("severity"), ((i * 71 % 100) / 100).alias("score"),
    )


def _batches(s, d):
    """Events as JSON arrays of a few at a time, and a body that is none."""
    one = F.struct(F.col("entity").cast("string").alias("u"), F.col("value").alias("v"), F.col("t_ns").alias("t"))
    g = events(s, d).groupBy(F.floor(F.col("event_id") / 50).alias("b")).agg(F.collect_list(one).alias("x"))
    return g.select(F.when(F.col("b") % 9 == 8, "{no array").otherwise(F.to_json("x")).alias("body"), "b")


def _bodies(s, d):
    """Wire signals as JSON bodies; some lack a field, some bodies have no signals."""
    w = wire.wire_signals(events(s, d).where("event_id % 21 = 0"))
    w = w.withColumn("n", F.coalesce(F.substring("event_id", 2, 9).cast("long"), F.lit(0))).withColumn("score", F.when(F.col("n") % 2 != 1, F.col("score")))
    g = w.groupBy((F.col("timestamp").cast("decimal(38,0)") % 16).cast("int").alias("b")).agg(F.collect_list(F.struct(*[c for c in w.columns if c != "n"])).alias("signals"))
    return g.select(F.when(F.col("b") == 7, "{}").otherwise(F.to_json(F.struct("signals"))).alias("body"))


def _attributes(s, d):
    """Log attributes in an order of their own, by event."""
    i, v = F.col("event_id"), F.col("value")
    one = lambda k, **x: F.struct(F.lit(k).alias("key"), F.struct(*[x.get(n, F.lit(None).cast(t)).alias(n) for n, t in (("stringValue", "string"), ("intValue", "bigint"), ("doubleValue", "double"))]).alias("value"))
    a = F.array(
        one("http.status_code", intValue=F.lit(200).cast("bigint")), F.when(i % 2 == 0, one("latency_ms", doubleValue=v)), F.when(i % 3 == 0, one("http.duration_ms", stringValue=v.cast("string"))),
        F.when(i % 5 == 0, one("service.name", stringValue=F.col("detector"))), F.when(i % 7 == 0, one("http.duration_ms", stringValue=F.lit("no number"))),
    )
    a = F.filter(a, lambda x: x.isNotNull())
    return events(s, d).select("event_id", F.when(i % 11 == 0, F.slice(a, 3, 9)).otherwise(a).alias("a"))


def _by_detector(s, d):
    return learn.by_detector(_feedback(s, d))


def _betas(s, d):
    return learn.beta_states(_by_detector(s, d))


def _weights(s, d):
    return learn.refreshed_weights(learn.expected_weights(_betas(s, d)), learn.performance(_by_detector(s, d)))


def _text_points(s, d):
    return vec.in_window(_canon(s, d), NOW - 20 * 86400, NOW - 10 * 86400, "det 3")


QUERIES = {
    "json_batches": lambda s, d: wire.parsed_events(_batches(s, d)),
    "metric_priority": lambda s, d: _attributes(s, d).select("event_id", wire.metric(F.col("a")).alias("metric"), wire.service_name(F.col("a")).alias("service")),
    "signal_validation": lambda s, d: (lambda p: p[0].select("event_id", "timestamp", F.lit("ok").alias("reason")).unionByName(p[1].select("event_id", F.lit(None).cast("string").alias("timestamp"), "reason")))(wire.split_signals(_bodies(s, d))),
    "dead_letters_latest": lambda s, d: wire.latest(wire.split_signals(_bodies(s, d))[1].where("event_id IS NOT NULL"), 5, "event_id").select("event_id", "reason"),
    "canonical": lambda s, d: _canon(s, d).drop("detector_scores"),
    "batch_ids": lambda s, d: can.batch_id(_canon(s, d), "day"),
    "wire": lambda s, d: wire.wire(_scored(s, d)).withColumn("detector_scores", F.array_join(F.transform("detector_scores", lambda x: F.round(x * 100).cast("int").cast("string")), ",")).withColumns({c: F.round(c, 6) for c in ("score", "confidence")}),
    "slim": lambda s, d: wire.slim(_scored(s, d)).withColumn("detector_scores", F.array_join(F.transform("detector_scores", lambda x: F.round(x * 100).cast("int").cast("string")), ",")).withColumns({c: F.round(c, 6) for c in ("score", "confidence")}),
    "legacy": lambda s, d: wire.legacy(_scored(s, d)).withColumn("score", F.round("score", 6)),
    "attribution": lambda s, d: _scored(s, d).select(
        "event_id", F.col("attribution.primary").alias("first"), F.col("attribution.secondary").alias("second"), F.round("attribution.primary_share", 6).alias("first_share"),
        F.round("attribution.secondary_share", 6).alias("second_share"), F.col("attribution.fired").alias("fired"), prof.detector_name(F.col("attribution.primary")).alias("name"),
        prof.detector_id(prof.detector_name(F.col("attribution.primary"))).alias("id"),
    ),
    "ensemble_of_ten": lambda s, d: _scored(s, d).select("event_id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "severity", "anomaly", "built"),
    "reasons": lambda s, d: _scored(s, d).select("event_id", prof.reason(F.col("anomaly"), F.col("severity"), F.round("score", 4), F.round("confidence", 4), F.struct(
        F.col("attribution.primary").alias("primary"), F.col("attribution.secondary").alias("secondary"), F.round("attribution.primary_share", 4).alias("primary_share"),
        F.round("attribution.secondary_share", 4).alias("secondary_share"), F.col("attribution.fired").alias("fired"))).alias("reason")),
    "run_lengths": lambda s, d: events(s, d).select("event_id", F.round(F.log(can.run_length(F.col("value") / 100, F.lit(0.5), F.lit(4.0))), 6).alias("log_length")),
    "entity_keys": lambda s, d: _incidents(s, d).select("incident_id", pol.entity_of_key(F.col("entity_key")).alias("entity"), can.entity_text(F.col("entity_key"), F.lit("77")).alias("text")),
    "payload_times": lambda s, d: events(s, d).select("event_id", can.payload_time(F.when(F.col("event_id") % 2 == 0, F.col("t").cast("string")), F.when(F.col("event_id") % 3 == 0, F.lit("x")).otherwise("12.5")).alias("t")),
    "relative_times": lambda s, d: events(s, d).select("event_id", can.seconds(F.when(F.col("event_id") % 10 == 0, F.lit("x")).otherwise((F.col("event_id") * 10**9).cast("string")), F.lit(NOW).cast("long"), F.col("event_id") % 2 == 0).alias("t")),
    "percents": lambda s, d: events(s, d).select("event_id", can.percent(F.col("value") / 1000).alias("percent")),
    "linear_bin": lambda s, d: win.linear_bin(events(s, d), 10.0, 100.0, 20),
    "gaps": lambda s, d: win.gaps(events(s, d)).select("event_id", "gap_ms", F.round("rate", 9).alias("rate")),
    "trend_word": lambda s, d: win.trend_word(events(s, d)),
    "sparse_terms": lambda s, d: vec.sparse_terms(s.read.parquet(f"{d}/documents.parquet"), "doc_id").withColumn("weight", F.round("weight", 9)),
    "hash_vectors": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(F.transform(vec.hash_vector(plain_text(F.coalesce("text", F.lit("")))), lambda x: x.cast("int").cast("string")), "").alias("bits")),
    "resized": lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", *[F.size(vec.resized(F.col("embedding"), n)).alias(f"n{n}") for n in (3, 80)], vec.resized(F.col("embedding"), 80)[79].cast("double").alias("last"), vec.resized(F.col("embedding"), 3)[2].cast("double").alias("third")),
    "vector_index": lambda s, d: vec.indexed(_canon(s, d), s.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("rhythm=r"), (F.col("vec_id") % 7).cast("string"), F.lit("  det="), (F.col("vec_id") % 10).cast("string")).alias("text"), F.col("embedding").alias("vector"))).select("event_id", F.size("dense").alias("width"), F.exists("dense", lambda x: (x != 0) & (x != 1)).alias("real")),
    "windowed_text": lambda s, d: _text_points(s, d).select("event_id", "day", "t", "context"),
    "day_list": lambda s, d: events(s, d).groupBy("entity").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("entity", F.array_join(wire.days_between(F.col("a"), F.least(F.col("b"), F.col("a") + 400000)), ",").alias("days")),
    "cluster_hits": lambda s, d: _hits(s, d).select("day", "group_key", "event_id", "t", "count"),
    "cluster_firsts": lambda s, d: vec.firsts(_canon(s, d)).select("key", "event_id", "t"),
    "cluster_scored": lambda s, d: vec.clusters(_canon(s, d), score="score").select("day", "group_key", "event_id", "score", "count"),
    "triage": lambda s, d: (lambda p: vec.triaged(p, p.where("event_id IN ('3', '14', '15')"), p.where("event_id IN ('9', '26')")))(_points(s, d)).select("event_id", "group_key", F.round("score", 6).alias("score")),
    "refined": lambda s, d: vec.refined(_points(s, d).where("CAST(event_id AS INT) % 5 = 0")).select("event_id", F.round("context_score", 6).alias("score")),
    "case_candidates": lambda s, d: _joined(case.from_hits(_canon(s, d)), "members", "truth_ids", "run_ids").drop("evidence_entity", "apply_group"),
    "seed_candidates": lambda s, d: _joined(case.from_seeds(_canon(s, d)), "members", "truth_ids", "run_ids").drop("evidence_entity", "apply_group"),
    "case_decisions": lambda s, d: _decided(s, d).select("incident_id", F.col("members")[0].alias("member"), "reason", "status", "why", "confidence_pct", "severity_pct", "score_pct"),
    "cases": lambda s, d: _joined(_incidents(s, d), "members", "truth_ids", "run_ids"),
    "cases_merged": lambda s, d: _joined(case.incidents(_decided(s, d), merge=True), "members", "truth_ids", "run_ids"),
    "case_edges": lambda s, d: case.edges(case.from_hits(_hits(s, d))),
    "case_graph": lambda s, d: case.edges(case.from_seeds(_canon(s, d))).where("incident_id LIKE 'gt_%'"),
    "case_feedback": lambda s, d: case.feedback(_decided(s, d), NOW).drop("members"),
    "case_with_decisions": lambda s, d: case.with_decisions(_incidents(s, d), _decided(s, d), 3).select("incident_id", F.size("decisions").alias("n"), F.array_join(F.transform("decisions", lambda x: x["status"]), ",").alias("statuses")),
    "cases_of_run": lambda s, d: case.of_run(_incidents(s, d), "run1", 40).select("incident_id", "last_seen"),
    "case_quality": lambda s, d: case.quality(_incidents(s, d), _canon(s, d).select("truth_id").where("truth_id IS NOT NULL"), "run1").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "merge_error", "split_error", "escalation_quality")}),
    "rules": lambda s, d: _joined(pol.rules_of(_judged(s, d), F.lit(NOW)), "entities"),
    "rule_index": lambda s, d: pol.rule_index(_rules(s, d), strict=False).select("rule", "found_by", "entity", "detector", "ends"),
    "policy_effects": _effects("product"),
    "policy_last": _effects("last"),
    "policy_drafts": lambda s, d: _versions(_registry(s, d)),
    "policy_published": lambda s, d: _versions(pol.published(pol.published(_registry(s, d), "policy-50"), "policy-250")),
    "policy_rolled_back": lambda s, d: _versions(pol.rolled_back(pol.published(_registry(s, d), "policy-250"), "policy-50", NOW + 999)),
    "policy_current": lambda s, d: _versions(pol.current(pol.published(_registry(s, d), "policy-100"))),
    "policy_history": lambda s, d: _versions(pol.history(_registry(s, d), 2)),
    "active_rules": lambda s, d: pol.active_rules(_rule_log(s, d), F.lit(NOW - 15 * 86400)),
    "ruled_out": lambda s, d: pol.without_ruled(_canon(s, d), pol.active_rules(_rule_log(s, d), F.lit(0))).select("event_id", "rhythm", "t"),
    "truth_windows_joined": lambda s, d: _logs(s, d).select("event_id", "truth_id"),
    "truth_diagnostics": lambda s, d: ev.truth_diagnostics(_logs(s, d), _windows(s, d)),
    "anomaly_breakdown": lambda s, d: ev.breakdown(_logs(s, d), _windows(s, d)).withColumn("recall", F.round("recall", 6)),
    "confusion_by_score": lambda s, d: ev.by_score(_scored(s, d).withColumn("truth", F.col("value") > 100)).withColumn("mean_score", F.round("mean_score", 6)),
    "confusion_report": lambda s, d: ev.report(ev.by_score(_scored(s, d).withColumn("truth", F.col("value") > 100))),
    "rounded_percentiles": lambda s, d: ev.rounded_percentiles(events(s, d)),
    "windowed_quality": lambda s, d: ev.windowed(events(s, d).select("t", (F.col("value") > 60).alias("anomaly")), _scored(s, d).where("event_id % 2 = 0").select("t", "anomaly"), NOW, 20 * 86400, "sim"),
    "truth_seconds": lambda s, d: ev.truth_seconds(_windows(s, d), _incidents(s, d).select(F.col("last_seen").alias("t")), NOW - 2 * 86400, 86400).where("truth OR detected"),
    "run_summary": lambda s, d: ev.run_summary(_scored(s, d).select("t", "entity", F.col("anomaly").alias("flagged"), (F.col("value") > 100).alias("truth"))).withColumn("per_second", F.round("per_second", 9)),
    "counters": lambda s, d: ev.counters(_scored(s, d).select(F.when(F.col("event_id") % 17 == 0, "dropped").when(F.col("anomaly"), "anomalies").otherwise("ingested").alias("outcome"))),
    "version_metrics": lambda s, d: _scored(s, d).groupBy((F.col("event_id") % 3).alias("version"), F.floor(F.col("t") / 86400).alias("window")).agg(F.count("*").alias("events"), F.count_if("anomaly").alias("anomalies"), F.count_if(F.col("anomaly") & (F.col("value") > 100)).alias("true_positives")),
    "diversity": lambda s, d: ev.diversity(events(s, d)).select("entity", "exact", (F.abs(F.col("sketched") - F.col("exact")) <= 1).alias("near")),
    "frequencies": lambda s, d: ev.frequencies(events(s, d)),
    "count_min": lambda s, d: (lambda e: ev.frequencies(e).join(ev.estimated(e.select("entity", "trace_id").distinct(), ev.count_min(e)), ["entity", "trace_id"]).select("entity", "trace_id", "n", (F.col("estimate") >= F.col("n")).alias("bounded")))(events(s, d)),
    "log_lines": lambda s, d: logs.parsed_lines(_lines(s, d)).select("line_no", *logs.PARTS),
    "log_schemas": lambda s, d: logs.schemas(_lines(s, d)).select("source", F.array_join(F.transform("fields", lambda f: F.concat_ws("|", f["name"], f["type"], f["source_field"])), ";").alias("fields")),
    "log_profile": lambda s, d: logs.profile(_lines(s, d).where("entity % 4 = 2")),
    "schema_registry": lambda s, d: pol.upserted(logs.schemas(_lines(s, d).where("line_no % 2 = 0")).select("source", F.lit(1).alias("saved"), F.size("fields").alias("n")), logs.schemas(_lines(s, d).where("line_no % 3 = 0")).select("source", F.lit(2).alias("saved"), F.size("fields").alias("n")), "source", "saved"),
    "feedback_stats": lambda s, d: learn.feedback_stats(_feedback(s, d)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")}),
    "feedback_matched": lambda s, d: learn.matched(_feedback(s, d), events(s, d).where("event_id % 10 = 0")),
    "feedback_entities": lambda s, d: learn.entity_of(case.feedback(_decided(s, d), NOW).withColumn("entity_hash", F.lit(None).cast("bigint"))).groupBy("accepted").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities")),
    "feedback_scores": lambda s, d: learn.with_scores(case.feedback(_decided(s, d), NOW), _scored(s, d).withColumn("event_id", F.concat(F.lit("e"), F.col("event_id").cast("string")))).select("pattern_id", "event_id", "true_positive", "anomaly"),
    "learning_totals": lambda s, d: learn.learning_totals(_feedback(s, d)),
    "learning_significant": lambda s, d: learn.significant(_feedback(s, d), "entity"),
    "detector_performance": lambda s, d: learn.performance(_by_detector(s, d)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "score_variance")}),
    "bandit_states": lambda s, d: _betas(s, d).withColumns({c: F.round(c, 6) for c in ("alpha", "beta")}),
    "bandit_weights": lambda s, d: learn.expected_weights(_betas(s, d)).withColumn("weight", F.round("weight", 6)),
    "bandit_samples": lambda s, d: learn.sampled_weights(_betas(s, d)),
    "refreshed_weights": lambda s, d: _weights(s, d).withColumn("weight", F.round("weight", 6)),
    "profile_snapshots": lambda s, d: learn.restored(learn.snapshot(_betas(s, d), _weights(s, d), "policy-250")).select("entity", "detector", "n", F.round("weight", 6).alias("weight"), F.round("alpha", 6).alias("alpha")),
    "profile": lambda s, d: prof.profiled(events(s, d), "entity", "trace_id").select("event_id", "sequence", "anomaly", "severity", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), F.col("attribution.fired").alias("fired")),
    "profile_baseline": lambda s, d: prof.profiled(events(s, d), "entity", "trace_id").select("event_id", "baseline.age", "baseline.mean", "baseline.std", "baseline.warmup"),
    "profile_cases": lambda s, d: case.decided(case.from_hits(can.canonical(wire.wire(prof.profiled(events(s, d), "entity", "trace_id").where("anomaly")).withColumn("timestamp", F.col("timestamp").cast("string")).withColumn("severity", F.col("severity").cast("double")).withColumn("attributes", F.create_map(F.lit("trace_id"), F.lit(None).cast("string"))), NOW))).select("incident_id", "status", F.size("members").alias("members")),
    "profile_store": lambda s, d: events(s, d).groupBy("entity").agg(F.count("*").alias("n")).agg(F.count("*").alias("profiles"), F.count_if(F.col("n") >= 50).alias("mature"), F.sum("n").alias("accesses")),
}



def _fixed(x: str, digits: int) -> str:
    """A number's text with so many digits, halves of its shortest decimal form up."""
    return f"CAST(CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 20)), {digits}) AS DECIMAL(30, {digits})) AS VARCHAR)"


_W = f"""{EVENTS},
w AS (SELECT *, event_id AS i, CASE WHEN event_id % 4 != 0 THEN 'e' || event_id END AS given, CAST(entity AS VARCHAR) AS entity_hash, least(1.0, value / 200)::DOUBLE AS score, event_id % 10 AS det,
  (30 + event_id % 71) / 100 AS confidence, CASE WHEN event_id % 3 != 2 THEN 'run' || (event_id % 3) END AS run_id, CASE WHEN value > 150 THEN 'a' || (t // 86400) END AS truth_id FROM e),
v AS (SELECT * REPLACE (CASE WHEN i % 30 = 1 THEN {NOW} + t % 86400 // 1000 ELSE t END AS t), CASE WHEN score >= 0.9 THEN 4 WHEN score >= 0.75 THEN 3 WHEN score >= 0.6 THEN 2 WHEN score >= 0.4 THEN 1 ELSE 0 END AS level, len(list_filter(range(10), lambda k: (i + k) % 3 = 0)) AS fired,
  CASE WHEN i % 5 = 0 THEN 'r' || (entity % 7) ELSE left(entity_hash, 16) END AS rhythm FROM w),
c AS (SELECT * REPLACE (coalesce(given, left(md5(format('{{}}:{{}}:{{}}:{{:.6f}}:{{:.6f}}', entity_hash, t, det, score, level / 4)), 16)) AS event_id, CAST(trace_id AS VARCHAR) AS trace_id),
  'hash:' || entity_hash AS entity_id, level / 4 AS severity, rhythm || ':' || det AS group_key, 'rhythm=' || rhythm || ' det=' || det AS context, strftime(make_timestamp(t * 1000000), '%Y_%m_%d') AS day FROM v),
h0 AS (SELECT *, row_number() OVER (PARTITION BY day, group_key ORDER BY t, event_id) AS rk FROM c QUALIFY rk <= 3),
h1 AS (SELECT *, count(*) OVER (PARTITION BY day, group_key) AS cnt FROM h0),
h2 AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY t, event_id) AS place FROM h1 WHERE rk = 1 QUALIFY place <= 100),
h AS (SELECT * FROM h2 QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY day) = 1 ORDER BY day, t, event_id LIMIT 200)"""


def _group(src: str, key: str, reason: str, sure: str, prefix: str, bucket: str) -> str:
    return f"""SELECT 'inc_' || left(sha256('{reason}:' || key || ':' || {bucket}), 16) AS incident_id, '{reason}' AS reason, {sure}::DOUBLE AS confidence, '{prefix}' || key AS entity_key,
  list_sort(list(DISTINCT event_id)) AS members, coalesce(list_sort(list(DISTINCT truth_id) FILTER (truth_id IS NOT NULL)), []) AS truth_ids, coalesce(list_sort(list(DISTINCT run_id) FILTER (run_id IS NOT NULL)), []) AS run_ids, min(t) AS first_seen,
  max(t) AS last_seen, max(severity) AS severity_max, max(score) AS score_max, 0 AS grp FROM (SELECT *, CAST({key} AS VARCHAR) AS key FROM {src}) AS k
  WHERE (score >= 0.2 OR severity >= 0.2) AND key IS NOT NULL GROUP BY key HAVING count(DISTINCT event_id) >= 2"""


def _cand(src: str) -> str:
    return " UNION ALL ".join([
        _group(src, "trace_id", "trace", "1.0", "trace:", "'0'"), _group(src, "rhythm", "semantic", "0.85", "rhythm:", "'0'"),
        _group(src, "t // 60", "temporal", "0.8", "bucket:", "CAST(CAST(key AS BIGINT) * 60 AS VARCHAR)"),
    ])


_SEEDS = """SELECT CASE WHEN truth_id IS NOT NULL THEN 'gt_' || truth_id ELSE 'evt_' || event_id END AS incident_id, 'temporal' AS reason, greatest(0.4, least(1.0, confidence))::DOUBLE AS confidence,
  entity_id AS entity_key, [event_id] AS members, CASE WHEN truth_id IS NOT NULL THEN [truth_id] ELSE [] END AS truth_ids, CASE WHEN run_id IS NOT NULL THEN [run_id] ELSE [] END AS run_ids, t AS first_seen, t AS last_seen, severity AS severity_max,
  score AS score_max, 1 AS grp FROM c WHERE confidence >= 0.6 OR severity >= 0.5 OR score >= 0.5"""
_D = f"""{_W}, fh AS ({_cand('h')}), sd AS ({_SEEDS}), dv AS (SELECT * FROM fh UNION ALL SELECT * FROM sd),
d AS (SELECT *, CASE WHEN severity_max >= 0.5 OR score_max >= 0.6 THEN 'escalated' WHEN len(members) >= 2 AND confidence >= 0.3 THEN 'merged' ELSE 'new' END AS status,
  format('reason={{}};members={{}};severity_max={{}};score_max={{}}', reason, len(members), {_fixed('severity_max', 3)}, {_fixed('score_max', 3)}) AS why, CAST(floor(confidence * 100 + 0.5) AS INT) AS confidence_pct,
  CAST(floor(severity_max * 100 + 0.5) AS INT) AS severity_pct, CAST(floor(score_max * 100 + 0.5) AS INT) AS score_pct FROM dv),
i AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY grp DESC, first_seen DESC, members[1] DESC) = 1)"""
_KEYNUM = r"TRY_CAST(nullif(regexp_extract(entity_key, '^hash:\s*(\d+)\s*$', 1), '') AS BIGINT)"
_J = f"{_D}, j AS (SELECT * REPLACE (CASE WHEN {_KEYNUM} % 2 = 1 THEN 'suppressed' ELSE status END AS status), {_KEYNUM} AS ent FROM i)"


def _ruled(n: int) -> str:
    return f"""SELECT incident_id AS pattern_id, CASE WHEN status = 'suppressed' THEN 'suppress' ELSE 'boost' END AS action, [ent] AS entities, NULL::INT AS detector, confidence_pct / 100 AS min_confidence,
  CASE WHEN status != 'suppressed' THEN 1.1::DOUBLE END AS score_scale, CASE WHEN status != 'suppressed' THEN 1.05::DOUBLE END AS confidence_scale, CASE WHEN status = 'suppressed' THEN 3600 ELSE 1800 END::BIGINT AS ttl,
  {NOW}::BIGINT AS created, CAST(row_number() OVER (ORDER BY last_seen DESC, incident_id) AS INT) AS rule
  FROM (SELECT * FROM j ORDER BY last_seen DESC, incident_id LIMIT {n}) AS y WHERE confidence_pct / 100 >= 0.6 AND status IN ('suppressed', 'escalated', 'merged') AND ent IS NOT NULL"""


_R = f"""{_J}, ru AS ({_ruled(250)} UNION ALL
  SELECT 'own1', 'suppress', []::BIGINT[], 3, 0.5, NULL, NULL, 0, {NOW}, 1001 UNION ALL SELECT 'own2', 'boost', [5]::BIGINT[], 4, 0.4, 1.5, 1.5, 0, {NOW}, 1002
  UNION ALL SELECT 'own3', 'boost', []::BIGINT[], NULL, 0.95, 1.2, 1.2, 0, {NOW}, 1003),
m AS (SELECT c.event_id, ru.rule, action, CASE WHEN action = 'boost' THEN greatest(coalesce(score_scale, 1), 0) ELSE 1 END::DOUBLE AS s, CASE WHEN action = 'boost' THEN greatest(coalesce(confidence_scale, 1), 0) ELSE 1 END::DOUBLE AS k,
  CASE WHEN len(entities) > 0 THEN 0 WHEN ru.detector IS NOT NULL THEN 1 ELSE 2 END AS probe
  FROM c JOIN ru ON (len(entities) = 0 OR list_contains(entities, c.entity)) AND (ru.detector IS NULL OR ru.detector = c.det) AND c.confidence >= min_confidence)"""
_DRAFTS = " UNION ALL ".join(
    f"SELECT 'policy-{n}' AS version, 'draft' AS status, CAST(count(*) AS INT) AS rule_count, {NOW + n}::BIGINT AS compiled, NULL::VARCHAR AS rollback_of FROM ({_ruled(n)}) AS z" for n in (50, 100, 250)
)
_P = f"{_J}, dr AS ({_DRAFTS})"
_X = f"""{EVENTS}, x0 AS (SELECT *, event_id AS i, list_transform(range(10), lambda k: (event_id + k) % 3 = 0) AS f, list_transform(range(10), lambda k: ((event_id * 7 + k * 13) % 100) / 100) AS s,
  list_transform(range(10), lambda k: (50 + (event_id + k) % 50) / 100) AS c FROM e),
x1 AS (SELECT *, list_transform(range(1, 11), lambda k: CASE WHEN f[k] THEN s[k] ELSE 0e0 END) AS sc, list_transform(range(1, 11), lambda k: CASE WHEN f[k] THEN c[k] ELSE 1e0 END) AS cf FROM x0),
x2 AS (SELECT *, list_sum(list_transform(range(1, 11), lambda k: sc[k] * cf[k])) / list_sum(cf) AS score, 0.6e0 * len(list_filter(sc, lambda y: y > 0.5)) / 10 + 0.4e0 * list_sum(cf) / 10 AS confidence,
  list_transform(range(1, 11), lambda k: CASE WHEN f[k] THEN sc[k] * c[k] ELSE 0e0 END) AS given FROM x1),
x3 AS (SELECT *, list_sort(list_transform(range(1, 11), lambda k: {{'c': -round(given[k], 9), 'i': k - 1}})) AS o, list_sum(given) AS total, len(list_filter(f, lambda y: y)) AS fired,
  CASE WHEN score >= 0.9 THEN 4 WHEN score >= 0.75 THEN 3 WHEN score >= 0.6 THEN 2 WHEN score >= 0.4 THEN 1 ELSE 0 END AS severity FROM x2),
x AS (SELECT *, i % 17 != 0 AND (len(list_filter(range(1, 11), lambda k: f[k] AND s[k] >= 0.1)) > 0 OR score >= 0.1) AS anomaly, len(list_filter(range(1, 11), lambda k: f[k] AND s[k] >= 0.3)) > 0 OR score >= 0.2 AS built,
  o[1].i AS a1, o[2].i AS a2, CASE WHEN total > 0 THEN -o[1].c / total ELSE 0 END AS p1, CASE WHEN total > 0 THEN -o[2].c / total ELSE 0 END AS p2 FROM x3)"""
_NAMES = "[" + ", ".join(f"'{n}'" for n in det.NAMES) + "]"
_SC = "array_to_string(list_transform(sc, lambda y: CAST(CAST(round(y * 100) AS INT) AS VARCHAR)), ',') AS detector_scores"
_FB = f"""{_X}, fb AS (SELECT event_id, entity, t AS signal_t, value > 100 AS tp, anomaly, sc, (30 + event_id % 71) / 100 AS confidence, CAST(greatest((30 + event_id % 71) / 100 * 10, 1) AS DOUBLE) AS w0 FROM x),
fw AS (SELECT *, CAST(floor(w0) AS BIGINT) AS w FROM fb),
bd AS (SELECT event_id, entity, signal_t, tp, CAST(unnest(range(10)) AS INT) AS detector, unnest(sc) AS score FROM fb)"""
_PERF = f"""{_FB}, pf0 AS (SELECT *, score > 0.5 AS hit, CASE WHEN row_number() OVER (PARTITION BY entity, detector ORDER BY signal_t DESC, event_id DESC) <= 100 THEN score END AS kept FROM bd),
pf AS (SELECT entity, detector, count(*) FILTER (tp AND hit) AS tp, count(*) FILTER (NOT tp AND hit) AS fp, count(*) FILTER (tp AND NOT hit) AS fn, count(*) FILTER (NOT tp AND NOT hit) AS tn, count(kept) AS n, var_pop(kept) AS v FROM pf0 GROUP BY ALL),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.5 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.5 ELSE tp / (tp + fn) END AS recall FROM pf),
pp AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""
_BETA = f"""WITH RECURSIVE {_PERF}, bn AS (SELECT *, (score > 0.5) = tp AS ok, row_number() OVER (PARTITION BY entity, detector ORDER BY signal_t, event_id) AS n FROM bd),
br AS (SELECT entity, detector, n, CASE WHEN ok THEN 2e0 ELSE 1e0 END AS alpha, CASE WHEN ok THEN 1e0 ELSE 2e0 END AS beta FROM bn WHERE n = 1 UNION ALL
  SELECT b.entity, b.detector, b.n, greatest(br.alpha * 0.98e0, 1e0) + CASE WHEN b.ok THEN 1 ELSE 0 END, greatest(br.beta * 0.98e0, 1e0) + CASE WHEN b.ok THEN 0 ELSE 1 END
  FROM br JOIN bn AS b ON b.entity = br.entity AND b.detector = br.detector AND b.n = br.n + 1),
bs AS (SELECT * FROM br QUALIFY row_number() OVER (PARTITION BY entity, detector ORDER BY n DESC) = 1),
bw AS (SELECT *, alpha / (alpha + beta) / sum(alpha / (alpha + beta)) OVER (PARTITION BY entity) AS weight FROM bs),
rw0 AS (SELECT entity, detector, 0.5 * weight + 0.5 * CASE WHEN sum(f1) OVER (PARTITION BY entity) > 0 THEN f1 / sum(f1) OVER (PARTITION BY entity) ELSE 0.1 END AS w FROM bw JOIN pp USING (entity, detector)),
rw AS (SELECT entity, detector, w / sum(w) OVER (PARTITION BY entity) AS weight FROM rw0)"""
_T = f"""{EVENTS}, tw AS (SELECT t // 86400 AS seq, 'a' || (t // 86400) AS anomaly_id, arg_max(t, (value, event_id)) - 3600 AS a, arg_max(t, (value, event_id)) + 3600 AS b FROM e GROUP BY t // 86400),
lg AS (SELECT event_id, t, detector AS service, CASE WHEN event_id % 40 = 0 THEN 'own' || (event_id % 7) END AS own_id, event_id % 3 != 0 AS flagged, value > 60 AS detected FROM e),
lt AS (SELECT *, coalesce(own_id, CASE WHEN flagged THEN (SELECT arg_min(anomaly_id, seq) FROM tw WHERE t BETWEEN a AND b AND (seq % 3 != 0 OR service IN ('click', 'error'))) END) AS truth_id FROM lg)"""
_LOG = f"""{EVENTS}, l0 AS (SELECT *, 'got ' || lower(lpad(to_hex(trace_id), 8, '0')) || '-0000-0000-00000000' || lower(lpad(to_hex(entity), 4, '0')) AS body FROM e)"""
_PT = f"""pt AS (SELECT CAST(vec_id AS VARCHAR) AS event_id, vec_id, {NOW - 864000} + vec_id * 600 AS t, CAST(label AS VARCHAR) AS group_key, list_transform(embedding, lambda y: CAST(y AS DOUBLE)) AS d,
  (vec_id * 37 % 100) / 100 AS confidence, (vec_id * 53 % 100) / 100 AS severity, (vec_id * 71 % 100) / 100 AS score FROM embeddings)"""
_MEMBERS = "array_to_string(members, ',') AS members, array_to_string(truth_ids, ',') AS truth_ids, array_to_string(run_ids, ',') AS run_ids"
_RULELOG = f"""{_W}, rg AS (SELECT rhythm, CAST(substr(rhythm, 2) AS INT) AS n, min(t) AS a FROM c WHERE rhythm LIKE 'r%' GROUP BY 1),
rl AS (SELECT rhythm, 'suppress' AS kind, 'set' AS change, a + n AS since, 86400 AS secs FROM rg UNION ALL SELECT rhythm, 'suppress', 'set', a + n * 86400, 864000 FROM rg UNION ALL SELECT rhythm, 'patch', 'set', a, NULL FROM rg
  UNION ALL SELECT rhythm, 'patch', 'lift', a + 1, NULL FROM rg WHERE n % 2 = 0),
rc AS (SELECT rhythm, kind, CASE WHEN kind = 'suppress' THEN since + secs END AS expires, change FROM rl QUALIFY row_number() OVER (PARTITION BY rhythm, kind ORDER BY since DESC, change DESC, secs DESC NULLS FIRST) = 1),
ra AS (SELECT rhythm, kind, expires FROM rc WHERE change = 'set')"""
_XB = _X.removeprefix(EVENTS)
_BODIES = f"""{_W}, bo AS (SELECT *, CAST(CASE WHEN i % 30 = 1 THEN t % 86400 * 1000000 ELSE CAST(t AS HUGEINT) END * CASE CASE WHEN i % 30 = 1 THEN 2 ELSE i % 3 END WHEN 0 THEN 1000000000 WHEN 1 THEN 1000 ELSE 1 END AS HUGEINT) AS stamp, CASE WHEN given IS NULL THEN 0 ELSE i END AS n FROM w WHERE i % 21 = 0),
bd AS (SELECT *, stamp % 16 AS b FROM bo)"""
SQL = {
    "signal_validation": f"""WITH {_BODIES} SELECT given AS event_id, CAST(stamp AS VARCHAR) AS timestamp, 'ok' AS reason FROM bd WHERE b != 7 AND n % 2 = 0 UNION ALL SELECT given, NULL, 'missing:score' FROM bd WHERE b != 7 AND n % 2 = 1
  UNION ALL SELECT NULL, NULL, 'no_signals' FROM (SELECT DISTINCT b FROM bd WHERE b = 7) AS q""",
    "dead_letters_latest": f"WITH {_BODIES} SELECT given AS event_id, 'missing:score' AS reason FROM bd WHERE b != 7 AND n % 2 = 1 ORDER BY given DESC LIMIT 5",
    "hash_vectors": """WITH t AS (SELECT doc_id, CAST(CAST('0x' || left(md5(lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))), 16) AS UBIGINT) AS BIT)::VARCHAR AS b FROM documents)
  SELECT doc_id, array_to_string(list_transform(range(64), lambda k: b[57 - 8 * (k // 8) + k % 8]), '') AS bits FROM t""",
    "reasons": f"""WITH {_X} SELECT event_id, CASE WHEN NOT anomaly THEN 'Normal behavior' ELSE format('{{}} anomaly (score: {{}}, confidence: {{}}%) - Primary: {{}} ({{}}%), Secondary: {{}} ({{}}%), {{}} detectors triggered',
  ['NONE', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][severity + 1], {_fixed('round(score, 4)', 2)}, CAST(floor(round(confidence, 4) * 100 + 0.5) AS INT), {_NAMES}[a1 + 1], CAST(floor(round(p1, 4) * 100 + 0.5) AS INT), {_NAMES}[a2 + 1], CAST(floor(round(p2, 4) * 100 + 0.5) AS INT), fired) END AS reason FROM x""",
    "feedback_scores": f"""WITH {_D}{_XB}, q AS (SELECT incident_id, unnest(members) AS m FROM d WHERE status IN ('escalated', 'merged')) SELECT incident_id AS pattern_id, m AS event_id, TRUE AS true_positive, anomaly FROM q JOIN x ON m = 'e' || x.event_id""",
    "vector_index": f"""WITH {_W}, k AS (SELECT DISTINCT 'rhythm=r' || (vec_id % 7) || ' det=' || (vec_id % 10) AS text FROM embeddings) SELECT event_id, 64 AS width, (confidence >= 0.9 OR severity >= 0.85) AND context IN (SELECT text FROM k) AS real FROM c""",
    "json_batches": f"WITH {EVENTS} SELECT CAST(entity AS VARCHAR) AS entity, value, t_ns FROM e WHERE (event_id // 50) % 9 != 8",
    "metric_priority": f"""WITH {EVENTS}, a AS (SELECT *, event_id AS i, list_filter([CASE WHEN event_id % 11 != 0 THEN 'status' END, CASE WHEN event_id % 2 = 0 THEN 'latency' END, CASE WHEN event_id % 3 = 0 THEN 'duration' END,
  CASE WHEN event_id % 5 = 0 THEN 'service' END, CASE WHEN event_id % 7 = 0 THEN 'bad' END], lambda y: y IS NOT NULL) AS a FROM e),
  b AS (SELECT *, CASE WHEN i % 11 = 0 THEN list_concat(['status'], a)[3:] ELSE a END AS k FROM a)
  SELECT event_id, CASE WHEN list_contains(k, 'duration') THEN value WHEN list_contains(k, 'latency') THEN value WHEN list_contains(k, 'status') THEN 200 ELSE 1 END::DOUBLE AS metric, CASE WHEN list_contains(k, 'service') THEN detector END AS service FROM b""",
    "canonical": f"WITH {_W} SELECT event_id, entity_hash, entity_id, t, score, severity, det AS detector, fired, confidence, rhythm, group_key, context, trace_id, run_id, truth_id, day FROM c",
    "batch_ids": f"WITH {_W} SELECT day, md5(count(*) || ':' || sum(('0x' || substr(md5(event_id || ':' || t), 1, 15))::HUGEINT) || ':' || sum(('0x' || substr(md5(event_id || ':' || t), 16, 15))::HUGEINT)) AS batch_id, count(*) AS events FROM c GROUP BY 1",
    "wire": f"WITH {_X} SELECT lower(lpad(to_hex(entity), 16, '0')) || '-' || t_ns || '-' || i AS event_id, 1 AS schema_version, CAST(entity AS VARCHAR) AS entity_hash, t_ns AS timestamp, round(score, 6) AS score, severity, a1 AS primary_detector, fired AS detectors_fired, round(confidence, 6) AS confidence, {_SC} FROM x",
    "slim": f"WITH {_X} SELECT 1 AS schema_version, CAST(entity AS VARCHAR) AS entity_hash, t_ns AS timestamp, round(score, 6) AS score, severity, round(confidence, 6) AS confidence, a1 AS primary_detector, fired AS detectors_fired, {_SC} FROM x",
    "legacy": f"WITH {_X} SELECT event_id, anomaly, round(score, 6) AS score, severity, a1 AS detector FROM x",
    "attribution": f"WITH {_X} SELECT event_id, a1 AS first, a2 AS second, round(p1, 6) AS first_share, round(p2, 6) AS second_share, fired, {_NAMES}[a1 + 1] AS name, a1 AS id FROM x",
    "ensemble_of_ten": f"WITH {_X} SELECT event_id, round(score, 6) AS score, round(confidence, 6) AS confidence, severity, anomaly, built FROM x",
    "run_lengths": f"""WITH {EVENTS}, q AS (SELECT event_id, value / 100 - 0.5e0 AS d FROM e) SELECT event_id, round(ln(CASE WHEN abs(d) < 0.001 THEN exp(8e0) ELSE greatest((exp(-8 * d) + 8 * d - 1) / (2 * d * d), 1) END), 6) AS log_length FROM q""",
    "entity_keys": f"WITH {_D} SELECT incident_id, {_KEYNUM} AS entity, coalesce(nullif(regexp_extract(entity_key, '^hash:(\\d+)$', 1), ''), '77') AS text FROM i",
    "payload_times": f"WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN t WHEN event_id % 3 = 0 THEN 0 ELSE 12.5 END::DOUBLE AS t FROM e",
    "relative_times": f"""WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 10 = 0 THEN {NOW} WHEN event_id % 2 = 0 AND event_id < 1000 THEN {NOW} + event_id WHEN event_id > 1000000 OR event_id BETWEEN 11 AND 1000 THEN event_id
  WHEN event_id > 1000 THEN event_id * 1000000 ELSE event_id * 1000000000 END AS t FROM e""",
    "percents": f"WITH {EVENTS} SELECT event_id, CAST(floor(value / 1000 * 100 + 0.5) AS INT) AS percent FROM e",
    "linear_bin": f"WITH {EVENTS} SELECT event_id, CAST(least(greatest(floor((value - 10) / 90 * 20), 0), 19) AS INT) AS bin FROM e",
    "gaps": f"""WITH {EVENTS}, g AS (SELECT event_id, greatest(t_ns - lag(t_ns) OVER (PARTITION BY entity ORDER BY t, event_id), 0) AS gap, lag(t_ns) OVER (PARTITION BY entity ORDER BY t, event_id) AS p FROM e)
  SELECT event_id, CASE WHEN p IS NULL THEN 0 ELSE gap END / 1e6 AS gap_ms, round(1e9 / greatest(CASE WHEN p IS NULL THEN 0 ELSE gap END, 1), 9) AS rate FROM g""",
    "trend_word": f"""WITH {EVENTS} SELECT event_id, CASE WHEN count(*) OVER w < 2 THEN 'anomaly' WHEN value > first_value(value) OVER w THEN 'spike' ELSE 'drop' END AS trend FROM e WINDOW w AS (PARTITION BY entity ORDER BY t, event_id ROWS 4 PRECEDING)""",
    "windowed_text": f"WITH {_W} SELECT event_id, day, t, context FROM c WHERE t BETWEEN {NOW - 20 * 86400} AND {NOW - 10 * 86400} AND list_contains(regexp_split_to_array(lower(context), '\\W+'), 'det') AND list_contains(regexp_split_to_array(lower(context), '\\W+'), '3')",
    "day_list": f"""WITH {EVENTS}, q AS (SELECT entity, min(t) AS a, least(max(t), min(t) + 400000) AS b FROM e GROUP BY 1)
  SELECT entity, array_to_string(list_transform(range(a // 86400, b // 86400 + 1), lambda y: strftime(make_timestamp(y * 86400000000), '%Y_%m_%d')), ',') AS days FROM q""",
    "cluster_hits": f"WITH {_W} SELECT day, group_key, event_id, t, cnt AS count FROM h",
    "cluster_firsts": f"WITH {_W} SELECT group_key AS key, event_id, t FROM c QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY t, event_id) = 1 ORDER BY t, event_id LIMIT 200",
    "cluster_scored": f"""WITH {_W}, q0 AS (SELECT *, row_number() OVER (PARTITION BY day, group_key ORDER BY score DESC, event_id) AS rk2 FROM c WHERE score >= 0.15 QUALIFY rk2 <= 3), q1 AS (SELECT *, count(*) OVER (PARTITION BY day, group_key) AS n FROM q0),
  q2 AS (SELECT * FROM q1 WHERE rk2 = 1 QUALIFY row_number() OVER (PARTITION BY day ORDER BY score DESC, event_id) <= 100), q3 AS (SELECT * FROM q2 QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY day) = 1)
  SELECT day, group_key, event_id, score, n AS count FROM q3 ORDER BY day, score DESC, event_id LIMIT 200""",
    "triage": f"""WITH {_PT}, tg AS (SELECT list_transform(range(1, 65), lambda k: 2 * list_avg(list_transform(p, lambda y: y[k])) - list_avg(list_transform(n, lambda y: y[k]))) AS g
  FROM (SELECT list(d) FILTER (vec_id IN (3, 14, 15)) AS p, list(d) FILTER (vec_id IN (9, 26)) AS n FROM pt)),
  sc AS (SELECT event_id, group_key, list_dot_product(d, g) / sqrt(list_dot_product(d, d)) / sqrt(list_dot_product(g, g)) AS score FROM pt, tg WHERE vec_id NOT IN (3, 14, 15, 9, 26))
  SELECT event_id, group_key, round(score, 6) AS score FROM (SELECT * FROM sc WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY score DESC, event_id) <= 3) AS q ORDER BY q.score DESC, event_id LIMIT 50""",
    "refined": f"""WITH {_PT}, hh AS (SELECT * FROM pt WHERE vec_id % 5 = 0), gd AS (SELECT d, row_number() OVER (ORDER BY t, event_id) AS k FROM hh WHERE confidence >= 0.85 OR severity >= 0.8 OR score >= 0.9),
  bd AS (SELECT d, row_number() OVER (ORDER BY t, event_id) AS k FROM hh WHERE confidence <= 0.4 AND severity <= 0.5 AND score <= 0.7), pr AS (SELECT gd.d AS g, bd.d AS b FROM gd JOIN bd USING (k) WHERE k <= 8),
  sc AS (SELECT event_id, t, (SELECT sum(least(0, list_cosine_similarity(hh.d, g) - list_cosine_similarity(hh.d, b))) FROM pr) AS score FROM hh)
  SELECT event_id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, t, event_id LIMIT 100""",
    "case_candidates": f"WITH {_W}, q AS ({_cand('c')}) SELECT incident_id, reason, confidence, entity_key, {_MEMBERS}, first_seen, last_seen, severity_max, score_max FROM q",
    "seed_candidates": f"WITH {_D} SELECT incident_id, reason, confidence, entity_key, {_MEMBERS}, first_seen, last_seen, severity_max, score_max FROM sd",
    "case_decisions": f"WITH {_D} SELECT incident_id, members[1] AS member, reason, status, why, confidence_pct, severity_pct, score_pct FROM d",
    "cases": f"WITH {_D} SELECT incident_id, status, entity_key, first_seen, last_seen, severity_pct, score_pct, confidence_pct, {_MEMBERS}, reason FROM i",
    "cases_merged": f"""WITH {_D}, g AS (SELECT incident_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, max(severity_pct) AS severity_pct, max(score_pct) AS score_pct, list_sort(list_distinct(flatten(list(members)))) AS members,
  list_sort(list_distinct(flatten(list(truth_ids)))) AS truth_ids, list_sort(list_distinct(flatten(list(run_ids)))) AS run_ids FROM d GROUP BY 1)
  SELECT incident_id, status, entity_key, g.first_seen, g.last_seen, g.severity_pct, g.score_pct, confidence_pct, array_to_string(g.members, ',') AS members, array_to_string(g.truth_ids, ',') AS truth_ids, array_to_string(g.run_ids, ',') AS run_ids, reason FROM i JOIN g USING (incident_id)""",
    "case_edges": f"WITH {_D} SELECT incident_id, unnest(members) AS point_id, reason AS link_type, CAST(floor(confidence * 100 + 0.5) AS INT) AS confidence FROM fh",
    "case_graph": f"WITH {_D} SELECT incident_id, unnest(members) AS point_id, reason AS link_type, CAST(floor(confidence * 100 + 0.5) AS INT) AS confidence FROM sd WHERE incident_id LIKE 'gt_%'",
    "case_feedback": f"""WITH {_D} SELECT incident_id AS pattern_id, nullif(regexp_extract(entity_key, '^hash:(\\d+)$', 1), '') AS entity_hash_text, entity_key AS entity_id, last_seen AS signal_t, TRUE AS true_positive,
  'true_positive' AS label, confidence, greatest(0, {NOW}000 - last_seen * 1000) AS latency_ms FROM d WHERE status IN ('escalated', 'merged')""",
    "case_with_decisions": f"""WITH {_D}, q AS (SELECT incident_id, status, row_number() OVER (PARTITION BY incident_id ORDER BY grp DESC, first_seen DESC, members[1] DESC) AS k FROM d QUALIFY k <= 3)
  SELECT incident_id, CAST(count(*) AS INT) AS n, string_agg(status, ',' ORDER BY k) AS statuses FROM q GROUP BY 1""",
    "cases_of_run": f"WITH {_D} SELECT incident_id, last_seen FROM i WHERE list_contains(run_ids, 'run1') ORDER BY last_seen DESC, incident_id LIMIT 40",
    "case_quality": f"""WITH {_D}, q AS (SELECT * FROM i WHERE list_contains(run_ids, 'run1')), t1 AS (SELECT unnest(truth_ids) AS truth_id, incident_id FROM q), t2 AS (SELECT truth_id, count(DISTINCT incident_id) AS n FROM t1 GROUP BY 1),
  k AS (SELECT count(*) FILTER (len(truth_ids) > 0) AS tp, count(*) FILTER (len(truth_ids) = 0) AS fp, count(*) FILTER (len(truth_ids) > 1) AS mg, count(*) FILTER (status = 'escalated') AS es, count(*) FILTER (status = 'escalated' AND len(truth_ids) > 0) AS et FROM q),
  z AS (SELECT *, (SELECT count(DISTINCT truth_id) FROM c) AS truths, (SELECT count(*) FROM t2) AS cov, (SELECT count(*) FROM t2 WHERE n > 1) AS sp FROM k),
  y AS (SELECT *, greatest(truths - cov, 0) AS fn FROM z), u AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM y)
  SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(coalesce(mg / nullif(tp, 0), 0), 6) AS merge_error, round(coalesce(sp / nullif(truths, 0), 0), 6) AS split_error,
  round(coalesce(et / nullif(es, 0), 0), 6) AS escalation_quality FROM u""",
    "rules": f"WITH {_J} SELECT pattern_id, action, array_to_string(entities, ',') AS entities, detector, min_confidence, score_scale, confidence_scale, ttl, created, rule FROM ({_ruled(250)}) AS q",
    "rule_index": f"""WITH {_R} SELECT rule, 'entity' AS found_by, unnest(entities) AS entity, detector, CASE WHEN ttl > 0 THEN created + ttl END AS ends FROM ru WHERE len(entities) > 0
  UNION ALL SELECT rule, 'detector', NULL, detector, CASE WHEN ttl > 0 THEN created + ttl END FROM ru WHERE detector IS NOT NULL UNION ALL SELECT rule, 'any', NULL, detector, CASE WHEN ttl > 0 THEN created + ttl END FROM ru WHERE detector IS NULL AND len(entities) = 0""",
    "policy_effects": f"WITH {_R} SELECT event_id, round(product(s), 6) AS score_scale, round(product(k), 6) AS confidence_scale, bool_or(action = 'suppress') AS suppress FROM m GROUP BY 1",
    "policy_last": f"WITH {_R}, q AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY probe DESC, rule DESC) = 1) SELECT event_id, round(s, 6) AS score_scale, round(k, 6) AS confidence_scale, action = 'suppress' AS suppress FROM q",
    "policy_drafts": f"WITH {_P} SELECT * FROM dr",
    "policy_published": f"WITH {_P} SELECT * REPLACE (CASE WHEN version = 'policy-250' THEN 'active' ELSE 'draft' END AS status) FROM dr",
    "policy_rolled_back": f"""WITH {_P} SELECT * FROM dr UNION ALL SELECT 'policy-50-rollback-{NOW + 999}', 'active', rule_count, {NOW + 999}, 'policy-50' FROM dr WHERE version = 'policy-50'""",
    "policy_current": f"WITH {_P} SELECT * REPLACE ('active' AS status) FROM dr WHERE version = 'policy-100'",
    "policy_history": f"WITH {_P} SELECT * FROM dr ORDER BY compiled DESC, version DESC LIMIT 2",
    "active_rules": f"WITH {_RULELOG} SELECT * FROM ra WHERE expires IS NULL OR expires > {NOW - 15 * 86400}",
    "ruled_out": f"WITH {_RULELOG} SELECT event_id, rhythm, t FROM c WHERE NOT EXISTS (SELECT 1 FROM ra WHERE ra.rhythm = c.rhythm AND (expires IS NULL OR c.t < expires))",
    "truth_windows_joined": f"WITH {_T} SELECT event_id, truth_id FROM lt",
    "truth_diagnostics": f"WITH {_T} SELECT count(*) FILTER (flagged) AS flagged, count(truth_id) AS with_id, count(truth_id) FILTER (detected) AS detected_with_id, count(DISTINCT truth_id) AS ids_seen, (SELECT count(*) FROM tw) AS ids_expected FROM lt",
    "anomaly_breakdown": f"""WITH {_T}, q AS (SELECT truth_id, count(*) AS n, count(*) FILTER (detected) AS k FROM lt GROUP BY 1)
  SELECT anomaly_id, coalesce(n, 0) AS events, coalesce(k, 0) AS found, coalesce(n - k, 0) AS missed, round(coalesce(k / n, 0), 6) AS recall FROM tw LEFT JOIN q ON truth_id = anomaly_id""",
    "confusion_by_score": f"""WITH {_X}, u AS (SELECT value > 100 AS truth, CAST(unnest(range(10)) AS INT) AS detector, unnest(f) AS hit, unnest(sc) AS sc FROM x)
  SELECT detector, count(*) FILTER (truth AND hit) AS tp, count(*) FILTER (NOT truth AND hit) AS fp, count(*) FILTER (truth AND NOT hit) AS fn, count(*) FILTER (NOT truth AND NOT hit) AS tn, count(*) FILTER (hit) AS triggers,
  round(coalesce(sum(CAST(round(sc * 100) AS BIGINT)) FILTER (hit) / 100 / nullif(count(*) FILTER (hit), 0), 0), 6) AS mean_score FROM u GROUP BY 1""",
    "confusion_report": f"""WITH {_X}, u AS (SELECT value > 100 AS truth, CAST(unnest(range(10)) AS INT) AS detector, unnest(f) AS hit FROM x), k AS (SELECT detector, CASE WHEN truth AND hit THEN 'tp' WHEN hit THEN 'fp' WHEN truth THEN 'fn' ELSE 'tn' END AS metric FROM u),
  g AS (SELECT detector, metric FROM (SELECT DISTINCT detector FROM k), (SELECT unnest(['tp', 'fp', 'fn', 'tn']) AS metric)) SELECT detector, metric, (SELECT count(*) FROM k WHERE k.detector = g.detector AND k.metric = g.metric)::DOUBLE AS value FROM g""",
    "rounded_percentiles": f"WITH {EVENTS}, r AS (SELECT detector, value, row_number() OVER (PARTITION BY detector ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY detector) AS n FROM e) SELECT detector, {', '.join(f'max(value) FILTER (r = floor((n - 1) * {p} / 100 + 0.5)) AS p{p}' for p in (50, 95, 99))} FROM r GROUP BY 1",
    "windowed_quality": f"""WITH {_X}, tr AS (SELECT t, value > 60 AS a FROM e WHERE t >= {NOW - 20 * 86400}), de AS (SELECT DISTINCT t FROM x WHERE event_id % 2 = 0 AND anomaly AND t >= {NOW - 20 * 86400}),
  j AS (SELECT a, EXISTS (SELECT 1 FROM de WHERE abs(de.t - tr.t) < 2) AS met FROM tr), k AS (SELECT count(*) FILTER (a AND met) AS tp, count(*) FILTER (NOT a AND met) AS fp, count(*) FILTER (a AND NOT met) AS fn FROM j),
  z AS (SELECT coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM k)
  SELECT {NOW}::BIGINT AS at, CAST(floor(p * 100 + 0.5) AS INT) AS precision, CAST(floor(r * 100 + 0.5) AS INT) AS recall, CAST(floor(coalesce(2 * p * r / nullif(p + r, 0), 0) * 100 + 0.5) AS INT) AS f1, 'sim' AS scenario FROM z""",
    "truth_seconds": f"""WITH {_D}, tw AS (SELECT arg_max(t, (value, e.event_id)) - 3600 AS a, arg_max(t, (value, e.event_id)) + 3600 AS b FROM e GROUP BY t // 86400), se AS (SELECT DISTINCT last_seen AS t FROM i),
  q AS (SELECT t, EXISTS (SELECT 1 FROM tw WHERE t BETWEEN a AND b) AS truth, EXISTS (SELECT 1 FROM se WHERE se.t = s.t) AS detected FROM range({NOW - 2 * 86400}, {NOW - 86400}) AS s(t)) SELECT * FROM q WHERE truth OR detected""",
    "run_summary": f"WITH {_X} SELECT count(*) AS events, max(t) - min(t) AS seconds, round(count(*) / (max(t) - min(t)), 9) AS per_second, count(*) FILTER (anomaly) AS anomalies, count(DISTINCT entity) AS profiles, count(*) FILTER (value > 100) AS truth_events FROM x",
    "counters": f"WITH {_X} SELECT CASE WHEN event_id % 17 = 0 THEN 'dropped' WHEN anomaly THEN 'anomalies' ELSE 'ingested' END AS outcome, count(*) AS n FROM x GROUP BY 1",
    "version_metrics": f'WITH {_X} SELECT event_id % 3 AS version, t // 86400 AS "window", count(*) AS events, count(*) FILTER (anomaly) AS anomalies, count(*) FILTER (anomaly AND value > 100) AS true_positives FROM x GROUP BY 1, 2',
    "diversity": f"WITH {EVENTS} SELECT entity, count(DISTINCT detector) AS exact, TRUE AS near FROM e GROUP BY 1",
    "frequencies": f"WITH {EVENTS} SELECT entity, trace_id, count(*) AS n FROM e WHERE trace_id IS NOT NULL GROUP BY 1, 2",
    "count_min": f"WITH {EVENTS} SELECT entity, trace_id, count(*) AS n, TRUE AS bounded FROM e WHERE trace_id IS NOT NULL GROUP BY 1, 2",
    "log_lines": f"WITH {EVENTS} SELECT event_id AS line_no, CAST(t AS VARCHAR) AS unix_ts, '2024.01.01' AS date, 'R' || entity AS node, 'dev' AS device, 'RAS' AS component, 'KERNEL' AS sub_component, CASE WHEN event_id % 2 = 0 THEN 'INFO' ELSE 'FATAL' END AS level, 'a message' AS message FROM e WHERE entity % 4 = 1",
    "log_schemas": f"""WITH {_LOG}, q AS (SELECT 's' || entity AS source, arg_min(t, event_id) AS t, arg_min(detector, event_id) AS detector, arg_min(body, event_id) AS body, entity % 4 AS k FROM l0 GROUP BY entity)
  SELECT source, 'timestamp|datetime|' || CASE k WHEN 0 THEN t || '000000000' WHEN 1 THEN 'unix_ts' ELSE '' END || ';level|keyword|' || CASE k WHEN 0 THEN 'INFO' WHEN 1 THEN 'level' ELSE '' END || ';service|keyword|' || CASE k WHEN 0 THEN detector WHEN 1 THEN 'node' ELSE '' END
  || ';message|string|' || CASE k WHEN 0 THEN body WHEN 1 THEN 'message' ELSE '' END AS fields FROM q WHERE k < 3""",
    "log_profile": f"WITH {_LOG} SELECT detector AS service, CASE WHEN event_id % 4 = 0 THEN 'ERROR' ELSE 'INFO' END AS level, count(*) AS frequency, count(*) AS cardinality FROM l0 WHERE entity % 4 = 2 GROUP BY 1, 2",
    "schema_registry": f"WITH {EVENTS} SELECT 's' || entity AS source, CASE WHEN count(*) FILTER (event_id % 3 = 0) > 0 THEN 2 ELSE 1 END AS saved, 4 AS n FROM e WHERE entity % 4 < 3 AND (event_id % 2 = 0 OR event_id % 3 = 0) GROUP BY entity",
    "feedback_stats": f"""WITH {_FB}, k AS (SELECT count(*) AS processed, count(*) FILTER (tp AND anomaly) AS tp, count(*) FILTER (NOT tp AND anomaly) AS fp, count(*) FILTER (tp AND NOT anomaly) AS fn FROM fb), z AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 1) AS p, coalesce(tp / nullif(tp + fn, 0), 1) AS r FROM k)
  SELECT processed, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * (p * r) / nullif(p + r, 0), 0), 6) AS f1 FROM z""",
    "feedback_matched": f"WITH {EVENTS}, k AS (SELECT DISTINCT entity FROM e WHERE event_id % 10 = 0) SELECT count(*) FILTER (entity IN (SELECT entity FROM k)) AS matched, count(*) FILTER (entity NOT IN (SELECT entity FROM k)) AS missed FROM e",
    "feedback_entities": f"WITH {_D}, q AS (SELECT {_KEYNUM} AS ent FROM d WHERE status IN ('escalated', 'merged')) SELECT ent IS NOT NULL AS accepted, count(*) AS n, count(DISTINCT ent) AS entities FROM q GROUP BY 1",
    "learning_totals": f"""WITH {_FB}, u AS (SELECT w, tp, CAST(unnest(range(10)) AS INT) AS detector, unnest(sc) AS s FROM fw) SELECT detector, CAST(sum(CASE WHEN (s >= 0.5) = tp THEN w ELSE 0 END) AS BIGINT) AS success, CAST(sum(CASE WHEN (s >= 0.5) = tp THEN 0 ELSE w END) AS BIGINT) AS failure FROM u GROUP BY 1""",
    "learning_significant": f"""WITH {_FB}, k AS (SELECT entity, CAST(sum(CASE WHEN tp AND anomaly THEN w ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN NOT tp AND anomaly THEN w ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN tp AND NOT anomaly THEN w ELSE 0 END) AS BIGINT) AS fn FROM fw GROUP BY 1)
  SELECT *, tp + fp + fn > 0 AS significant FROM k""",
    "detector_performance": f"WITH {_PERF} SELECT entity, detector, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(CASE WHEN n < 2 THEN 1 ELSE greatest(v, 0.001) END, 6) AS score_variance FROM pp",
    "bandit_states": f"{_BETA} SELECT entity, detector, n, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM bs",
    "bandit_weights": f"{_BETA} SELECT entity, detector, round(weight, 6) AS weight FROM bw",
    "refreshed_weights": f"{_BETA} SELECT entity, detector, round(weight, 6) AS weight FROM rw",
    "profile_snapshots": f"{_BETA} SELECT entity, detector, n, round(rw.weight, 6) AS weight, round(alpha, 6) AS alpha FROM bs JOIN rw USING (entity, detector)",
    "profile_baseline": recursion("entity", {"s": "v", "q": "v * v"}, {"s_": "s + v", "q_": "q + v * v"})
    + " SELECT event_id, rn AS age, s / rn AS mean, sqrt(greatest(q / rn - (s / rn) * (s / rn), 0)) AS std, rn < 100 AS warmup FROM r",
    "profile_store": f"WITH {EVENTS}, k AS (SELECT entity, count(*) AS n FROM e GROUP BY 1) SELECT count(*) AS profiles, count(*) FILTER (n >= 50) AS mature, CAST(sum(n) AS BIGINT) AS accesses FROM k",
    "sparse_terms": f"""WITH t AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+') AS w FROM documents), u AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM t), k AS (SELECT doc_id, n, word, count(*) AS c FROM u GROUP BY ALL)
  SELECT doc_id, CAST('0x' || left(md5(word), 8) AS BIGINT) % 16384 AS bucket, round(count(*) + sum(c) / max(n), 9) AS weight FROM k GROUP BY 1, 2""",
    "resized": "SELECT vec_id, 3 AS n3, 80 AS n80, 0.0::DOUBLE AS last, embedding[3]::DOUBLE AS third FROM embeddings",
}
