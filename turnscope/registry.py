"""Every registered query: a name and a plan over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.functions import text as X
from turnscope.functions import vocab as V
from turnscope.operators import coverage, labels, linegrain, oplog, reduction, routing, rules, shape, state, trace, verdicts
from turnscope.session import materialize
from turnscope.sources import catalogue as C
from turnscope.sources import raw, views
from turnscope.streaming import jobs


class Tables:
    """The inputs of one run, planned on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.lines_shared = False

    @cached_property
    def log(self) -> DataFrame:
        return views.session_log(self.spark, self.sf_dir)

    @cached_property
    def messages(self) -> DataFrame:
        return state.messages(self.log)

    @cached_property
    def inputs(self) -> rules.Inputs:
        return rules.Inputs(
            self.log, views.known_refs(self.messages), views.url_probes(self.log), C.params_of(self.catalogue))

    def share(self) -> Tables:
        """For queries with many branches: write the marked log once instead of deriving it each
        time."""
        if not state.is_marked(self.log):
            self.log = materialize(state.marked(self.log), "log", "kind")
        return self

    def own_messages(self) -> DataFrame:
        """For queries that read nothing else of the log: the messages, written once unless the marked log is."""
        return self.messages if state.is_marked(self.log) else materialize(self.messages, "messages")

    @cached_property
    def fires(self) -> DataFrame:
        """Fires written once: routing, labels and statistics read them many times."""
        return materialize(rules.evaluate(self.share().inputs), "fires")

    @cached_property
    def first_fires(self) -> DataFrame:
        return materialize(rules.first_cause(self.fires, C.deduped_rules()), "causes")

    @cached_property
    def causes(self) -> DataFrame:
        """First fires as the labels read them: the wording only where it decides. Each rule is evaluated once, so its
        fires are not written before."""
        fires = rules.bare(rules.evaluate(self.share().inputs), detail=("R07",), subject=("R05", "R06"))
        return materialize(rules.first_cause(fires, C.deduped_rules()), "causes", "rule")

    @cached_property
    def facts(self) -> DataFrame:
        return materialize(state.state_facts(self.share().log), "facts")

    @cached_property
    def active(self) -> DataFrame:
        return materialize(trace.active_rules(self.share().inputs), "active")

    @cached_property
    def desync(self) -> DataFrame:
        return views.desync_verdicts(self.messages)

    @cached_property
    def markers(self) -> DataFrame:
        return verdicts.markers(self.desync)

    @cached_property
    def directives(self) -> DataFrame:
        return views.directive_verdicts(self.messages)

    @cached_property
    def label_rows(self) -> DataFrame:
        return views.hand_labels(self.messages)

    @cached_property
    def catalogue(self) -> DataFrame:
        return C.packaged(self.spark)

    @cached_property
    def labelled(self) -> DataFrame:
        fires = self.causes  # shares the log before the other inputs are planned
        return labels.labelled_fires(fires, self.messages, verdicts.marked_keys(self.desync), self.label_rows)

    @cached_property
    def listed(self) -> DataFrame:
        """The fires that are listed, labelled. They are chosen from all causes by their place alone, so only they are
        written and labelled."""
        fires = rules.bare(rules.evaluate(self.share().inputs), detail=("R07",), subject=("R05", "R06"))
        few = materialize(labels.listed(rules.first_cause(fires, C.deduped_rules())).drop("n"), "listed")
        return labels.labelled_some(few, self.messages, verdicts.marked_keys(self.desync), self.label_rows)

    @cached_property
    def precision(self) -> DataFrame:
        return labels.precision_table(self.labelled)

    @cached_property
    def refreshed(self) -> DataFrame:
        """The catalogue with this run's results."""
        return materialize(C.with_metrics(self.catalogue, self.precision), "catalogue")

    @cached_property
    def routed(self) -> DataFrame:
        return routing.fire_routing(self.fires, self.catalogue)

    @cached_property
    def asks(self) -> DataFrame:
        """Routed fires of the rules that may ask. No other fire counts against the budget or waits for a verdict."""
        may_ask = rules.evaluate(self.share().inputs, C.asking_rules(self.catalogue))
        return routing.fire_routing(materialize(rules.bare(may_ask), "asks"), self.catalogue)

    @cached_property
    def fire_log(self) -> DataFrame:
        routed = self.routed  # shares the log before it is read again
        return routing.fire_log(routed, self.log)

    @cached_property
    def counted_log(self) -> DataFrame:
        """The fire log for those who count it: without wording."""
        fires = materialize(rules.bare(rules.evaluate(self.share().inputs)), "fires", "rule")
        return routing.fire_log(routing.fire_routing(fires, self.catalogue), self.log)

    @cached_property
    def normalise(self) -> DataFrame:
        return views.normalise_log(self.log)

    @cached_property
    def turns(self) -> DataFrame:
        return verdicts.previous_turns(self.log)

    # ---- raw lines

    @cached_property
    def lines(self) -> DataFrame:
        return shape.ordered_events(views.parsed_transcript(self.spark, self.sf_dir))

    def share_lines(self) -> Tables:
        """For queries that read several kinds of line: write the ordered lines once."""
        if not self.lines_shared:
            self.lines, self.lines_shared = materialize(self.lines, "lines"), True
        return self

    @cached_property
    def calls(self) -> DataFrame:
        return shape.tool_calls(self.lines)

    @cached_property
    def results(self) -> DataFrame:
        return shape.tool_results(self.lines)

    @cached_property
    def notes(self) -> DataFrame:
        return shape.task_notifications(self.lines)

    # ---- captures

    @cached_property
    def captures(self) -> DataFrame:
        return views.captures(self.spark, self.sf_dir)

    @cached_property
    def index(self) -> DataFrame:
        return materialize(reduction.reduction_index(self.captures), "index")

    @cached_property
    def store(self) -> DataFrame:
        return reduction.reduced_store(self.index, self.captures)

    @cached_property
    def line_store(self) -> linegrain.LineStore:
        return linegrain.of_captures(self.index, self.captures)

    @cached_property
    def files(self) -> DataFrame:
        return views.capture_files(self.captures)


def shown(fires: DataFrame) -> DataFrame:
    return fires.select("sid", "idx", "rule", "key", "why", "detail", F.array_join("subject", " ").alias("subject"))


def rule_query(rule: str) -> Callable[[Tables], DataFrame]:
    many_passes = rule in ("R01", "R02", "R04", "R12")
    return lambda t: shown(rules.RULES[rule]((t.share() if many_passes else t).inputs))


def label_r10(t: Tables) -> DataFrame:
    msgs = t.own_messages()
    return labels.label_r10(rules.first_cause(rules.bare(rules.open_ended(msgs)), C.deduped_rules()), msgs)


def runs_summary(runs: DataFrame, *names: str) -> DataFrame:
    return runs.groupBy("sid", *names).agg(
        F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"),
        F.sum(F.col("last_idx") - F.col("first_idx") + 1).alias("messages"),
    )


def index_rows(index: DataFrame) -> DataFrame:
    return index.select(
        "sid", "count", "event", "bytes", "epoch", "in_flight", "is_base", "source", "sha256",
        F.col("lines").cast("long").alias("lines"), "prefix_mismatch",
    )


def partial_index(t: Tables) -> DataFrame:
    """The index as it was before each fifth session's last capture arrived."""
    late = F.expr("cast(split(sid, '-')[0] as bigint) % 5 = 0") & (F.col("count") >= 4)
    return t.index.where(~late)


def grown_index(t: Tables) -> DataFrame:
    """The index of all captures, made in two runs: the second reads only what came after the third of each session."""
    early, late = t.captures.where("count <= 3"), t.captures.where("count > 3")
    index = materialize(reduction.reduction_index(early), "early-index")
    return index_rows(reduction.extend_index(index, reduction.reduced_store(index, early), late))


def tampered_index(t: Tables) -> DataFrame:
    """An index with some digests, lengths and sources spoiled, to see that checks notice."""
    conv = F.expr("cast(split(sid, '-')[0] as bigint)")
    return t.index.select(
        *[c for c in t.index.columns if c not in ("sha256", "source", "bytes")],
        F.when((conv % 10 == 1) & (F.col("count") == 1), F.concat(F.lit("0"), F.substring("sha256", 2, 63)))
        .otherwise(F.col("sha256")).alias("sha256"),
        F.when((conv % 10 == 2) & (F.col("count") == 2), "odd").otherwise(F.col("source")).alias("source"),
        F.when((conv % 10 == 3) & (F.col("count") == 1), F.col("bytes") + 1_000_000).otherwise(F.col("bytes")).alias("bytes"),
    )


def check_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("source", F.coalesce("failure", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


def compaction_rows(t: Tables) -> DataFrame:
    captures = views.compaction_captures(t.spark, t.sf_dir)
    index = reduction.reduction_index(captures)
    return reduction.compaction_annotations(index, reduction.reduced_store(index, captures)).select(
        "sid", "line_index", "pre_tokens", "post_tokens", "dropped_tokens", "duration_ms",
        "preserved", "resolved", "unresolved")


def stale_sessions(t: Tables) -> DataFrame:
    logs = views.event_logs(t.captures)
    return reduction.staleness(
        partial_index(t), t.captures.where("content IS NOT NULL").select("sid", "count"),
        views.event_log_copies(logs), logs,
    )


def identity(t: Tables) -> DataFrame:
    return shape.task_identity(t.calls, t.results, t.notes)


def endings(t: Tables) -> DataFrame:
    return shape.task_endings(t.calls, t.results, identity(t))


def document_tokens(t: Tables) -> DataFrame:
    docs = views.table(t.spark, t.sf_dir, "documents")
    toks = X.tokens("text")
    return docs.select("doc_id", F.size(toks).alias("n_tokens"), F.sha1(F.array_join(toks, " ")).alias("digest"))


def page_urls(t: Tables) -> DataFrame:
    pages = views.table(t.spark, t.sf_dir, "pages")
    return pages.select("page_id", F.explode(X.references(F.concat_ws(" ", "url", "html"), V.URL)).alias("url"))


SOURCES: dict[str, Callable[[Tables], DataFrame]] = {
    "scan_capture_events": lambda t: raw.scan_capture_events(t.spark, jobs.write_event_lines(t.spark, t.captures)).select(
        "sid", "count", "event", "captured_at", "snapshot_bytes", "payload"),
    "scan_transcript_lines": lambda t: raw.scan_transcript_lines(
        t.spark, jobs.write_lines(t.spark, views.transcript_lines(t.spark, t.sf_dir))
    ).groupBy(raw.variant("v", "$.type", "string").alias("type")).agg(F.count("*").alias("lines")),
    "scan_snapshots": lambda t: raw.snapshot_names(t.files).select("sid", "count", "snapshot", F.col("length").alias("bytes")),
    "discover_sessions": lambda t: raw.discover_sessions(t.files),
    "capture_catalog": lambda t: reduction.capture_catalog(
        views.capture_event_rows(t.captures), views.capture_lengths(t.captures)
    ).select("sid", "count", "event", "snapshot", "bytes", "exists"),
    "scan_catalogue": lambda t: jobs.catalogue_roundtrip(t.spark, t.refreshed).select(
        "rule", "action", "suspended", "precision", "basis", "refuted", "hand_labelled", "template"),
    "sink_append_log": lambda t: jobs.append_and_read(t.spark, t.fire_log),
    "sink_catalogue_metrics": lambda t: t.refreshed.select(
        "rule", "action", "suspended", "precision", "basis", "refuted", "hand_labelled", "template"),
}

SHAPE: dict[str, Callable[[Tables], DataFrame]] = {
    "ordered_events": lambda t: t.lines.groupBy("sid").agg(
        F.count("*").alias("lines"), F.max("seq").alias("last_seq"), F.max("ts").alias("last_ts")),
    "human_messages": lambda t: shape.human_messages(t.lines).select("sid", "ts", "text", "cwd"),
    "tool_calls": lambda t: t.calls.select("sid", "ts", "id", "name", "kind", "task_id"),
    "tool_results": lambda t: t.results.select("sid", "ts", "tool_use_id", "is_error", "body"),
    "queue_operations": lambda t: shape.queue_operations(t.lines).select("sid", "ts", "op", "content", "human"),
    "task_notifications": lambda t: t.notes.select("sid", F.col("when").alias("ts"), "tool_use_id", "task_id"),
    "task_identity": lambda t: identity(t.share_lines()).select("sid", "task_id", "launch").distinct(),
    "task_endings": lambda t: endings(t.share_lines()).select("sid", "ts", "launch"),
    "questions_asof": lambda t: runs_summary(state.question_versions(t.log), "question", "outcome"),
    "denials": lambda t: shape.denials(t.lines).select("sid", "ts", "kind"),
    "api_errors": lambda t: shape.api_errors(t.lines).select("sid", "ts"),
    "self_injection_guard": lambda t: shape.self_injection_guard(t.lines).groupBy(
        raw.variant("v", "$.type", "string").alias("type")).agg(F.count("*").alias("lines")),
    "allowed_tools": lambda t: shape.allowed_tools(t.lines).select("sid", F.array_join("tools", ",").alias("tools")),
    "message_keys": lambda t: t.messages.select(
        "sid", "idx", X.message_id("sid", "idx").alias("id"), X.message_key("sid", "text").alias("key")),
    "message_tokens": document_tokens,
    "references_extracted": lambda t: t.messages.select(
        "sid", "idx", *[F.array_join(X.references("text", p), "|").alias(n) for n, p in
                        (("urls", V.URL), ("paths", V.PATH), ("repos", V.REPO), ("endpoints", V.ENDPOINT))]),
    "page_urls": page_urls,
    "previous_turn": lambda t: t.turns.select("sid", "idx", "key", "previous"),
    "systematic_sample": lambda t: verdicts.systematic_sample(t.messages).select("sid", "idx", "pos"),
    "judgement_requests": lambda t: verdicts.judgement_requests(t.turns),
    "uncached_requests": lambda t: verdicts.uncached_requests(t.turns, t.desync),
    "transcript_facts": lambda t: shape.to_facts(t.share_lines().lines).groupBy("sid", "kind").agg(F.count("*").alias("n")),
}

STATE: dict[str, Callable[[Tables], DataFrame]] = {
    "presend_counts": lambda t: state.presend_counts(t.log),
    "stale_tasks": lambda t: runs_summary(state.stale_tasks(t.log), "task"),
    "open_questions": lambda t: runs_summary(state.open_questions(t.log), "question"),
    "unresolved_retractions": lambda t: rules.unresolved_retractions(t.inputs).select("sid", "seq", F.col("upto").alias("idx"), "text"),
    "retraction_candidates": lambda t: rules.retraction_candidates(t.inputs),
    "state_facts": lambda t: t.facts,
}

RULES: dict[str, Callable[[Tables], DataFrame]] = {
    **{f"rule_{r.lower()}": rule_query(r) for r in rules.RULES if r != "R09"},
    "near_dup_candidates": lambda t: rules.near_dup_candidates(t.inputs).select("sid", "idx", "a", "b"),
    "evaluate_rules": lambda t: shown(rules.evaluate(t.share().inputs)),
    "fires_first_cause": lambda t: shown(t.first_fires),
}

ROUTING: dict[str, Callable[[Tables], DataFrame]] = {
    "rule_params": lambda t: C.rule_params(t.catalogue),
    "rule_actions": lambda t: C.rule_actions(t.refreshed),
    "fire_routing": lambda t: t.routed.select("sid", "idx", "rule", "key", "action", "surfaced", "deduped", "suppressed", "pending_verdict"),
    "render_injections": lambda t: routing.render_injections(t.routed).select("sid", "idx", "rule", "key", "text"),
    "turn_bundle": lambda t: routing.turn_bundle(t.routed),
    "fire_log": lambda t: t.fire_log,
    "reply_verdicts": lambda t: routing.reply_verdicts(t.messages),
    "pending_resolution": lambda t: routing.pending_resolution(t.asks, t.messages),
}

LABELS: dict[str, Callable[[Tables], DataFrame]] = {
    "labels_resolved": lambda t: labels.labels_resolved(t.label_rows),
    "labels_latest": lambda t: labels.labels_latest(t.label_rows),
    "later_correction": lambda t: labels.later_correction(
        t.first_fires.where("rule IN ('R05', 'R06')"), t.messages, t.markers),
    "label_r04": lambda t: labels.label_r04(t.first_fires, t.messages),
    "label_r07": lambda t: labels.flag_labels(rules.rule_r07(t.inputs)).select("sid", "idx", "key", "auto_label"),
    "label_r10": label_r10,
    "label_r12": lambda t: labels.flag_labels(t.first_fires.where("rule = 'R12'")).select("sid", "idx", "key", "auto_label"),
    "labelled_fires": lambda t: t.labelled.select("sid", "idx", "rule", "key", "basis", "hand", "label"),
    "precision_table": lambda t: t.precision,
    "review_queue": lambda t: labels.review_queue(t.first_fires, t.label_rows),
    "recent_fires": lambda t: oplog.recent_fires(t.fire_log, t.label_rows, t.catalogue),
    "fire_list": lambda t: labels.fire_list(t.listed),
    "backtest_summary": lambda t: labels.backtest_summary(t.messages, t.label_rows),
}

COVERAGE: dict[str, Callable[[Tables], DataFrame]] = {
    "signal_matches": lambda t: coverage.signal_matches(t.messages).select("sid", "idx", "signal"),
    "coverage_table": lambda t: coverage.coverage_table(t.messages, t.first_fires),
    "coverage_by_rule": lambda t: coverage.coverage_by_rule(t.messages, t.first_fires),
    "uncovered_samples": lambda t: coverage.uncovered_samples(t.messages, t.first_fires),
}

VERDICTS: dict[str, Callable[[Tables], DataFrame]] = {
    "markers": lambda t: t.markers.select("key", "sid", "ord", "kind", "confidence"),
    "verdict_agreement": lambda t: verdicts.verdict_agreement(t.desync),
    "verdict_disagreements": lambda t: verdicts.verdict_disagreements(t.desync),
    "desync_kind_counts": lambda t: verdicts.desync_kind_counts(t.desync),
    "directive_strength": lambda t: verdicts.directive_strength(t.directives),
    "directive_forms": lambda t: verdicts.directive_forms(t.directives),
    "directive_combos": lambda t: verdicts.directive_combos(t.directives),
    "verdict_contract": lambda t: verdicts.desync_contract(
        t.desync, t.turns.groupBy("key").agg(F.min_by("previous", "idx").alias("previous"))),
    "directive_contract": lambda t: verdicts.directive_contract(t.directives),
}

TRACE: dict[str, Callable[[Tables], DataFrame]] = {
    "active_rules": lambda t: t.active,
    "lookback_trace": lambda t: trace.lookback_trace(t.messages, t.markers, t.active, t.facts),
    "rules_before_markers": lambda t: trace.rules_before_markers(t.messages, t.markers, t.active),
    "facts_before_markers": lambda t: trace.facts_before_markers(t.messages, t.markers, t.facts),
    "silent_markers": lambda t: trace.silent_markers(t.messages, t.markers, t.active, t.facts),
    "marker_location": lambda t: trace.marker_location(t.messages, t.markers),
    "fact_lift": lambda t: trace.fact_lift(t.messages, t.markers, t.facts),
    "lookahead_rates": lambda t: trace.lookahead_rates(t.messages, t.directives, t.desync),
    "relative_risk": lambda t: trace.relative_risk(t.messages, t.directives, t.desync),
    "form_rates": lambda t: trace.form_rates(t.messages, t.directives, t.desync),
    "form_examples": lambda t: trace.form_examples(t.messages, t.directives, t.desync),
}

REDUCTION: dict[str, Callable[[Tables], DataFrame]] = {
    "epoch_plan": lambda t: reduction.epoch_plan(reduction.listing(t.captures)).select(
        "sid", "count", "event", "bytes", "epoch", "in_flight", "is_base"),
    "epoch_bases": lambda t: reduction.epoch_bases(reduction.epoch_plan(reduction.listing(t.captures))),
    "prefix_digests": lambda t: reduction.prefix_digests(
        reduction.base_contents(reduction.epoch_bases(reduction.epoch_plan(reduction.listing(t.captures))), t.captures),
        reduction.epoch_plan(reduction.listing(t.captures)).where("epoch IS NOT NULL AND bytes > 0"), native_bytes=8000),
    "reduction_index": lambda t: index_rows(t.index),
    "payload_facts": lambda t: reduction.payload_facts(t.index, views.payloads(t.captures)),
    "reduced_store": lambda t: t.store.select(
        "sid", "epoch", "count", "kind", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256")),
    "reconstruct_capture": lambda t: reduction.reconstruct_capture(t.index, t.store).select(
        "sid", "count", "source", F.sha2("content", 256).alias("sha256")),
    "reduced_store_lines": lambda t: t.line_store.bodies.select("address", F.octet_length("line").alias("bytes")),
    "reconstruct_from_lines": lambda t: linegrain.reconstruct_from_lines(t.index, t.line_store),
    "reduction_index_incremental": grown_index,
    "compaction_annotations": compaction_rows,
    "verify_roundtrip": lambda t: check_counts(reduction.verify_roundtrip(tampered_index(t), t.store)),
    "verify_against_source": lambda t: reduction.verify_against_source(tampered_index(t), t.captures),
    "staleness": stale_sessions,
    "prune_eligible": lambda t: reduction.prune_eligible(
        reduction.verify_roundtrip(tampered_index(t), t.store),
        reduction.verify_against_source(t.index, t.captures), stale_sessions(t)),
    "reduction_stats": lambda t: reduction.reduction_stats(t.index),
    "corpus_stats": lambda t: reduction.corpus_stats(t.files),
    "retention_by_age": lambda t: reduction.retention_by_age(t.files, views.EPOCH_US + 1_800_000_000).select("path"),
    "retention_keep_n": lambda t: reduction.retention_keep_n(t.files, 10, views.EPOCH_US + 1_800_000_000).select("path"),
    "capture_deltas": lambda t: reduction.capture_deltas(t.captures),
}

OPLOG: dict[str, Callable[[Tables], DataFrame]] = {
    "fires_summary": lambda t: oplog.fires_summary(t.counted_log),
    "suppression_counts": lambda t: oplog.suppression_counts(t.fire_log),
    "latency_bands": lambda t: oplog.latency_bands(t.fire_log),
    "normalise_summary": lambda t: oplog.normalise_status(t.normalise),
    "normalise_bands": lambda t: oplog.normalise_bands(t.normalise),
    "normalise_pairs": lambda t: oplog.normalise_pairs(t.normalise),
    "verdict_tally": lambda t: oplog.verdict_tally(t.label_rows),
    "routing_buckets": lambda t: C.routing_buckets(t.refreshed),
    "catalogue_drift": lambda t: C.drift(t.catalogue, t.refreshed),
}

STREAMING: dict[str, Callable[[Tables], DataFrame]] = {
    "stream_tail": jobs.stream_tail,
    "stream_sequence": jobs.stream_sequence,
    "stream_dedupe": jobs.stream_dedupe,
    "stream_rules": jobs.stream_rules,
    "stream_routing": jobs.stream_routing,
    "stream_verdicts": jobs.stream_verdicts,
    "stream_windows": jobs.stream_windows,
}

GROUPS = (SOURCES, SHAPE, STATE, RULES, ROUTING, LABELS, COVERAGE, VERDICTS, TRACE, REDUCTION, OPLOG, STREAMING)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: plan(Tables(spark, sf_dir))

    return {name: bind(plan) for group in GROUPS for name, plan in group.items()}
