"""Grounding scores, reports and run comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions import numbers as nm
from itemforge.functions import text as tx

PIECE = "\x1f"
INVALID_SHARE_LIMIT = 0.5


def is_invalid(answer: Column, error: Column, rate_limited: Column, judge: Column) -> Column:
    """Responses that must not be scored."""
    return (F.coalesce(error != "", F.lit(False)) | (tx.trimmed(tx.text_or_blank(answer)) == "")
            | F.coalesce(answer.startswith("[ERROR:"), F.lit(False)) | F.coalesce(rate_limited, F.lit(False))
            | F.coalesce(answer.rlike(tx.RATE_LIMIT_REGEX), F.lit(False))
            | F.coalesce(F.contains(F.lower(judge), F.lit("fallback")), F.lit(False)))


def invalid_gate(responses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Invalid count and whether a run may be scored; a run fails above half."""
    share = F.count_if("invalid") / F.greatest(F.count(F.lit(1)), F.lit(1))
    return responses.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("responses"), F.count_if("invalid").alias("invalid_rows"),
        (share <= INVALID_SHARE_LIMIT).alias("passed"))


def _folded_list(values: Column, fold) -> Column:
    """Fold every text of an array in one call: joined, folded once, split again."""
    return F.when(F.size(values) > 0, F.split(fold(F.array_join(values, PIECE)), PIECE, -1)).otherwise(F.array().cast("array<string>"))


def _score_columns(df: DataFrame, a_pass: Column, a_all: Column, f_pass: Column, f_all: Column) -> DataFrame:
    staged = df.withColumns({"assertions_passed": a_pass.cast("long"), "assertions_total": a_all.cast("long"),
                             "facts_passed": f_pass.cast("long"), "facts_total": f_all.cast("long")})
    ap, at, fp, ft = (F.col(c) for c in ("assertions_passed", "assertions_total", "facts_passed", "facts_total"))
    share_a, share_f = ap / F.nullif(at, F.lit(0)), fp / F.nullif(ft, F.lit(0))
    return staged.withColumns({"_sa": share_a, "_sf": share_f})


def _status(passed: Column, total: Column) -> Column:
    return F.when(passed == total, "pass").when(passed > 0, "partial").otherwise("fail")


def library_scores(pairs: DataFrame) -> DataFrame:
    """Score of each answer: 0.8 assertion plus 0.2 fact coverage, or facts alone, or agreement on "nothing found".

    ``pairs`` carry ``expected_answer``, ``actual_answer``, ``assertions`` and ``supporting_facts``.
    """
    facts = F.filter(F.transform(F.filter("supporting_facts", lambda f: tx.trimmed(f) != ""), lambda f: tx.fact_value(f)),
                     lambda v: v != "")
    staged = pairs.withColumns({
        "_response": tx.text_or_blank(F.col("actual_answer")), "_expected": tx.text_or_blank(F.col("expected_answer")),
        "_values": F.transform("assertions", lambda a: tx.text_or_blank(a["value"])), "_facts": facts})
    staged = staged.withColumns({
        "_fr": tx.fold(F.col("_response")), "_fe": tx.fold(F.col("_expected")),
        "_fv": _folded_list(F.col("_values"), tx.fold), "_ff": _folded_list(F.col("_facts"), tx.fold)})
    staged = staged.withColumn("_cr", tx.compact(F.col("_fr")))

    def held(v: Column) -> Column:
        return (v == "") | F.contains("_fr", v) | F.contains("_cr", tx.compact(v))
    scored = _score_columns(staged, F.size(F.filter("_fv", held)), F.size("_fv"), F.size(F.filter("_ff", held)), F.size("_ff"))
    at, ft, ap, fp = (F.col(c) for c in ("assertions_total", "facts_total", "assertions_passed", "facts_passed"))
    none_expected, none_given = tx.has_no_result_phrase(F.col("_fe")), tx.has_no_result_phrase(F.col("_fr"))
    agree = F.when(none_expected & none_given, 1.0).otherwise(0.0)
    fact_part = F.coalesce("_sf", "_sa")
    score = F.when(at > 0, 0.8 * F.col("_sa") + 0.2 * fact_part).when(ft > 0, F.col("_sf")).otherwise(agree)
    status = (F.when(at > 0, _status(ap, at)).when(ft > 0, _status(fp, ft))
              .when(none_expected & none_given, "pass").otherwise("fail"))
    failed = F.filter(F.zip_with("_values", "_fv", lambda v, f: F.when(~held(f), v)), lambda v: v.isNotNull())
    semantic = tx.overlap_f1(tx.tokens(F.col("_fe")), tx.tokens(F.col("_fr")))
    keep = [c for c in pairs.columns if c not in ("assertions", "supporting_facts")]
    return scored.select(
        *keep, "assertions_passed", "assertions_total", "facts_passed", "facts_total",
        nm.round_pct(score).alias("grounding_score"), nm.round_pct(semantic).alias("overlap_score"),
        nm.round_pct(F.when(at > 0, F.col("_sa")).when(ft > 0, F.col("_sf")).otherwise(agree)).alias("assertion_score"),
        nm.round_pct(F.when(at > 0, fact_part).when(ft > 0, F.col("_sf")).otherwise(agree)).alias("fact_score"),
        status.alias("status"), tx.has_citation(F.col("_response")).alias("has_citation"),
        none_given.alias("no_result"), none_expected.alias("expected_no_result"), failed.alias("failed_checks"))


def report_scores(pairs: DataFrame, fold: Callable[[Column], Column] = tx.fold_keep_marks) -> DataFrame:
    """Report form of the score: marks are kept in the fold, blank facts count as failed,
    an answer without evaluation item scores zero. ``matched`` says whether the item exists.

    The default fold decomposes, so a bare letter at the end of a value is found in a marked one; with
    ``tx.fold_composed`` a marked letter is a letter of its own."""
    facts = F.filter("supporting_facts", lambda f: f.isNotNull())
    staged = pairs.withColumns({
        "_response": tx.text_or_blank(F.col("actual_answer")),
        "_values": F.coalesce(F.transform("assertions", lambda a: tx.text_or_blank(a["value"])), F.array().cast("array<string>")),
        "_facts": F.coalesce(F.transform(facts, lambda f: tx.fact_value(f)), F.array().cast("array<string>"))})
    staged = staged.withColumns({
        "_fr": fold(F.col("_response")), "_fv": _folded_list(F.col("_values"), fold),
        "_ff": _folded_list(F.col("_facts"), fold)})
    scored = _score_columns(
        staged, F.size(F.filter("_fv", lambda v: (v == "") | F.contains("_fr", v))), F.size("_fv"),
        F.size(F.filter("_ff", lambda v: (v != "") & F.contains("_fr", v))), F.size("_ff"))
    at, ft, ap, fp = (F.col(c) for c in ("assertions_total", "facts_total", "assertions_passed", "facts_passed"))
    score = F.when(at > 0, 0.8 * F.col("_sa") + 0.2 * F.coalesce("_sf", "_sa")).when(ft > 0, F.col("_sf")).otherwise(0.0)
    status = F.when(at > 0, _status(ap, at)).when(ft > 0, _status(fp, ft)).otherwise("fail")
    flagged = F.coalesce("has_citation", F.lit(False)) if "has_citation" in pairs.columns else F.lit(False)
    hit = F.col("matched")
    keep = [c for c in pairs.columns if c not in ("assertions", "supporting_facts", "has_citation")]
    return scored.select(
        *keep, "assertions_passed", "assertions_total", "facts_passed", "facts_total",
        nm.round_pct(score).alias("score"), status.alias("status"),
        (flagged | (hit & tx.has_citation(F.col("_response")))).alias("citation"),
        (hit & tx.has_no_result_wording(F.col("_response"))).alias("no_result"))


def join_by_id(responses: DataFrame, evals: DataFrame) -> DataFrame:
    """Responses with their item; responses without one stay, marked unmatched."""
    wanted = evals.select("eval_id", "assertions", "supporting_facts", "category", F.lit(True).alias("matched"))
    return responses.join(wanted, "eval_id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def join_by_position(evals: DataFrame, responses: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Items with the response at the same place; items past the last response get a blank answer."""
    answers = responses.select(ordinal, "actual_answer", F.col("expected_answer").alias("_e"))
    joined = evals.join(answers, ordinal, "left")
    return joined.withColumns({
        "actual_answer": tx.text_or_blank(F.col("actual_answer")),
        "expected_answer": F.coalesce(F.when(F.col("expected_answer") != "", F.col("expected_answer")), F.col("_e"), F.lit(""))}).drop("_e")


def _rate(passed: str, total: str) -> Column:
    return F.when(F.sum(total) > 0, nm.round_pct(F.sum(passed) / F.nullif(F.sum(total), F.lit(0)))).otherwise(100.0)


def agent_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("prompts"), nm.round_delta(nm.exact_mean(F.col("grounding_score"))).alias("avg_grounding"),
        nm.round_delta(nm.exact_mean(F.col("overlap_score"))).alias("avg_overlap"),
        _rate("assertions_passed", "assertions_total").alias("assertion_rate"),
        F.sum("assertions_passed").alias("assertions_passed"), F.sum("assertions_total").alias("assertions_total"),
        _rate("facts_passed", "facts_total").alias("fact_rate"),
        F.sum("facts_passed").alias("facts_passed"), F.sum("facts_total").alias("facts_total"),
        F.count_if(F.col("status") == "pass").alias("pass_count"), F.count_if(F.col("status") == "partial").alias("partial_count"),
        F.count_if(F.col("status") == "fail").alias("fail_count"), F.count_if("has_citation").alias("citation_count"))


def category_summary(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per category and overall in one pass; the overall line has a null category."""
    named = scores.withColumn("category", F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("uncategorized")))
    grouped = named.groupingSets([[*(F.col(b) for b in by or []), F.col("category")], [F.col(b) for b in by or []]],
                                 *[F.col(b) for b in by or []], F.col("category"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), nm.round_delta(nm.exact_mean(F.col("grounding_score"))).alias("avg_grounding"),
                       nm.round_delta(nm.exact_mean(F.col("overlap_score"))).alias("avg_overlap"))


def _pct_of_mean(c: Column) -> Column:
    return nm.round_pct(nm.exact_mean(c) / 100)


def score_report(scores: DataFrame, by: list[str]) -> DataFrame:
    """One report row per run over its valid answers."""
    valid = ~F.col("invalid")
    zero = F.lit(0.0)

    def over(c: str) -> Column:
        return F.when(valid, F.col(c))
    cited = F.count_if(valid & F.col("citation"))
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("prompts"), F.count_if(valid).alias("valid_prompts"),
        F.coalesce(_pct_of_mean(over("score")), zero).alias("deterministic_avg"),
        F.count_if(valid & (F.col("status") == "pass")).alias("pass_count"),
        F.count_if(valid & (F.col("status") == "partial")).alias("partial_count"),
        F.count_if(valid & (F.col("status") == "fail")).alias("fail_count"),
        F.coalesce(_pct_of_mean(over("semantic_score")), zero).alias("semantic_avg"),
        F.coalesce(nm.round_pct(cited / F.nullif(F.count_if(valid), F.lit(0))), zero).alias("citation_rate"),
        F.coalesce(F.sum(over("retries")), F.lit(0)).cast("long").alias("retry_count"),
        F.count_if(valid & F.coalesce("rate_limited", F.lit(False))).alias("rate_limit_count"))


def report_categories(scores: DataFrame, by: list[str]) -> DataFrame:
    kept = scores.filter(~F.col("invalid") & (F.coalesce("category", F.lit("")) != ""))
    return kept.groupBy(*by, "category").agg(F.count(F.lit(1)).alias("n"), _pct_of_mean(F.col("score")).alias("average"))


def dimension_averages(scores: DataFrame, by: list[str]) -> DataFrame:
    """Average of each named judge dimension; names come from the data."""
    long = scores.filter(~F.col("invalid")).select(*by, F.explode("dimensions").alias("dimension", "value"))
    return long.groupBy(*by, "dimension").agg(_pct_of_mean(F.col("value")).alias("average"))


def numeric_entries(m: Column) -> Column:
    """Numeric part of a text map."""
    return F.map_filter(F.transform_values(m, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())


def mean_of_map(m: Column) -> Column:
    values = F.map_values(m)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def per_question(left: DataFrame, right: DataFrame, semantic_comparable: bool = True) -> DataFrame:
    """Two runs side by side by item id; one-sided rows stay, deltas need both sides."""
    a = left.select("id", F.col("prompt").alias("_pa"), F.col("score").alias("a_score"), F.col("semantic").alias("a_semantic"),
                    F.col("status").alias("a_status"), F.lit(True).alias("_a"))
    b = right.select("id", F.col("prompt").alias("_pb"), F.col("score").alias("b_score"), F.col("semantic").alias("b_semantic"),
                     F.col("status").alias("b_status"), F.lit(True).alias("_b"))
    both = F.col("_a") & F.col("_b")
    semantic = nm.round_delta(F.col("a_semantic") - F.col("b_semantic")) if semantic_comparable else F.lit(None).cast("double")
    return a.join(b, "id", "full_outer").select(
        "id", F.coalesce("_pa", "_pb").alias("prompt"), "a_score", "a_semantic", "a_status", "b_score", "b_semantic", "b_status",
        F.when(both, nm.round_delta(F.col("a_score") - F.col("b_score"))).alias("score_delta"),
        F.when(both, semantic).alias("semantic_delta"))


def report_deltas(reports: DataFrame, pairs: DataFrame) -> DataFrame:
    """Run pair to report differences. ``pairs`` carry run_a, run_b and semantic_comparable."""
    a = reports.select([F.col(c).alias(f"a_{c}") for c in reports.columns])
    b = reports.select([F.col(c).alias(f"b_{c}") for c in reports.columns])
    joined = pairs.join(a, F.col("run_a") == F.col("a_run_id")).join(b, F.col("run_b") == F.col("b_run_id"))

    def diff(c: str) -> Column:
        return F.col(f"a_{c}") - F.col(f"b_{c}")
    return joined.select(
        "run_a", "run_b", nm.round_delta(diff("deterministic_avg")).alias("deterministic_delta"),
        nm.round_delta(diff("citation_rate")).alias("citation_delta"), diff("retry_count").alias("retry_delta"),
        diff("rate_limit_count").alias("rate_limit_delta"), diff("valid_prompts").alias("valid_delta"),
        F.when(F.col("semantic_comparable"), nm.round_delta(diff("semantic_avg"))).alias("semantic_delta"))


def dimension_deltas(dimensions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per-dimension differences over the union of names; a missing side counts as zero."""
    comparable = pairs.filter("semantic_comparable")
    sides = (comparable.join(dimensions, F.col("run_a") == F.col("run_id")).select("run_a", "run_b", "dimension", F.col("average").alias("signed"))
             .unionByName(comparable.join(dimensions, F.col("run_b") == F.col("run_id"))
                          .select("run_a", "run_b", "dimension", (-F.col("average")).alias("signed"))))
    return sides.groupBy("run_a", "run_b", "dimension").agg(
        nm.round_delta(F.sum(F.col("signed").cast("decimal(28,6)")).cast("double")).alias("delta"))


def _reasons(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(comparable, semantic_comparable, reasons) of an enhanced run ``a`` against a plain run ``b``."""
    def clash(name: str) -> Column:
        return F.coalesce(a[name] != b[name], F.lit(False))
    provision = F.coalesce((a["mode"] == "provision") & (b["mode"] == "provision"), F.lit(False))
    kinds = F.coalesce(a["no_enhance"] != b["no_enhance"], F.lit(False))
    judges = a["judge"].eqNullSafe(b["judge"])
    comparable = kinds & provision & ~clash("dataset_hash") & ~clash("evalset_hash")
    reasons = F.concat_ws(
        "; ", F.when(~kinds, "runs are of the same kind"), F.when(~provision, "one or both runs have no scored report"),
        F.when(clash("dataset_hash"), "datasets differ"), F.when(clash("evalset_hash"), "evaluation sets differ"),
        F.when(provision & ~judges, "judges differ, semantic delta omitted"))
    return comparable, provision & judges, reasons


RUN_KEYS = ("mode", "no_enhance", "dataset_hash", "evalset_hash", "judge")


def check_pairs(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Requested (run_a, run_b) pairs, put in enhanced-first order, with comparability and reasons."""
    def side(name: str) -> DataFrame:
        return runs.select(F.col("run_id").alias(f"run_{name}"), *[F.col(k).alias(f"{name}_{k}") for k in RUN_KEYS])
    joined = pairs.join(side("a"), "run_a").join(side("b"), "run_b")
    a, b = ({k: F.col(f"{n}_{k}") for k in RUN_KEYS} for n in ("a", "b"))
    comparable, semantic, reasons = _reasons(a, b)
    swap = F.col("a_no_enhance") & ~F.col("b_no_enhance")
    return joined.select(F.when(swap, F.col("run_b")).otherwise(F.col("run_a")).alias("run_a"),
                         F.when(swap, F.col("run_a")).otherwise(F.col("run_b")).alias("run_b"),
                         comparable.alias("comparable"), semantic.alias("semantic_comparable"), reasons.alias("reasons"))


def candidates_for(runs: DataFrame, chosen: dict) -> DataFrame:
    """Every other run with whether it can be compared with the chosen one; a plain filter over the run table."""
    a = {k: F.lit(chosen.get(k)) for k in RUN_KEYS}
    comparable, semantic, reasons = _reasons(a, {k: F.col(k) for k in RUN_KEYS})
    return runs.filter(F.col("run_id") != chosen["run_id"]).select(
        "run_id", comparable.alias("comparable"), semantic.alias("semantic_comparable"), reasons.alias("reasons"))


def compare_two(a: dict, b: dict) -> tuple[dict, dict]:
    """Order a pair as (enhanced, plain); anything but one of each is refused."""
    if bool(a.get("no_enhance")) == bool(b.get("no_enhance")):
        raise ValueError("comparison needs exactly one enhanced and one plain run")
    return (b, a) if a.get("no_enhance") else (a, b)


def run_summary(runs: DataFrame, reports: DataFrame, provenance: DataFrame) -> DataFrame:
    """One line per run: its settings, its report and the label provenance when known."""
    return runs.join(reports, "run_id", "left").join(provenance, "run_id", "left")
