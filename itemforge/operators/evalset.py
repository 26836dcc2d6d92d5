"""Evaluation items: reading, generating, merging and fingerprinting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions import ids
from itemforge.functions import text as tx
from itemforge.operators.documents import with_norms
from itemforge.session import filter_settled, stage, written

# Keys tried for the title and the identity of a record, and further wanted facts.
TITLE_KEYS = ("title", "displayName", "name", "primaryName", "country", "countryName", "entity", "condition", "recordId", "id")
ID_KEYS = ("id", "recordId", "nctId", "trialId", "studyId", "code", "countryiso3code", "country", "countryName")
MORE_KEYS = ("year", "status", "condition", "intervention", "sponsor", "phase", "value")


def parse_facts(facts: Column) -> Column:
    """``k=v`` texts to entries, later repeats of a key winning in place; texts without ``=`` are left out."""
    pairs = F.filter(F.transform(facts, lambda f: F.struct(tx.fact_key(f).alias("name"), tx.fact_value(f).alias("value"))),
                     lambda p: p["name"].isNotNull())

    def last_per_name(rows: Column) -> Column:
        firsts = F.filter(rows, lambda p, i: F.array_position(F.transform(rows, lambda x: x["name"]), p["name"]) == i + 1)
        return F.transform(firsts, lambda p: F.struct(p["name"].alias("name"), F.element_at(
            F.filter(rows, lambda x: x["name"] == p["name"]), F.lit(-1))["value"].alias("value")))
    return tx.let(pairs, last_per_name)


def _useful(entries: Column) -> Column:
    return F.filter(entries, lambda e: tx.is_useful(e["value"]))


def _first_by_keys(useful: Column, keys: tuple[str, ...]) -> Column:
    """First useful value by key priority: the whole key, then its ending."""
    wanted = F.array(*[F.lit(k.lower()) for k in keys])

    def one(w: Column) -> Column:
        return F.coalesce(tx.first_of(F.filter(useful, lambda e: e["norm"] == w))["value"],
                          tx.first_of(F.filter(useful, lambda e: e["norm"].endswith(w)))["value"])
    return tx.first_of(F.filter(F.transform(wanted, one), lambda v: v.isNotNull()))


def generate(records: DataFrame) -> DataFrame:
    """Evaluation item per record (``source``, ``row``, ``entries``) with at least three useful facts.

    One projection: every step is an array expression on the record's own entries.
    """
    staged = filter_settled(records.withColumn("_u", with_norms(_useful(F.col("entries")))), F.size("_u") >= 3)
    u = F.col("_u")
    title = F.coalesce(_first_by_keys(u, TITLE_KEYS), tx.first_of(u)["value"])
    staged = staged.withColumn("_title", title)
    staged = staged.withColumn("_identity", F.coalesce(_first_by_keys(u, ID_KEYS), F.col("_title")))
    # one candidate per wanted key (an object without such a field gives none), then every other useful fact
    keys_in_order = F.array(*[F.lit(k.lower()) for k in dict.fromkeys((*ID_KEYS, *TITLE_KEYS, *MORE_KEYS))])
    wanted = F.transform(keys_in_order, lambda w: tx.first_of(F.filter(u, lambda e: e["norm"].endswith(w))))
    others = F.filter(F.slice(u, 1, 40), lambda e: e["value"] != F.col("_title"))
    candidates = F.concat(F.filter(wanted, lambda e: e.isNotNull()), others)
    selected = tx.let(F.transform("_cand", lambda e: e["key"]), lambda keys: F.slice(F.filter("_cand", lambda e, i: F.array_position(keys, e["key"]) == i + 1), 1, 4))
    staged = filter_settled(staged.withColumn("_cand", candidates).withColumn("_s", selected), F.size("_s") >= 2)
    t = F.col("_title")
    labels = F.array_join(F.transform("_s", lambda e: tx.humanize_leaf(e["key"])), ", ")
    parts = F.array_join(F.transform("_s", lambda e: F.concat(tx.humanize_leaf(e["key"]), F.lit(" is "), e["value"])), "; ")
    checks = F.array_distinct(F.concat(F.array(t), F.transform("_s", lambda e: e["value"])))
    location = F.concat("source", F.lit(":row "), F.col("row").cast("string"))
    key = F.concat("source", F.lit(":"), F.col("row").cast("string"), F.lit(":"), "_identity", F.lit(":"),
                   F.array_join(F.transform("_s", lambda e: e["value"]), "|"))
    return staged.select(
        ids.short_hash(key).alias("eval_id"), F.concat(F.lit("For "), t, F.lit(", what are the values for "), labels, F.lit("?")).alias("prompt"),
        F.concat(t, F.lit(": "), parts, F.lit(".")).alias("expected_answer"), location.alias("source_location"),
        F.transform(checks, lambda v: F.struct(v.alias("value"), v.rlike("^[A-Z0-9]{2,4}$").alias("whole_word"))).alias("assertions"),
        F.lit("single_record_lookup").alias("category"), F.lit("easy").alias("difficulty"),
        F.transform("_s", lambda e: F.concat(e["key"], F.lit("="), e["value"])).alias("supporting_facts"),
        F.when(F.size(checks) >= 3, "high").otherwise("medium").alias("grounding_confidence"),
        F.col("source").alias("_source"), F.col("row").alias("_row"))


def build_eval_set(generated: DataFrame, target: int, seed: DataFrame | None = None) -> DataFrame:
    """Seed items, then generated ones in (source, row) order that repeat no accepted prompt or id, up to ``target``.

    The order-dependent skip is settled in rounds: an item first among the rest in both its prompt and
    its id is accepted, everything clashing with it is dropped, and the next round looks at what is left.
    """
    order = F.struct("_source", "_row")
    pool = generated.withColumn("_prompt", tx.norm_prompt(F.col("prompt"))).withColumn("_at", order)
    if seed is not None:
        pool = (pool.join(seed.select(tx.norm_prompt(F.col("prompt")).alias("_prompt")), "_prompt", "left_anti")
                .join(seed.select("eval_id"), "eval_id", "left_anti"))
    pool = written(pool, "pool")  # every round and the result read it again
    keyed, accepted, first_round = pool.select("eval_id", "_prompt", "_at"), None, True
    while first_round or not rest.isEmpty():
        source = keyed if first_round else rest
        by_prompt = source.groupBy("_prompt").agg(F.min("_at").alias("_p"))
        by_id = source.groupBy("eval_id").agg(F.min("_at").alias("_i"))
        placed = source.join(by_prompt, "_prompt").join(by_id, "eval_id")
        won = placed.filter((F.col("_at") == F.col("_p")) & (F.col("_at") == F.col("_i"))).select("eval_id", "_prompt", "_at")
        rest = stage(source.join(won.select("_prompt"), "_prompt", "left_anti").join(won.select("eval_id"), "eval_id", "left_anti"))
        accepted = won if accepted is None else accepted.unionByName(won)
        first_round = False
    fresh = pool.join(accepted.select("_at"), "_at", "left_semi").drop("_prompt", "_at")
    ranked = fresh.withColumns({"_rank": F.lit(1), "_seed_at": F.lit(0).cast("long")})
    if seed is not None:
        seeded = seed.withColumns({"_rank": F.lit(0), "_seed_at": F.col("ordinal").cast("long")}).drop("ordinal")
        ranked = seeded.unionByName(ranked, allowMissingColumns=True)
    return ranked.orderBy("_rank", "_seed_at", "_source", "_row").limit(target).drop("_rank", "_seed_at", "_source", "_row")


def canonical_items(evals: DataFrame) -> DataFrame:
    """Trimmed items with a default id and their canonical JSON; items without a prompt are dropped."""
    def t(c: str) -> Column:
        return tx.trimmed(tx.text_or_blank(F.col(c)))
    kept = evals.withColumn("_prompt", t("prompt")).filter(F.col("_prompt") != "")
    given = t("eval_id")
    ident = F.when(given != "", given).otherwise(ids.short_hash(F.col("_prompt")))
    checks = F.filter(F.transform("assertions", lambda a: F.struct(
        tx.trimmed(tx.text_or_blank(a["value"])).alias("value"), F.when(a["whole_word"], True).alias("wholeWord"))),
        lambda a: a["value"] != "")
    facts = F.filter(F.transform("supporting_facts", lambda f: tx.trimmed(f)), lambda f: f != "")
    shaped = kept.select(ident.alias("id"), F.col("_prompt").alias("prompt"), t("expected_answer").alias("expected_answer"),
                         F.coalesce(checks, F.array().cast("array<struct<value:string,wholeWord:boolean>>")).alias("assertions"),
                         F.coalesce(facts, F.array().cast("array<string>")).alias("supporting_facts"),
                         t("category").alias("category"), t("difficulty").alias("difficulty"))
    return shaped.withColumn("canonical", F.to_json(F.struct(*shaped.columns)))


def digest_trees(lines: DataFrame, line: str, by: list[str] = ()) -> DataFrame:
    """Order-insensitive SHA-256 over the lines of every group (``by``): hash and n, the same tree at every size.

    Every line is digested; digests of a group with the same four leading hex digits are sorted, joined by newlines and
    digested, then those with the same two, then all. Digests are uniform, so the tasks stay even whatever the lines hold
    and however large a group is, and the last two levels join at most 256 digests each.
    """
    by = list(by)
    joined = F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("h")
    leaf = lines.select(*by, F.sha2(F.col(line), 256).alias("h"))
    groups = leaf.groupBy(*by, F.substring("h", 1, 4).alias("g")).agg(joined, F.count(F.lit(1)).alias("n"))
    tops = groups.groupBy(*by, F.substring("g", 1, 2).alias("g")).agg(joined, F.sum("n").alias("n"))
    return tops.groupBy(*by).agg(joined, F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(*by, F.concat(F.lit("sha256-tree:"), "h").alias("hash"), "n")


def digest_tree(lines: DataFrame, line: str) -> DataFrame:
    """The digest tree of all lines: one row (hash, n)."""
    return digest_trees(lines, line)


def evalset_fingerprint(evals: DataFrame) -> DataFrame:
    """Order-insensitive hash of an evaluation set."""
    return digest_tree(canonical_items(evals), "canonical")


def dataset_fingerprint(files: DataFrame) -> DataFrame:
    """Hash over (path, sha256, bytes) of every file, path in lower case."""
    line = F.concat_ws("\t", F.lower("path"), "sha256", F.col("bytes").cast("string"))
    return digest_tree(files.select(line.alias("_line")), "_line")


def file_hash(content: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a file's content."""
    return F.substring(F.sha2(content, 256), 1, 16)


def folder_hashes(files: DataFrame) -> DataFrame:
    """(folder, hash, n) of every folder above the files (path, hash), the root being ``''``.

    A folder's hash covers the paths below it and the hashes of all files there, so it changes with any of them. Each
    file gives one line to each folder above it; no folder is gathered in one task.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(
        F.array_join(F.slice(parts, F.lit(1), k), "/").alias("folder"), F.array_join(F.slice(parts, k + 1, F.size(parts)), "/").alias("below")))
    lines = files.select(F.inline(above), "hash").select("folder", F.concat("below", F.lit(":"), "hash").alias("_line"))
    return digest_trees(lines, "_line", ["folder"])


def fact_key_counts(evals: DataFrame) -> DataFrame:
    """How many evaluation items cite each fact key."""
    return evals.select(F.explode(F.transform("facts", lambda f: f["name"])).alias("field")).groupBy("field").agg(
        F.count(F.lit(1)).alias("n"))


def header_counts(evals: DataFrame, header: list[str]) -> dict[str, int]:
    """Citation counts of header columns only, so what comes back is bounded by the header."""
    return {r["field"]: r["n"] for r in fact_key_counts(evals).filter(F.col("field").isin(*header)).collect()}
