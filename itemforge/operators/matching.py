"""Matching evaluation items to rows and texts, coverage and gaps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemforge.config import EnrichConfig
from itemforge.functions import text as tx
from itemforge.session import filter_settled, written

# Bytes of phrases in one automaton, and what a phrase counts besides its own bytes.
SHARD_BYTES, PHRASE_BYTES = 4 << 20, 64
# Counters of the sketch that tells rare facts, and the items that one task of the join takes.
SKETCH, ITEMS_PER_TASK = 1 << 16, 100_000


def reference_rows(evals: DataFrame) -> DataFrame:
    """(file, row, eval_id) from every row reference of ``source_location``."""
    return evals.select("eval_id", F.explode(tx.row_references(F.col("source_location"))).alias("ref")).select(
        "eval_id", F.col("ref.file").alias("file"), F.col("ref.row").alias("row")).distinct()


def match_by_reference(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Rows named by an item. Plain equi join: Spark broadcasts the references when they are small
    and shuffles on (file, row) when they are not."""
    base = F.lower(F.substring_index("source_file", "/", -1))
    keyed = rows.select("item_id", base.alias("file"), F.col("source_row").alias("row"))
    return keyed.join(refs, ["file", "row"]).select("item_id", "eval_id").distinct()


def match_by_line_band(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """Lines whose number or successor is referenced. The small side is unfolded, so it stays an equi join."""
    near = refs.select("eval_id", "file", F.explode(F.array("row", F.col("row") - 1)).alias("row"))
    return match_by_reference(lines.withColumnRenamed("line", "source_row"), near)


def _first_filled(cells: Column, places: Column) -> Column:
    """The first cell of ``places`` that is not blank, else blank."""
    return F.coalesce(tx.first_of(F.filter(F.transform(places, lambda c: F.get(cells, c)), lambda v: v != "")), F.lit(""))


def columns_for_fact(header: list[str], name: Column, config: EnrichConfig) -> Column:
    """Places of the header that can answer a fact key which is data, in the order they are tried.

    The column of that name; then the members of the role of that name, or else the columns whose name ends like it and
    the members of the role it is a member of. A cell answers when it is the first of them that is filled.
    """
    last = {n.lower(): i for i, n in enumerate(header)}
    members = {role.lower(): [last[m.lower()] for m in names if m.lower() in last] for role, names in config.key_fields.items()}
    ints = lambda places: F.array(*[F.lit(i) for i in places]).cast("array<int>")
    columns = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n.lower()).alias("name"), F.lit("".join(ch for ch in n.lower() if ch.isascii() and ch.isalnum())).alias("norm")) for i, n in enumerate(header)])
    lowered, norm = F.lower(name), tx.norm_key(name)
    exact = F.slice(F.reverse(F.filter(columns, lambda c: c["name"] == lowered)), 1, 1)
    like = F.filter(columns, lambda c: c["norm"].endswith(norm))
    by_role, of_role = F.lit(None).cast("array<int>"), ints([])
    for role, names in reversed(config.key_fields.items()):
        by_role = F.when(lowered == role.lower(), ints(members[role.lower()])).otherwise(by_role)
        of_role = F.when(lowered.isin(*[m.lower() for m in names]), ints(members[role.lower()])).otherwise(of_role) if names else of_role
    places = lambda found: F.transform(found, lambda c: c["i"])
    return F.array_distinct(F.concat(places(exact), F.coalesce(by_role, F.concat(places(like), of_role))))


def fact_roles(facts: Column, config: EnrichConfig) -> tuple[Column, Column]:
    """Entity and year an item's own facts (``array<struct<name,value>>``) point at."""
    def role(key: str) -> Column:
        def named(member: str) -> Column:
            value = F.try_element_at(F.filter(facts, lambda c: F.lower(c["name"]) == member.lower()), F.lit(-1))["value"]
            return F.when(~tx.is_empty(value), tx.trimmed(value))
        return F.coalesce(*[named(m) for m in config.key_fields.get(key, [])], F.lit(""))
    return role("entity"), role("year")


def match_by_entity_year(rows: DataFrame, header: list[str], evals: DataFrame, config: EnrichConfig | None = None) -> DataFrame:
    """Rows with an item's entity and year where every fact the row holds agrees, and at least one is held.

    ``rows`` carry ``item_id``, ``entity_name``, ``role_year`` and the header columns; ``evals`` carry ``facts``.
    Entity and year alone would pair every row of a group with every item of it, so the join key also takes the item's
    rarest fact: a row meets it where one of the columns that can answer the fact holds its value, or the first of them
    is blank. What is rare is read off a sketch of the rows' cells, ``SKETCH`` counters whatever their number; it decides
    the work, never the result, since each pair is checked in full. Fact names stay data: only places of the header,
    which is as wide as the table, come to the driver.
    """
    config = config or EnrichConfig()
    entity, year = fact_roles(F.col("facts"), config)
    # One pass over the rows: normal forms of the keys and of all cells, blank for none.
    cell = lambda h: F.when(tx.is_empty(F.col(f"`{h}`")), F.lit("")).otherwise(tx.norm_value(F.col(f"`{h}`")))
    base = rows.select("item_id", tx.norm_value(F.col("entity_name")).alias("k_entity"), tx.norm_value(F.col("role_year")).alias("k_year"), F.array(*[cell(h) for h in header]).alias("cells"))
    counter = lambda place, value: F.pmod(F.xxhash64(place, value), F.lit(SKETCH)).cast("int")
    sketch = base.select(F.posexplode("cells").alias("c", "v")).groupBy(counter(F.col("c"), F.col("v")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    counts = base.sparkSession.range(SKETCH).select(F.col("id").cast("int").alias("at")).join(sketch, "at", "left").select("at", F.floor(3 * F.log2(F.coalesce("n", F.lit(0)) + 1)).cast("tinyint").alias("n"))
    counts = counts.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("counts"))

    facts = F.filter(F.transform(F.filter("facts", lambda f: ~tx.is_empty(f["value"])), lambda f: F.struct(
        f["name"].alias("name"), tx.norm_value(f["value"]).alias("want"), columns_for_fact(header, f["name"], config).alias("places"))), lambda f: F.size(f["places"]) > 0)
    keyed = evals.select("eval_id", tx.norm_value(entity).alias("k_entity"), tx.norm_value(year).alias("k_year"), facts.alias("facts"))
    keyed = filter_settled(keyed, (F.col("k_entity") != "") & (F.col("k_year") != "") & (F.size("facts") > 0))
    taken = [m.lower() for role in ("entity", "year") for m in (role, *config.key_fields.get(role, []))]
    free = F.filter("facts", lambda f: ~F.lower(f["name"]).isin(*taken))
    # The sketch, a byte a counter, is one row beside every item: no item is copied or grouped to find its rarest fact.
    seen = lambda f: F.array_max(F.transform(F.concat(F.transform(f["places"], lambda c: counter(c, f["want"])),
                                                      F.array(counter(F.get(f["places"], F.lit(0)), F.lit("")))), lambda at: F.get("counts", at)))
    ranked = F.transform(free, lambda f: F.struct(seen(f).alias("n"), f["name"].alias("name"), f["want"].alias("want"), f["places"].alias("places")))
    least = F.array_min(ranked)
    bare = F.transform("facts", lambda f: F.struct(f["want"].alias("want"), f["places"].alias("places")))
    chosen = written(keyed.crossJoin(counts).select("eval_id", "k_entity", "k_year", bare.alias("facts"), F.when(F.size(free) > 0, tx.let(least, lambda f: F.struct(
        f["want"].alias("want"), f["places"].alias("places")))).alias("anchor")), "anchors")
    # An item without such a fact meets its rows by entity and year alone.
    keys = F.when(F.col("anchor").isNull(), F.array(F.struct(F.lit(-1).alias("c"), F.lit("").alias("v")))).otherwise(F.concat(
        F.transform("anchor.places", lambda c: F.struct(c.alias("c"), F.col("anchor.want").alias("v"))), F.array(F.struct(F.get("anchor.places", F.lit(0)).alias("c"), F.lit("").alias("v")))))
    wanted = chosen.select("eval_id", "k_entity", "k_year", "facts", F.explode(keys).alias("k")).select("*", "k.*").drop("k")
    used = sorted(r["c"] for r in wanted.select("c").distinct().collect())  # at most the header's width
    probes = F.array(*[F.struct(F.lit(c).alias("c"), (F.get("cells", F.lit(c)) if c >= 0 else F.lit("")).alias("v")) for c in used])
    probe = base.filter("k_entity <> '' and k_year <> ''").withColumn("k", F.explode(probes)).select("*", "k.*").drop("k")
    held = F.filter(F.transform("facts", lambda f: F.struct(f["want"].alias("want"), _first_filled(F.col("cells"), f["places"]).alias("have"))), lambda f: f["have"] != "")
    agree = tx.let(held, lambda h: (F.size(h) > 0) & F.forall(h, lambda f: f["have"] == f["want"]))
    key = ["k_entity", "k_year", "c", "v"]
    tasks = -(-chosen.count() // ITEMS_PER_TASK)  # from the file footers
    if tasks > int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        probe, wanted = probe.repartition(tasks, *key), wanted.repartition(tasks, *key)
    return probe.join(wanted, key).filter(agree).select("item_id", "eval_id").distinct()


def phrases_of(evals: DataFrame) -> DataFrame:
    """Distinct (eval_id, phrase); blank assertions match nothing here, though as substrings they would match all."""
    phrase = tx.norm_value(F.col("assertion"))
    return evals.select("eval_id", F.explode("assertions").alias("assertion")).select("eval_id", phrase.alias("phrase")).filter(
        F.col("phrase") != "").distinct()


def match_by_content(items: DataFrame, evals: DataFrame) -> DataFrame:
    """Items whose lowered content holds any assertion of an evaluation item."""
    phrases = phrases_of(evals)
    hits = texts_holding(items.select("item_id", F.lower("content").alias("content")), phrases.select("phrase"))
    return hits.join(phrases, "phrase").select("item_id", "eval_id").distinct()


def texts_holding(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(item_id, phrase) for every text of ``texts`` (item_id, content) and every phrase it holds.

    Phrases are dealt by hash into shards of about ``SHARD_BYTES``; each shard is one multi-pattern automaton past which
    every text is streamed once, where it is scanned. Texts are never shuffled, exploded or paired with phrases, and the
    time of a pass follows the texts and the hits, not the number of phrases. A shard is all that is broadcast at a time;
    however many phrases there are, they take this same path, in as many passes as there are shards.
    """
    distinct = phrases.filter("phrase <> ''").distinct()
    size = distinct.agg(F.sum(F.octet_length("phrase") + F.lit(PHRASE_BYTES))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("phrase"), F.lit(shards)))
    schema = T.StructType([texts.schema["item_id"], T.StructField("phrase", T.StringType())])
    passes = [_streamed(texts, dealt.filter(F.col("shard") == k).select("phrase"), schema) for k in range(shards)]
    return reduce(DataFrame.union, passes)


def _streamed(texts: DataFrame, shard: DataFrame, schema: T.StructType) -> DataFrame:
    patterns = texts.sparkSession.sparkContext.broadcast([r["phrase"] for r in shard.collect()])  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for phrase in patterns.value:
            automaton.add_word(phrase, phrase)
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist() if len(automaton) else []):
                held = {phrase for _, phrase in automaton.iter(text)} if text else ()
                at += [i] * len(held)
                found += held
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], schema.names)
    return texts.select("item_id", "content").mapInArrow(run, schema)


def merge_matches(*paths: DataFrame) -> DataFrame:
    """Union of match paths, one row per (item, evaluation item)."""
    out = paths[0]
    for other in paths[1:]:
        out = out.unionByName(other)
    return out.distinct()


def unmatched(evals: DataFrame, edges: DataFrame) -> DataFrame:
    return evals.join(edges.select("eval_id"), "eval_id", "left_anti")


def rows_with_match(rows: DataFrame, edges: DataFrame) -> DataFrame:
    return rows.join(edges.select("item_id"), "item_id", "left_semi")


def found_assertions(items: DataFrame, evals: DataFrame, edges: DataFrame) -> DataFrame:
    """(eval_id, assertion) seen verbatim, case included, in any matched item."""
    wanted = evals.select("eval_id", F.explode(F.array_distinct("assertions")).alias("assertion")).filter(F.col("assertion") != "")
    held = texts_holding(items.select("item_id", "content"), wanted.select(F.col("assertion").alias("phrase")))
    seen = held.join(wanted, held["phrase"] == wanted["assertion"]).join(edges, ["item_id", "eval_id"], "left_semi")
    return seen.select("eval_id", "assertion").distinct()


def assertion_gaps(evals: DataFrame, found: DataFrame) -> DataFrame:
    """Sorted assertions never found, per item that has any."""
    wanted = evals.select("eval_id", F.explode("assertions").alias("assertion"))
    missing = wanted.join(found, ["eval_id", "assertion"], "left_anti")
    return missing.groupBy("eval_id").agg(F.sort_array(F.collect_list("assertion")).alias("missing"))


def coverage(evals: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """Matched records and assertions found per evaluation item. Counts only: the edges stay a table."""
    matched = edges.groupBy("eval_id").agg(F.count(F.lit(1)).alias("matched_records"))
    seen = found.groupBy("eval_id").agg(F.count(F.lit(1)).alias("assertions_found"))
    zero = F.lit(0).cast("long")
    return (evals.select("eval_id", F.size(F.array_distinct("assertions")).cast("long").alias("assertions"))
            .join(matched, "eval_id", "left").join(seen, "eval_id", "left")
            .select("eval_id", "assertions", F.coalesce("matched_records", zero).alias("matched_records"),
                    F.coalesce("assertions_found", zero).alias("assertions_found")))
