"""Repeat requests: what an exact-match response cache would have served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsieve import constants as K
from promptsieve.functions.text import glob_to_regex
from promptsieve.functions.variant import (
    child, items_at, kind, parse_body, present, text_at, truthy,
)
from promptsieve.session import saved


def is_repeatable(body: Column) -> Column:
    """Whether equal VARIANT requests get equal answers: temperature 0 or a seed, text only,
    no tools, format, stream or audio."""
    empty = F.array().cast("array<variant>")
    for_any = lambda path, test: F.exists(F.coalesce(items_at(body, path), empty), test)
    ok = F.lit(True)
    for key in ("tools", "functions", "tool_choice", "response_format", "stream", "audio"):
        ok = ok & ~truthy(body, f"$.{key}")
    modes = for_any("$.modalities", lambda m: F.coalesce(text_at(m, "$") != "text", F.lit(True)))
    parts = lambda m: items_at(m, "$.content").isNotNull()
    numeric = kind(child(body, "$.temperature")).isin("BIGINT", "DOUBLE") | kind(
        child(body, "$.temperature")).startswith("DECIMAL")
    cold = numeric & (F.try_variant_get(body, "$.temperature", "double") == 0)
    fixed = F.coalesce(cold, F.lit(False)) | present(body, "$.seed")
    return ok & ~modes & fixed & ~for_any("$.messages", parts) & ~for_any("$.input", parts)


def request_fingerprint(namespace: Column, provider: Column, path: Column, body: Column) -> Column:
    """Key of a repeatable request, NULL otherwise or without a namespace.

    Equal JSON objects give equal keys whatever their member order: VARIANT prints its
    members sorted.
    """
    parsed = parse_body(body)
    digest = F.sha2(F.to_json(parsed), 256)
    key = F.concat(F.lit("repeat:"), F.nullif(namespace, F.lit("")), F.lit(":"), provider,
                   F.lit(":"), path, F.lit(":"), digest)
    return F.when(is_repeatable(parsed), key)


def route_allowed(path: Column, globs: list[str]) -> Column:
    """Whether the path, without its query, matches one of the globs; no globs allow all."""
    if not globs:
        return F.lit(True)
    bare = F.split_part(path, F.lit("?"), F.lit(1))
    return _any([bare.rlike(glob_to_regex(g)) for g in globs])


def _any(conditions: list[Column]) -> Column:
    result = conditions[0]
    for c in conditions[1:]:
        result = result | c
    return result


def sensitive_policy_gate(requests: DataFrame, category_policy: DataFrame) -> DataFrame:
    """Keep requests only of policies (policy_id) without a pii or phi category."""
    sensitive = category_policy.where(F.col("category").isin("pii", "phi")).select("policy_id").distinct()
    return requests.join(sensitive, "policy_id", "left_anti")


def store_times(requests: DataFrame, ttl: int = K.CACHE_TTL_SECONDS) -> DataFrame:
    """(key, at, rank) of the requests whose response is stored; ``at`` in milliseconds.

    The first request of a key stores; the next one at least ``ttl`` after a store stores
    again. That is a chain per key, which is followed without walking it:

    * requests of a key within one millisecond are one row (combined before the shuffle), so
      a key has no more rows than there are milliseconds, however many requests it gets;
    * with time cut into slots of length ``ttl``, a slot that follows an empty slot begins a
      new run: no earlier store can still be alive there. A run of one slot stores at its first row,
      and that is all;
    * in a longer run every row points at the row that would store next if it stored: the first
      one at least ``ttl`` later, in the next slot or the first of the one after. From the first row of
      each run the stores are marked by pointer doubling: in each round the marked rows mark what
      their pointers lead to, and pointers double their reach. A run of n slots has n stores at most,
      so there are log n rounds, each a join by (key, at): a key that is never idle is spread over all
      tasks. Rounds are written to the shared folder.
    """
    ttl_ms = ttl * 1000
    times = requests.groupBy("key", "at").agg(F.min("rank").alias("rank"))
    times = times.withColumn("slot", F.floor(F.col("at") / ttl_ms)).where(
        "key is not null and slot is not null and rank is not null")
    order = Window.partitionBy("key").orderBy("slot")
    begins = F.coalesce(F.col("slot") - F.lag("slot").over(order) > 1, F.lit(True))
    goes_on = F.coalesce(F.lead("slot").over(order) - F.col("slot") == 1, F.lit(False))
    slots = times.groupBy("key", "slot").agg(F.min_by(F.struct("at", "rank"), "at").alias("first")).select(
        "key", "slot", "first", begins.alias("begins"), goes_on.alias("goes_on"), F.last(F.when(begins, F.col("slot")), True).over(order).alias("run"))
    slots = saved(slots, "slots")
    alone = slots.where("begins and not goes_on").select("key", "first.at", "first.rank")
    longest = slots.agg(F.max(F.col("slot") - F.col("run") + 1)).first()[0] or 0
    if longest < 2:
        return alone
    several = slots.where("not begins or goes_on")
    rows = saved(times.join(several.select("key", "slot"), ["key", "slot"], "left_semi"), "candidates")
    marked = saved(several.where("begins").select("key", "first.at"), "stores")
    jumps = saved(_next_stores(rows, several, ttl_ms), "jumps")
    for _ in range(int(longest - 1).bit_length()):
        reached = marked.join(jumps, ["key", "at"]).select("key", F.col("to").alias("at"))
        marked = saved(marked.union(reached), "stores")
        further = jumps.select("key", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = saved(jumps.join(further, ["key", "to"]).select("key", "at", F.col("beyond").alias("to")), "jumps")
    return alone.union(rows.join(marked, ["key", "at"], "left_semi").select("key", "at", "rank"))


def _next_stores(rows: DataFrame, slots: DataFrame, ttl_ms: int) -> DataFrame:
    """(key, at, to): the first row at least ``ttl_ms`` after each row, where its run has one. It is
    in the next slot, which sees the row as a probe at its own time; or it begins the slot after."""
    probes = rows.select("key", (F.col("slot") + 1).alias("slot"), (F.col("at") + ttl_ms).alias("at"), F.lit(None).cast("bigint").alias("own"))
    both = rows.select("key", "slot", "at", F.col("at").alias("own")).union(probes)
    later = Window.partitionBy("key", "slot").orderBy(F.desc("at"), F.col("own").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("to", F.min("own").over(later)).where("own is null").select(
        "key", (F.col("at") - ttl_ms).alias("at"), (F.col("slot") + 1).alias("slot"), "to")
    return found.join(slots.where("not begins").select("key", "slot", "first"), ["key", "slot"], "left").select(
        "key", "at", F.coalesce("to", "first.at").alias("to")).where("to is not null")


def repeat_hits(
    requests: DataFrame, ttl: int = K.CACHE_TTL_SECONDS, key: str = "key", ts: str = "ts",
    request_id: str = "request_id", storable: Column | None = None,
) -> DataFrame:
    """Append ``is_hit`` to timed requests with a fingerprint: answered within ``ttl`` of a
    store, which a hit does not prolong.

    ``storable`` marks requests whose answer may be stored (2xx). Among requests of one
    millisecond the lowest request id stores. A request finds its store in its own slot or
    the one before, so it joins at most two rows on (key, slot): a hot key is spread over its
    slots, and adaptive execution splits a hot slot.
    """
    ttl_ms = ttl * 1000
    timed = requests.withColumns({
        "_key": F.col(key).cast("string"), "_at": F.unix_millis(F.col(ts).cast("timestamp")),
        "_rank": F.col(request_id).cast("string"),
    }).withColumn("_slot", F.floor(F.col("_at") / ttl_ms))
    may_store = timed.where(F.col("_key").isNotNull() & (F.lit(True) if storable is None else storable))
    stores = store_times(may_store.select(
        F.col("_key").alias("key"), F.col("_at").alias("at"), F.col("_rank").alias("rank")), ttl)
    slot = F.floor(F.col("at") / ttl_ms)
    both = stores.select(
        "key", F.explode(F.array(
            F.struct(slot.alias("slot"), F.struct("at", "rank").alias("own"), F.lit(None).cast("bigint").alias("before")),
            F.struct((slot + 1).alias("slot"), F.lit(None).cast("struct<at:bigint,rank:string>").alias("own"),
                     F.col("at").alias("before")),
        )).alias("s")).select("key", "s.*")
    alive = both.groupBy(F.col("key").alias("_key"), F.col("slot").alias("_slot")).agg(
        F.max("own").alias("_own"), F.max("before").alias("_before"))
    after_own = F.coalesce(F.struct(F.col("_at").alias("at"), F.col("_rank").alias("rank")) > F.col("_own"), F.lit(False))
    after_before = F.coalesce(F.col("_at") - F.col("_before") < ttl_ms, F.lit(False))
    return timed.join(alive, ["_key", "_slot"], "left").select(
        *requests.columns, (after_own | after_before).alias("is_hit"))


def prompt_cache_rewrite(df: DataFrame, body: str = "body", provider: str = "provider", url: str = "url") -> DataFrame:
    """Append ``outbound_body``, ``prompt_cached``, ``prefix_length``.

    A Messages request with a non-blank string ``system`` gets it as a text block with an
    ephemeral cache marker; other rows stay as they are.
    """
    path = F.rtrim(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit("/"))
    system = text_at(F.col("_json"), "$.system")
    block = F.to_json(F.array(F.struct(
        F.lit("text").alias("type"), F.col("_system").alias("text"),
        F.struct(F.lit("ephemeral").alias("type")).alias("cache_control"))))
    applies = F.coalesce(
        (F.lower(provider) == "anthropic") & path.endswith("/messages") & F.col("_system").rlike(r"(?U)\S"),
        F.lit(False))
    members = F.from_json(F.col(body), "map<string,variant>")
    rewritten = F.to_json(F.map_concat(members, F.create_map(F.lit("system"), F.parse_json(block))))
    return (
        df.withColumn("_json", parse_body(F.col(body))).withColumn("_system", system)
        .withColumn("prompt_cached", applies)
        .withColumn("outbound_body", F.when(F.col("prompt_cached"), rewritten).otherwise(F.col(body)))
        .withColumn("prefix_length", F.when(F.col("prompt_cached"), F.length("_system")))
        .drop("_json", "_system")
    )
