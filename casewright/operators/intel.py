"""Threat intelligence: indicators, feed rows, cached results with an expiry, and community reports.

A provider is a DataFrame ``(type, value, verdict, …)`` joined in. Intelligence is context from a named source,
kept per provider and never merged into one verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import net, scalars

# --- Fixed values: shapes, limits, verdicts, lifetimes -------------------------------------------------------------
DOMAIN = r"^(?=.{4,253}$)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z][a-z0-9-]{1,62}$"
DIGEST_LENGTHS = (32, 40, 64, 128)
VERDICTS = ("malicious", "suspicious", "benign", "unknown")
VERDICT_RANK = {"malicious": 3, "suspicious": 2, "benign": 1, "unknown": 0}
FOUND, NOT_FOUND, ERROR = "found", "not_found", "error"
MAX_TAGS, MAX_TAG, MAX_REFERENCES, MAX_RELATED, MAX_SUMMARY, MAX_ERROR = 20, 64, 10, 20, 500, 200
MAX_REPORTS_NAMED, MAX_PASSIVE_DNS = 5, 10
DEFAULT_TTL_MS = 24 * 3_600_000
FEED_TTL_MS = 3_600_000
ERROR_RETRY_MS = 15 * 60_000
# ------------------------------------------------------------------------------------------------------------


def indicator_value(kind: Column, value: Column) -> Column:
    """The normalised value, null when it is not something that may be looked up."""
    text = F.lower(F.trim(value))
    address = F.when(net.is_external_ip(text), net.canonical_ip(text))
    name = F.rtrim(text, F.lit("."))
    return (
        F.when(kind == "ip", address)
        .when(kind == "domain", F.when(name.rlike(DOMAIN), name))
        .when(
            kind == "hash",
            F.when(F.length(text).isin(*DIGEST_LENGTHS) & text.rlike("^[0-9a-f]+$"), text),
        )
    )


def parse_indicator(key: Column) -> Column:
    """``struct(type, value)`` of a ``type:value`` key, null when it is not an indicator."""
    kind = F.lower(F.trim(F.substring_index(key, ":", 1)))
    value = indicator_value(kind, F.regexp_replace(key, "^[^:]*:", ""))
    return F.when(key.contains(":") & value.isNotNull(), F.struct(kind.alias("type"), value.alias("value")))


def feed_rows(raw: DataFrame, default_source: str = "local feed") -> DataFrame:
    """Feed records with ``is_valid``: bad rows are kept, marked and counted, never half-loaded.

    ``raw`` has text columns ``type, value, verdict, confidence, source, description, tags, reference,
    first_seen, last_seen`` and ``position``; ``tags`` may be text separated by ';' or an array.
    """
    have = set(raw.columns)

    def text(name: str) -> Column:
        return scalars.blank_to_null(F.col(name).cast("string")) if name in have else F.lit(None).cast("string")

    kind = F.lower(text("type"))
    verdict = F.coalesce(F.lower(text("verdict")), F.lit("unknown"))
    confidence = text("confidence").try_cast("int")
    tags = F.col("tags") if "tags" in have else F.lit(None).cast("string")
    if not ("tags" in have and raw.schema["tags"].dataType.typeName() == "array"):
        tags = F.split(F.coalesce(tags, F.lit("")), ";")
    tags = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")

    def bad_time(name: str) -> Column:
        return text(name).isNotNull() & scalars.event_time(text(name)).isNull()

    value = indicator_value(kind, text("value"))
    valid = (
        value.isNotNull()
        & verdict.isin(*VERDICTS)
        & (text("confidence").isNull() | F.coalesce(confidence.between(0, 100), F.lit(False)))
        & ~bad_time("first_seen")
        & ~bad_time("last_seen")
    )
    source = F.coalesce(text("source"), F.lit(default_source))
    summary = F.coalesce(F.concat(source, F.lit(": "), text("description")), F.concat(F.lit("Listed in "), source))
    reference = text("reference")
    return raw.select(
        "position",
        F.coalesce(valid, F.lit(False)).alias("is_valid"),
        kind.alias("type"),
        value.alias("value"),
        verdict.alias("verdict"),
        confidence.alias("confidence"),
        summary.alias("summary"),
        tags.alias("tags"),
        F.filter(F.array(reference), lambda r: r.startswith("https://")).alias("references"),
        scalars.event_time(text("first_seen")).alias("provider_first_seen"),
        scalars.event_time(text("last_seen")).alias("provider_last_seen"),
    )


def feed(rows: DataFrame) -> DataFrame:
    """The usable indicators of a feed; the last row wins when one repeats."""
    good = rows.filter("is_valid").drop("is_valid")
    fields = [c for c in good.columns if c not in ("type", "value")]
    latest = good.groupBy("type", "value").agg(F.max_by(F.struct(*fields), "position").alias("row"))
    return latest.select("type", "value", "row.*").drop("position")


def feed_counts(rows: DataFrame) -> DataFrame:
    """How many rows were read and how many skipped."""
    return rows.agg(F.count("*").alias("rows_read"), F.count_if(~F.col("is_valid")).alias("rows_skipped"))


RESULT_COLUMNS = (
    "provider",
    "type",
    "value",
    "status",
    "verdict",
    "summary",
    "confidence",
    "tags",
    "references",
    "provider_first_seen",
    "provider_last_seen",
    "error",
    "retrieved_ms",
    "expires_ms",
)


def intel_results(answers: DataFrame, provider: str, now_ms: Column, ttl_ms: int = DEFAULT_TTL_MS) -> DataFrame:
    """Result rows from lookups: ``answers`` has ``type, value``, a null ``verdict`` where the provider knew
    nothing, and optionally ``error`` where it could not be asked."""
    have = set(answers.columns)

    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    failed = given("error", "string").isNotNull()
    found = ~failed & F.col("verdict").isNotNull()
    tags = F.transform(F.coalesce(given("tags", "array<string>"), F.array().cast("array<string>")), lambda t: F.substring(t, 1, MAX_TAG))
    references = F.filter(
        F.coalesce(given("references", "array<string>"), F.array().cast("array<string>")), lambda r: r.startswith("https://")
    )
    none = F.array().cast("array<string>")
    return answers.select(
        F.lit(provider).alias("provider"),
        "type",
        "value",
        F.when(failed, ERROR).when(found, FOUND).otherwise(NOT_FOUND).alias("status"),
        F.when(found, F.col("verdict")).otherwise("unknown").alias("verdict"),
        F.when(failed, F.lit("The provider could not be reached."))
        .when(found, F.substring(given("summary", "string"), 1, MAX_SUMMARY))
        .otherwise("No information from this provider.")
        .alias("summary"),
        F.when(found, F.greatest(F.lit(0), F.least(F.lit(100), given("confidence", "int")))).alias("confidence"),
        F.when(found, F.slice(F.array_distinct(F.filter(tags, lambda t: t != "")), 1, MAX_TAGS)).otherwise(none).alias("tags"),
        F.when(found, F.slice(references, 1, MAX_REFERENCES)).otherwise(none).alias("references"),
        F.when(found, given("provider_first_seen", "timestamp")).alias("provider_first_seen"),
        F.when(found, given("provider_last_seen", "timestamp")).alias("provider_last_seen"),
        F.substring(given("error", "string"), 1, MAX_ERROR).alias("error"),
        now_ms.cast("long").alias("retrieved_ms"),
        (now_ms.cast("long") + F.when(failed, ERROR_RETRY_MS).otherwise(ttl_ms)).alias("expires_ms"),
    )


def stale_indicators(indicators: DataFrame, cached: DataFrame, provider: str, now_ms: Column) -> DataFrame:
    """Indicators without a cached answer that is still fresh."""
    fresh = cached.filter((F.col("provider") == provider) & (F.col("expires_ms") > now_ms)).select("type", "value")
    return indicators.select("type", "value").distinct().join(fresh, ["type", "value"], "left_anti")


def enrich(
    indicators: DataFrame,
    provider_rows: DataFrame,
    cached: DataFrame | None,
    provider: str,
    now_ms: Column,
    ttl_ms: int = DEFAULT_TTL_MS,
) -> DataFrame:
    """Answers for the indicators that need one. Spark broadcasts the provider's rows when their measured size
    allows it and shuffles on (type, value) otherwise."""
    wanted = indicators.select("type", "value").distinct() if cached is None else stale_indicators(indicators, cached, provider, now_ms)
    return intel_results(wanted.join(provider_rows, ["type", "value"], "left"), provider, now_ms, ttl_ms)


def lookup_report(keys: DataFrame, results: DataFrame) -> DataFrame:
    """Every asked key with the cached results, or marked as not being an indicator."""
    asked = keys.select("key", parse_indicator(F.col("key")).alias("i")).select(
        "key", F.col("i.type").alias("type"), F.col("i.value").alias("value"), F.col("i").isNull().alias("invalid")
    )
    return asked.join(results, ["type", "value"], "left").select(
        "key", "type", "value", "invalid", "provider", "status", "verdict", "summary"
    )


def worst_verdicts(results: DataFrame) -> DataFrame:
    """The most severe thing any provider found about each indicator; the first provider of equals."""
    rank = F.create_map(*[F.lit(x) for pair in VERDICT_RANK.items() for x in pair])
    found = results.filter(F.col("status") == FOUND).withColumn("rank", F.coalesce(F.element_at(rank, F.col("verdict")), F.lit(0)))
    best = found.groupBy("type", "value").agg(
        F.min_by(F.struct("provider", "verdict"), F.struct((-F.col("rank")).alias("r"), F.col("provider"))).alias("best")
    )
    return best.select("type", "value", "best.provider", "best.verdict")


def community_answers(indicators: DataFrame, reports: DataFrame, allowlist: DataFrame, passive_dns: DataFrame) -> DataFrame:
    """Provider answers from community data: allowlisted is benign, reported is suspicious, only passive DNS
    is unknown, nothing is not found.

    ``reports(type, value, report_id, name, tags, created, modified)``, ``allowlist(type, value, name)``,
    ``passive_dns(type, value, related, position)``. The first five reports are named, so lists are cut
    by rank before they are gathered.
    """
    from pyspark.sql import Window as W

    keys = ["type", "value"]
    wanted = indicators.select(*keys).distinct()
    counted = reports.join(wanted, keys, "left_semi")
    order = W.partitionBy(*keys).orderBy("report_id")
    named = (
        counted.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= MAX_REPORTS_NAMED)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "name"))).alias("_named"))
    )
    tags = (
        counted.select(*keys, F.explode_outer("tags").alias("tag"))
        .filter(F.col("tag").isNotNull())
        .groupBy(*keys, "tag")
        .count()
        .withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy("tag")))
        .filter(F.col("_rank") <= MAX_TAGS)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    )
    totals = counted.groupBy(*keys).agg(
        F.count("*").alias("reports"), F.min("created").alias("provider_first_seen"), F.max("modified").alias("provider_last_seen")
    )
    allowed = (
        allowlist.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_set("name")).alias("_allowed"))
    )
    related = (
        passive_dns.filter(F.col("type") != "hash")
        .join(wanted, keys, "left_semi")
        .withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy("position", "related")))
        .filter(F.col("_rank") <= MAX_PASSIVE_DNS)
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "related"))), lambda r: r["related"]).alias("related"))
    )
    joined = wanted
    for part in (totals, named, tags, allowed, related):
        joined = joined.join(part, keys, "left")
    count = F.coalesce("reports", F.lit(0))
    benign, suspicious = F.col("_allowed").isNotNull(), count > 0
    names = F.transform(F.slice("_named", 1, 3), lambda r: r["name"])
    summary = (
        F.when(
            benign,
            F.concat(F.lit("On an allowlist ("), F.array_join("_allowed", ", "), F.lit("); referenced in "), count.cast("string"), F.lit(" report(s).")),
        )
        .when(
            suspicious,
            F.concat(F.lit("Referenced in "), count.cast("string"), F.lit(" community report(s): "), F.array_join(names, "; ")),
        )
        .when(F.col("related").isNotNull(), F.lit("Not referenced in any report; passive DNS only."))
    )
    return joined.select(
        *keys,
        F.when(benign, "benign").when(suspicious, "suspicious").when(F.col("related").isNotNull(), "unknown").alias("verdict"),
        summary.alias("summary"),
        "tags",
        "related",
        F.when(suspicious & ~benign, F.col("provider_first_seen")).alias("provider_first_seen"),
        F.when(suspicious & ~benign, F.col("provider_last_seen")).alias("provider_last_seen"),
    )
