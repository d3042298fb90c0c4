"""Sinks: turn exports, report tables, STIX objects, case rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.functions import text as X
from gumshoe.operators.dedup import chronological
from gumshoe.operators.mitre import stix_observed_refs
from gumshoe.operators.scans import numbered

EXPORT_COLUMNS = ("timestamp", "platform", "role", "content", "model", "session_id", "source_file", "tool_command", "tool_input", "tool_description", "workspace", "also_in_tools")


def export_rows(turns: DataFrame) -> DataFrame:
    """Turns with the twelve stable columns (K1)."""
    also = F.array_join(F.col("also_in_tools"), ", ") if "also_in_tools" in turns.columns else F.lit("")
    return turns.select(*[also.alias(c) if c == "also_in_tools" else F.col(c) for c in EXPORT_COLUMNS])


def export_turns_csv(turns: DataFrame, path: str) -> None:
    """Write ``export_rows`` in time order as CSV with a header (K1, T2); files are ranges of time."""
    export_rows(chronological(turns, "timestamp", "source_file", "seq")).write.option("header", True).option("escape", '"').csv(path)


def manifest_rows(turns: DataFrame, files: DataFrame) -> DataFrame:
    """Row count, size, time and digest of each source file of an export (K2); ``files`` has content."""
    counts = turns.groupBy("source_file").agg(F.count("*").alias("row_count"))
    facts = files.select("source_file", F.octet_length("content").alias("size_bytes"), "modified_at", F.sha2("content", 256).alias("sha256"))
    return counts.join(facts, "source_file", "left")


def export_manifest(turns: DataFrame, files: DataFrame, path: str) -> None:
    manifest_rows(turns, files).write.json(path)


def write_report_tables(sections: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """One dataset per report section (K3)."""
    for name, df in sections.items():
        df.write.format(kind).mode("overwrite").save(f"{path}/{name}")


def stix_id(kind: str, *parts: Column) -> Column:
    """Object id derived from what the object is about, so reruns agree."""
    h = F.sha2(F.concat_ws("|", F.lit(kind), *parts), 256)
    return F.concat(F.lit(f"{kind}--"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def _object(df: DataFrame, kind: str, ident: tuple[Column, ...], **fields: Column) -> DataFrame:
    oid = stix_id(kind, *ident)
    body = F.struct(F.lit(kind).alias("type"), F.lit("2.1").alias("spec_version"), oid.alias("id"), *[v.alias(k) for k, v in fields.items()])
    return df.select(F.lit(kind).alias("type"), oid.alias("id"), F.to_json(body).alias("object"))


def stix_objects(iocs: DataFrame, findings: DataFrame, atlas: DataFrame, courses: DataFrame, links: DataFrame | None = None, name: str = "AI evidence report", grouping: int = 100, report: int = 500) -> DataFrame:
    """(type, id, object) rows of a STIX bundle (K4): identity, indicators, observed data, attack patterns, relationships, groupings, courses of action, notes, reports.

    References are numbered and dealt to as many grouping and report objects as hold ``grouping`` and
    ``report`` of them each, so none is left out.  ``links`` (id, value) says which indicator values a
    finding refers to (J10); more than ``grouping`` of them go to further observed-data objects.
    """
    spark = iocs.sparkSession
    one = spark.range(1)
    distinct = iocs.groupBy("kind", "value").agg(F.max_by("severity", X.severity_rank(F.col("severity"))).alias("severity"))
    indicator = _object(
        distinct, "indicator", (F.col("kind"), F.col("value")), name=F.concat(F.col("kind"), F.lit(": "), F.left("value", F.lit(80))), pattern=X.stix_pattern(F.col("kind"), F.col("value")), pattern_type=F.lit("stix"),
        confidence=X.stix_confidence(F.col("severity")), labels=F.array("kind"),
    )
    known = distinct.select("value", stix_id("indicator", F.col("kind"), F.col("value")).alias("indicator_id"))
    links = findings.select("id", F.lit(None).cast("string").alias("value")) if links is None else links
    told = findings.join(stix_observed_refs(links, known, grouping), "id", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    own = (F.col("id"), F.when(F.col("part") > 0, F.col("part").cast("string")))  # the first keeps the finding's own id
    observed = _object(told, "observed-data", own, number_observed=F.lit(1), name=F.col("title"), object_refs=F.col("refs"))
    techniques = atlas.select("technique_id", "technique_name").distinct()
    pattern = _object(techniques, "attack-pattern", (F.col("technique_id"),), name=F.col("technique_name"), external_id=F.col("technique_id"))
    uses = atlas.where(F.col("source_type") == "ioc").select("kind", "value", "technique_id").distinct()
    relation = _object(uses, "relationship", (F.col("kind"), F.col("value"), F.col("technique_id")), relationship_type=F.lit("indicates"), source_ref=stix_id("indicator", F.col("kind"), F.col("value")), target_ref=stix_id("attack-pattern", F.col("technique_id")))
    course = _object(courses, "course-of-action", (F.col("name"),), name=F.col("name"), description=F.col("description"))
    identity = _object(one, "identity", (F.lit(name),), name=F.lit(name), identity_class=F.lit("system"))
    note = _object(findings, "note", (F.col("id"),), content=F.col("description"), object_refs=F.array(stix_id("observed-data", F.col("id"))))

    def dealt(refs: DataFrame, kind: str, most: int, **fields: Column) -> DataFrame:
        chunks = numbered(refs.select("id"), ["id"], "n").groupBy(F.floor(F.col("n") / most).alias("part")).agg(F.array_sort(F.collect_list("id")).alias("refs"))
        return _object(chunks, kind, (F.lit(name), F.col("part").cast("string")), name=F.lit(name), **fields, object_refs=F.col("refs"))

    groups = dealt(indicator, "grouping", grouping, context=F.lit("suspicious-activity"))
    reports = dealt(indicator.unionByName(pattern).unionByName(observed), "report", report)
    out = identity
    for part in (indicator, observed, pattern, relation, course, note, groups, reports):
        out = out.unionByName(part)
    return out


# Indicator types of the case system.
CASE_TYPES = {
    "ip": "ip-any", "ipv4": "ip-dst", "ipv6": "ip-dst", "url": "url", "domain": "domain", "email": "email", "hash_md5": "md5", "hash_sha1": "sha1", "hash_sha256": "sha256", "filepath": "filename", "command": "text",
    "api_key": "authentihash", "exfil_pattern": "text", "credential": "text", "jailbreak": "text", "tool_abuse": "text", "exfiltration": "text", "model_manipulation": "text",
}


def case_rows(iocs: DataFrame) -> DataFrame:
    """Indicators shaped for a case system: type, value, amber, tag of the platform (K5)."""
    kinds = F.create_map(*[F.lit(x) for kv in CASE_TYPES.items() for x in kv])
    return iocs.select(
        F.coalesce(kinds[F.col("kind")], F.lit("other")).alias("ioc_type"), F.col("value").alias("ioc_value"), F.lit("amber").alias("tlp"), F.concat(F.lit("evidence:"), "platform").alias("tags"),
        F.concat(F.lit("From "), "source_file").alias("description"),
    ).distinct()


def case_events(events: DataFrame) -> DataFrame:
    """Timeline events shaped for a case system; titles of at most 255 characters (K5)."""
    return events.select(F.col("timestamp").alias("event_date"), F.left("description", F.lit(255)).alias("title"), F.col("severity").alias("category"), F.concat(F.lit("evidence:"), "platform").alias("tags"), "source_path")
