"""Mapping of indicators and findings to ATLAS and ATT&CK, kill chain, courses of action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gumshoe.operators.correlate import worst
from gumshoe.operators.scans import running_totals

# ATLAS techniques (id, name).
ATLAS = (
    ("AML.T0010", "Prompt Injection"), ("AML.T0011", "LLM Jailbreak"), ("AML.T0025", "Modify Model"), ("AML.T0043", "Craft Adversarial Input"), ("AML.T0048", "AI Tool Integration"),
    ("AML.T0049", "Exploit AI Tool Integration"), ("AML.T0050", "LLM Data Exfiltration"), ("AML.T0052", "LLM Prompt Leak"), ("AML.T0054", "AI-Generated Content"), ("AML.T0055", "LLM Credential Theft"),
)
# ATT&CK techniques (id, name, tactic).
ATTACK = (
    ("T1190", "Exploit Public-Facing Application", "Initial Access"), ("T1133", "External Remote Services", "Initial Access"), ("T1078", "Valid Accounts", "Initial Access"),
    ("T1059", "Command and Scripting Interpreter", "Execution"), ("T1203", "Exploitation for Client Execution", "Execution"), ("T1053", "Scheduled Task/Job", "Execution"),
    ("T1548", "Abuse Elevation Control Mechanism", "Privilege Escalation"), ("T1068", "Exploitation for Privilege Escalation", "Privilege Escalation"), ("T1087", "Account Discovery", "Discovery"),
    ("T1083", "File and Directory Discovery", "Discovery"), ("T1046", "Network Service Discovery", "Discovery"), ("T1005", "Data from Local System", "Collection"),
    ("T1039", "Data from Network Shared Drive", "Collection"), ("T1114", "Email Collection", "Collection"), ("T1041", "Exfiltration Over C2 Channel", "Exfiltration"),
    ("T1048", "Exfiltration Over Alternative Protocol", "Exfiltration"), ("T1567", "Exfiltration Over Web Service", "Exfiltration"), ("T1071", "Application Layer Protocol", "Command and Control"),
    ("T1573", "Encrypted Channel", "Command and Control"), ("T1105", "Ingress Tool Transfer", "Command and Control"), ("T1486", "Data Encrypted for Impact", "Impact"),
    ("T1565", "Data Manipulation", "Impact"), ("T1552", "Unsecured Credentials", "Credential Access"), ("T1119", "Automated Collection", "Collection"),
    ("T1189", "Drive-by Compromise", "Initial Access"), ("T1200", "Hardware Additions", "Initial Access"), ("T1592", "Gather Victim Host Information", "Reconnaissance"),
    ("T1595", "Active Scanning", "Reconnaissance"), ("T1590", "Gather Victim Network Information", "Reconnaissance"),
)
# ATT&CK techniques that an ATLAS technique implies.
ATLAS_TO_ATTACK = (
    ("AML.T0010", "T1190"), ("AML.T0010", "T1059"), ("AML.T0011", "T1190"), ("AML.T0011", "T1059"), ("AML.T0025", "T1565"), ("AML.T0025", "T1078"), ("AML.T0043", "T1203"),
    ("AML.T0048", "T1071"), ("AML.T0048", "T1105"), ("AML.T0049", "T1059"), ("AML.T0049", "T1548"), ("AML.T0050", "T1048"), ("AML.T0050", "T1567"), ("AML.T0052", "T1087"),
    ("AML.T0052", "T1083"), ("AML.T0054", "T1486"), ("AML.T0055", "T1552"),
)
# ATLAS technique of each indicator type.
IOC_ATLAS = (("api_key", "AML.T0055"), ("exfil_pattern", "AML.T0050"), ("command", "AML.T0049"), ("ip", "AML.T0048"), ("url", "AML.T0048"), ("domain", "AML.T0048"))
MODEL_FILE = r"(?i)(\.safetensors|\.gguf|\.bin|\.pt|\.onnx|model|weights|checkpoint)"
# Words of findings by ATLAS technique.
FINDING_WORDS = (
    ("AML.T0010", ("prompt injection", "injection", "ignore previous")), ("AML.T0011", ("jailbreak", "bypass safety", "dan mode")), ("AML.T0025", ("model tamper", "modify model", "model manipulation", "fine-tun")),
    ("AML.T0043", ("adversarial", "encoding attack")), ("AML.T0048", ("plugin", "tool integration", "mcp")), ("AML.T0049", ("tool abuse", "tool call", "command execution")),
    ("AML.T0050", ("exfiltrat", "data leak", "data theft")), ("AML.T0052", ("system prompt", "prompt leak")), ("AML.T0054", ("generated content", "phishing", "deepfake")),
    ("AML.T0055", ("credential", "api key", "token", "secret")),
)
# Words of findings by ATT&CK technique.
ATTACK_WORDS = (
    ("T1059", ("command", "script")), ("T1190", ("exploit",)), ("T1078", ("valid account", "stolen credential")), ("T1552", ("credential", "password", "api key")), ("T1048", ("exfiltrat",)),
    ("T1567", ("upload", "webhook")), ("T1071", ("c2", "beacon")), ("T1105", ("download", "wget", "curl")), ("T1548", ("sudo", "privilege")), ("T1053", ("cron", "scheduled")),
    ("T1083", ("directory listing", "file discovery")), ("T1005", ("local file", "sensitive file", "/etc/")), ("T1565", ("tamper", "modify model")),
)
STAGES = ("Reconnaissance", "Weaponization", "Delivery", "Exploitation", "Installation", "Command and Control", "Actions on Objectives")
# Kill-chain stages that indicator types light.
IOC_STAGES = (("ip", "Reconnaissance"), ("domain", "Reconnaissance"), ("url", "Reconnaissance"), ("url", "Delivery"), ("domain", "Delivery"), ("command", "Weaponization"), ("api_key", "Exploitation"), ("exfil_pattern", "Actions on Objectives"))
STAGE_WORDS = (
    ("Delivery", ("prompt injection", "phishing", "pasted")), ("Exploitation", ("jailbreak", "bypass", "exploit")), ("Installation", ("persist", "cron", "startup", "install")),
    ("Command and Control", ("beacon", "reverse shell", "c2")), ("Actions on Objectives", ("exfiltrat", "credential")), ("Reconnaissance", ("enumerat", "scan", "recon")),
)
# Courses of action by technique (technique, name, description), written for this engine.
COURSES = (
    ("AML.T0010", "Guard prompts", "Keep data and instructions apart; screen pasted content."), ("AML.T0011", "Harden safety rules", "Test refusals against known override phrases."),
    ("AML.T0025", "Pin models", "Check model files by digest before loading."), ("AML.T0043", "Guard prompts", "Normalize inputs before use."), ("AML.T0048", "Limit integrations", "Allow only reviewed tools."),
    ("AML.T0049", "Approve tool calls", "Ask before a tool writes or executes."), ("AML.T0050", "Watch outbound data", "Filter replies and outgoing traffic."), ("AML.T0052", "Protect system prompts", "Detect replies that repeat them."),
    ("AML.T0054", "Label generated content", "Mark and review generated material."), ("AML.T0055", "Rotate credentials", "Revoke exposed keys and store secrets in a vault."),
    ("T1059", "Approve tool calls", "Restrict interpreters."), ("T1078", "Rotate credentials", "Require a second factor."), ("T1552", "Rotate credentials", "Scan for plain-text secrets."), ("T1048", "Watch outbound data", "Block unusual protocols."),
)


def named(spark: SparkSession, rows, *names: str) -> DataFrame:
    return spark.createDataFrame(list(rows), list(names))


def words_hit(text: Column, table) -> Column:
    """Keys of ``table`` of which a word occurs in lower-case ``text``."""
    hits = [F.when(_any(text, words), F.lit(key)) for key, words in table]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def _any(text: Column, words) -> Column:
    out = None
    for w in words:
        out = text.contains(w) if out is None else out | text.contains(w)
    return out


def atlas_map_iocs(iocs: DataFrame) -> DataFrame:
    """ATLAS technique of each indicator by type; paths that look like model files are T0025."""
    spark = iocs.sparkSession
    by_type = F.broadcast(named(spark, IOC_ATLAS, "kind", "by_type"))
    names = F.broadcast(named(spark, ATLAS, "technique_id", "technique_name"))
    model = (F.col("kind") == "filepath") & F.col("value").rlike(MODEL_FILE)
    rows = iocs.join(by_type, "kind", "left").withColumn("technique_id", F.when(model, "AML.T0025").otherwise(F.col("by_type"))).drop("by_type")
    rows = rows.where("technique_id is not null").join(names, "technique_id")
    confidence = F.when(F.col("severity").isin("critical", "high"), "high").when(F.col("severity") == "medium", "medium").otherwise("low")
    return rows.withColumns({"source_type": F.lit("ioc"), "confidence_label": confidence})


def atlas_map_findings(findings: DataFrame) -> DataFrame:
    """ATLAS techniques of each finding by words of title and description; severe ones without any are T0049."""
    text = F.lower(F.concat_ws(" ", "title", "description"))
    found = words_hit(text, FINDING_WORDS)
    found = F.when((F.size(found) == 0) & F.col("severity").isin("critical", "high"), F.array(F.lit("AML.T0049"))).otherwise(found)
    if "iocs" in findings.columns:
        hint = lambda rx, t: F.when(F.exists("iocs", lambda i: F.lower(i).rlike(rx)), F.array(F.lit(t))).otherwise(F.array().cast("array<string>"))
        found = F.array_union(F.array_union(found, hint(r"sk-|ghp_|api_key|key-", "AML.T0055")), hint(r"curl|exfil|base64", "AML.T0050"))
    rows = findings.select("id", "severity", "platform", F.explode(found).alias("technique_id"))
    return rows.join(F.broadcast(named(findings.sparkSession, ATLAS, "technique_id", "technique_name")), "technique_id").withColumn("source_type", F.lit("finding"))


def attack_map(atlas: DataFrame, findings: DataFrame, iocs: DataFrame) -> DataFrame:
    """ATT&CK techniques with counts: implied by ATLAS matches, by finding words, by credential and exfiltration indicators."""
    spark = atlas.sparkSession
    implied = atlas.join(F.broadcast(named(spark, ATLAS_TO_ATTACK, "technique_id", "attack_id")), "technique_id").groupBy("attack_id").agg(F.count("*").alias("n"))
    text = F.lower(F.concat_ws(" ", "title", "description"))
    flags = findings.agg(*[F.coalesce(F.bool_or(_any(text, w)), F.lit(False)).alias(t) for t, w in ATTACK_WORDS])
    # The first keyword hit on a technique not yet mapped opens it at 0; one already mapped gains 1.
    worded = flags.select(F.explode(F.filter(F.array(*[F.when(F.col(t), F.lit(t)) for t, _ in ATTACK_WORDS]), lambda x: x.isNotNull())).alias("attack_id")).withColumn("w", F.lit(1))
    present = iocs.where(F.col("kind").isin("api_key", "exfil_pattern")).select("kind").distinct()
    present = present.select(F.when(F.col("kind") == "api_key", "T1552").otherwise("T1048").alias("attack_id"), F.lit(1).alias("p"))
    rows = implied.join(worded, "attack_id", "full").join(present, "attack_id", "full")
    n = F.when(F.col("n").isNotNull(), F.col("n") + F.coalesce("w", F.lit(0))).when(F.col("p").isNotNull(), F.lit(1)).otherwise(0)
    out = rows.select("attack_id", n.cast("long").alias("n")).join(F.broadcast(named(spark, ATTACK, "attack_id", "name", "tactic")), "attack_id", "left")
    return out.orderBy(F.desc("n"), "attack_id")


def merge_attack(mapped: DataFrame, indicators: DataFrame) -> DataFrame:
    """``mapped`` and the techniques that detectors name and it lacks."""
    named_by = indicators.select(F.explode("attack").alias("attack_id")).groupBy("attack_id").agg(F.count("*").alias("n"))
    fresh = named_by.join(mapped, "attack_id", "left_anti").join(F.broadcast(named(mapped.sparkSession, ATTACK, "attack_id", "name", "tactic")), "attack_id", "left")
    return mapped.unionByName(fresh.select(*mapped.columns))


def atlas_summary(matches: DataFrame) -> DataFrame:
    """Techniques by number of matches, with worst severity and platforms."""
    grouped = matches.groupBy("technique_id", "technique_name")
    return grouped.agg(F.count("*").alias("n"), worst().alias("severity"), F.array_sort(F.collect_set("platform")).alias("platforms")).orderBy(F.desc("n"), "technique_id")


def kill_chain(findings: DataFrame, iocs: DataFrame, atlas: DataFrame, most: int = 5) -> DataFrame:
    """All seven stages with whether anything lights them, how much, and sample evidence."""
    spark = findings.sparkSession
    by_type = iocs.groupBy("kind").agg(F.count("*").alias("n")).join(F.broadcast(named(spark, IOC_STAGES, "kind", "stage")), "kind")
    lit = by_type.select("stage", F.concat(F.lit("ioc:"), "kind").alias("evidence"), "n")
    text = F.lower(F.concat_ws(" ", "title", "description"))
    worded = findings.select(F.explode(words_hit(text, STAGE_WORDS)).alias("stage"), F.concat(F.lit("finding:"), "category").alias("evidence")).groupBy("stage", "evidence").agg(F.count("*").alias("n"))
    mapped = atlas.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("Exploitation").alias("stage"), F.lit("atlas").alias("evidence"), "n")
    every = lit.unionByName(worded).unionByName(mapped).groupBy("stage").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.collect_set("evidence")), 1, most).alias("evidence"))
    stages = named(spark, enumerate(STAGES), "no", "stage")
    out = stages.join(every, "stage", "left")
    return out.select("no", "stage", F.col("n").isNotNull().alias("detected"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence")).orderBy("no")


def coa_lookup(techniques: DataFrame, column: str = "technique_id") -> DataFrame:
    """Course of action of each technique, the first of each name."""
    table = named(techniques.sparkSession, [(n, *c) for n, c in enumerate(COURSES)], "no", column, "name", "description")
    hits = techniques.select(column).distinct().join(F.broadcast(table), column)
    return hits.groupBy("name").agg(F.min_by(F.struct(column, "description"), "no").alias("r")).select("name", f"r.{column}", "r.description")


def stix_observed_refs(links: DataFrame, indicators: DataFrame, most: int = 100) -> DataFrame:
    """(id, part, refs): indicator ids that each finding's values refer to, ``most`` a part; of equal values the last id.

    ``links``: id, value; ``indicators``: value, indicator_id.  Findings whose values are no indicators
    have one part without references.
    """
    last = indicators.groupBy("value").agg(F.max("indicator_id").alias("indicator_id"))
    hits = links.join(last, "value").select("id", "indicator_id").distinct()
    nth = running_totals(hits, ["id"], ["indicator_id"], {"nth": F.lit(1)}).withColumn("part", F.floor((F.col("nth") - 1) / most).cast("int"))
    refs = nth.groupBy("id", "part").agg(F.array_sort(F.collect_list("indicator_id")).alias("refs"))
    none = links.select("id").distinct().join(refs.select("id"), "id", "left_anti")
    return refs.unionByName(none.select("id", F.lit(0).alias("part"), F.array().cast("array<string>").alias("refs")))


def indicator_event_time(indicators: DataFrame, manifest: DataFrame) -> DataFrame:
    """Time of an indicator: its file's change time, else when it was collected."""
    times = manifest.select(F.col("original_path").alias("source_file"), F.coalesce("modified_at", "collected_at").alias("event_time"))
    return indicators.join(times, "source_file", "left")
