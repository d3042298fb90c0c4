"""Registered queries of reports, rules and the whole timeline, and SQL twins of report queries registered elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gumshoe.functions import text as X
from gumshoe.operators import correlate, detect, inventory, mitre, risk, timeline
from gumshoe.operators import rules as R
from gumshoe.plans import planted, sql
from gumshoe.plans import registry as G
from gumshoe.plans.registry import ORACLES, by_rule, evidence, iocs, load, query, told_once, turns
from gumshoe.sources import sinks, transcripts
from gumshoe.sources.shared import scratch

# --- SQL twins -----------------------------------------------------------------------------------------------------

_LIST = lambda words: "[" + ", ".join(map(sql.lit, words)) + "]"

ORACLES["conv_base64"] = (
    f"WITH {sql.TURNS}, b AS (SELECT platform, session_id, seq, unnest(regexp_extract_all(content, {sql.lit(X.BASE64_BLOCK)})) AS block FROM turns), d AS (SELECT *, decode(try(from_base64(block)), 'replace') AS decoded FROM b), "
    f"k AS (SELECT *, list_filter({_LIST(R.CONV_KEYWORDS)}, lambda w: contains(lower(decoded), w))[1] AS keyword FROM d WHERE decoded IS NOT NULL) "
    "SELECT platform, session_id, seq, keyword, left(decoded, 200) AS value, 'high' AS severity, 75 AS risk_score FROM k WHERE keyword IS NOT NULL"
)

_NAMES = sql.values(mitre.ATTACK, "attack_id, name, tactic")
_RULE_ATTACK = sql.values([(r.id, a) for r in R.AI_RULES for a in r.attack], "rule, attack_id")

ORACLES["merge_attack"] = (
    f"WITH m AS ({ORACLES['attack_map']}), {sql.WITH_PLANTED}, {G._IND}, x AS (SELECT attack_id, count(*) AS n FROM ind JOIN {_RULE_ATTACK} r USING (rule) GROUP BY ALL), "
    f"u AS (SELECT * FROM m UNION ALL SELECT * FROM x WHERE attack_id NOT IN (SELECT attack_id FROM m)) SELECT attack_id, n, name, tactic FROM u LEFT JOIN {_NAMES} k USING (attack_id)"
)

ORACLES["enhanced_basic"] = (
    f"WITH o AS ({ORACLES['risk_overall']}), {sql.WITH_PLANTED}, {sql.iocs()}, {G._IND}, {G._FIND}, t AS (SELECT coalesce(bool_or({sql.holds(G._FTEXT, ('supply chain', 'package', 'dependency'))}), false) AS a, "
    f"coalesce(bool_or({sql.holds(G._FTEXT, ('tamper', 'integrity', 'poison'))}), false) AS b, coalesce(bool_or({sql.holds(G._FTEXT, ('compliance', 'pii', 'personal data'))}), false) AS c FROM fnd), i AS (SELECT count(*) AS n FROM iocs WHERE kind IN ('ip', 'url', 'domain')) "
    "SELECT credentials, exfiltration, jailbreak, autonomy, CAST(least(25, 5 * i.n) AS INT) AS network_exposure, CASE WHEN a THEN 15 ELSE 0 END AS supply_chain, CASE WHEN b THEN 10 ELSE 0 END AS data_integrity, CASE WHEN c THEN 5 ELSE 0 END AS compliance FROM o, t, i"
)

_TEMPLATES = sql.values([(n, t, c) for n, (t, cs) in enumerate(risk.NARRATIVES) for c in cs], "no, title, category")

ORACLES["narratives8"] = (
    f"{G._rules8_sql()}, {G._I8}, x AS (SELECT * FROM r8 UNION ALL SELECT * FROM i8), y AS (SELECT * FROM x JOIN {_TEMPLATES} t USING (category)), "
    "f AS (SELECT scope, no, title, count(*) AS n_indicators, round(sum(confidence) / count(*), 3) AS confidence, list_sort(list(DISTINCT category)) AS shared, "
    "CASE WHEN max(confidence) >= 1.0 THEN 'critical' WHEN max(confidence) >= 0.8 THEN 'high' WHEN max(confidence) >= 0.6 THEN 'medium' ELSE 'low' END AS severity, list(label ORDER BY confidence DESC, weight DESC, label)[1:5] AS top_indicators FROM y GROUP BY scope, no, title), "
    "g AS (SELECT scope, 99 AS no, 'General AI Risk' AS title, count(*) AS n_indicators, round(sum(confidence) / count(*), 3) AS confidence, CAST([] AS VARCHAR[]) AS shared, 'medium' AS severity, list(label ORDER BY weight DESC, label)[1:5] AS top_indicators FROM x WHERE scope NOT IN (SELECT scope FROM f) GROUP BY scope) "
    "SELECT * FROM f UNION ALL SELECT * FROM g"
)

_STORIES = (("Credential exposure", ("credential", "key", "secret", "token")), ("Safety bypass", ("jailbreak", "bypass", "injection")), ("Data exfiltration", ("exfil", "upload", "smuggl")), ("Agent activity", ("tool", "command", "agent")))

ORACLES["narratives_report"] = (
    f"WITH {sql.WITH_PLANTED}, {sql.iocs()}, {G._IND}, {G._FIND}, h AS ({' UNION ALL '.join(f'SELECT {sql.lit(t)} AS narrative, id, platform FROM fnd WHERE {sql.holds(G._FTEXT, w)}' for t, w in _STORIES)}), p AS (SELECT list(DISTINCT platform) AS q FROM iocs) "
    "SELECT narrative, count(*) AS n_findings, list(DISTINCT id ORDER BY id)[1:5] AS refs, list_sort(list_distinct(list_concat(list(DISTINCT platform), first(q)))) AS platforms FROM h, p GROUP BY narrative"
)

_T8 = G._told8_sql()

ORACLES["priority_actions"] = (
    f"{_T8}, a AS ({' UNION ALL '.join(f'SELECT scope, {u} AS urgency, {sql.lit(a)} AS action, {sql.lit(c)} AS category FROM t8 WHERE {c} >= {least}' for c, least, u, a in risk.ACTIONS)}), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY scope ORDER BY urgency DESC, action, category) AS INT) AS rank FROM a) SELECT scope, rank, action, category, urgency FROM r WHERE rank <= 5"
)


def _preview(text: str, most: int = 120) -> str:
    return f"trim(translate(left({text}, {most}), chr(10), ' '))"


def _severity(text: str, role: str | None = None) -> str:
    tests = [f"WHEN regexp_matches(coalesce({text}, ''), {sql.lit(p)}) THEN '{s}'" for s, p in X.SEVERITY_PATTERNS]
    if role:
        tests.append(f"WHEN lower({role}) = 'user' AND regexp_matches(coalesce({text}, ''), {sql.lit(X.SYSTEM_INTERNALS)}) THEN 'medium'")
    return f"CASE {' '.join(tests)} ELSE 'info' END"


def _rank(of: str) -> str:
    return sql.RANK.replace("CASE severity", f"CASE {of}")


_WHO = "CASE WHEN lower(role) IN ('user', 'human') THEN 'User prompt' WHEN lower(role) IN ('assistant', 'ai', 'model') THEN 'Assistant response' WHEN lower(role) IN ('tool', 'function') THEN 'Tool output' WHEN lower(role) = 'system' THEN 'System message' ELSE 'Message' END"
_SAID = f"'[' || platform || '] ' || {_WHO} || ': ''' || {_preview('t', 80)} || ''''"

ORACLES["turn_timeline"] = (
    f"WITH {sql.TURNS}, {sql.WITH_PLANTED}, {G._IND}, a AS (SELECT platform, 'conversation' AS artifact_type, {_SAID} AS d, {_preview('t')} AS p, {_severity('content', 'role')} AS severity, '1:' || session_id || ':' || lpad(CAST(seq AS VARCHAR), 12, '0') AS o FROM (SELECT *, coalesce(content, '') AS t FROM turns) "
    f"UNION ALL SELECT platform, 'config', 'Configuration ' || source_file, {_preview('content')}, {_severity('content')}, '3:' || source_file FROM ev "
    f"UNION ALL SELECT platform, 'indicator', 'Indicator ' || kind || ': ' || left(value, 80), {_preview('value')}, {sql.label(f'greatest({sql.RANK}, {_rank(_severity("value"))})')}, '4:' || source_file || ':' || kind || ':' || value FROM ind), "
    "b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY platform, artifact_type, coalesce(nullif(p, ''), left(d, 80)) ORDER BY -length(d), o) = 1) SELECT artifact_type, severity, count(*) AS n FROM b GROUP BY ALL"
)

_PAST = f"hist AS (SELECT url, CAST(1 AS BIGINT) AS visit_count, page_id * 1000000 + 13370000000000000 AS last FROM pages UNION ALL SELECT url, CAST(visits AS BIGINT), last FROM {sql.values(planted.HISTORY, 'url, title, visits, last')})"

ORACLES["browser_history"] = f"WITH {_PAST}, p AS (SELECT *, {G._URLP} AS provider FROM hist) SELECT url, provider, visit_count, CASE WHEN last <> 0 THEN make_timestamp(last - 11644473600000000) END AS visited_at FROM p WHERE provider <> {sql.lit(G.lookup.UNKNOWN_PROVIDER)} ORDER BY last DESC, url LIMIT 500"

_MASK = r"(?im)^([ \t]*(?:export[ \t]+)?[A-Za-z0-9_]*(?:key|secret|token|password|credential)[A-Za-z0-9_]*[ ]*=)[^\n]*$"

ORACLES["env_redaction"] = f"WITH {sql.WITH_PLANTED}, m AS (SELECT source_file, content AS was, regexp_replace(content, {sql.lit(_MASK)}, '\\1[REDACTED]', 'g') AS content FROM ev) SELECT source_file, content, 'critical' AS severity FROM m WHERE content <> was"

_FOUND = lambda p, t="content": f"len(regexp_extract_all({t}, {sql.lit(p)}))"

ORACLES["log_stats"] = (
    f"WITH {sql.WITH_PLANTED}, t AS (SELECT *, lower(content) AS x FROM ev), "
    f"s AS (SELECT platform, 'log' AS kind, CASE WHEN {_FOUND(r'\bsk-[A-Za-z0-9_-]{20,}\b')} > 0 THEN 'high' ELSE 'info' END AS severity FROM ev WHERE regexp_matches(content, '(?i)\\b(?:error|exception|traceback|failed)\\b') OR regexp_matches(content, {sql.lit(r'''(?i)\bmodel["']?[ ]*[:=][ ]*["']?([A-Za-z0-9._/-]+)''')})), "
    "c AS (SELECT platform, 'config' AS kind, CASE WHEN contains(x, 'api_key') OR contains(x, 'apikey') OR contains(x, 'token') OR contains(x, 'secret') THEN 'high' ELSE 'medium' END AS severity FROM t WHERE regexp_matches(x, 'mcp_?servers?|\\[mcp') OR contains(x, 'api_key') OR contains(x, 'apikey') OR contains(x, 'token') OR contains(x, 'secret')), "
    "l AS (SELECT platform, unnest(string_split(content, chr(10))) AS line FROM ev), "
    "k AS (SELECT platform, 'command' AS kind, CASE WHEN regexp_matches(lower(line), 'password|secret|token|credential|api_key') THEN 'medium' ELSE 'info' END AS severity FROM l WHERE regexp_matches(line, '^[ \\t]*(?:\\$|>|#|%)[ \\t]+[^ \\t]')), "
    "g AS (SELECT platform, 'settings' AS kind, CASE WHEN regexp_matches(x, 'api_?key') OR contains(x, 'password') THEN 'high' WHEN contains(x, 'goals') AND regexp_matches(x, '(?m)^[ \\t]*-[ \\t]+[^ \\t\\n]') THEN 'medium' END AS severity FROM t) "
    "SELECT platform, kind, severity, count(*) AS n FROM (SELECT * FROM s UNION ALL SELECT * FROM c UNION ALL SELECT * FROM k UNION ALL SELECT * FROM g WHERE severity IS NOT NULL) GROUP BY ALL"
)

# --- STIX ----------------------------------------------------------------------------------------------------------

_COURSES = sql.values([c[:2] for c in mitre.COURSES], "technique_id, name")
_LEN = lambda n, most: f"CAST(ceil({n} / {most}.0) AS BIGINT)"


@query(
    f"WITH {sql.WITH_PLANTED}, {sql.iocs()}, {G._IND}, {G._FIND}, {G._ATL}, i AS (SELECT DISTINCT kind, value FROM iocs), o AS (SELECT DISTINCT kind, value, source_file FROM fi WHERE confidence >= 0.7), "
    "n AS (SELECT (SELECT count(*) FROM i) AS ni, (SELECT count(*) FROM o) AS nf, (SELECT count(*) FROM o WHERE value IN (SELECT value FROM i)) AS nr, (SELECT count(DISTINCT technique_id) FROM atlas) AS nt), "
    f"r AS (SELECT 'identity' AS type, 1 AS n, 0 AS refs UNION ALL SELECT 'indicator', ni, 0 FROM n UNION ALL SELECT 'observed-data', nf, nr FROM n UNION ALL SELECT 'note', nf, nf FROM n UNION ALL SELECT 'attack-pattern', nt, 0 FROM n UNION ALL SELECT 'relationship', (SELECT count(*) FROM (SELECT DISTINCT kind, value, technique_id FROM atlas)), 0 FROM n "
    f"UNION ALL SELECT 'course-of-action', (SELECT count(DISTINCT name) FROM {_COURSES} c WHERE technique_id IN (SELECT technique_id FROM atlas)), 0 FROM n UNION ALL SELECT 'grouping', {_LEN('ni', 100)}, ni FROM n UNION ALL SELECT 'report', {_LEN('(ni + nt + nf)', 500)}, ni + nt + nf FROM n) "
    "SELECT type, CAST(n AS BIGINT) AS n, CAST(refs AS BIGINT) AS refs FROM r WHERE n > 0"
)
def stix_counts(spark, sf_dir):
    """STIX objects and the references they hold, by type."""
    held = F.coalesce(F.json_array_length(F.get_json_object("object", "$.object_refs")), F.lit(0))
    return G.stix_objects(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.sum(held).cast("long").alias("refs"))


# --- frequent values, sketches, rules ------------------------------------------------------------------------------


@query(f"WITH {sql.WITH_PLANTED}, {sql.iocs()}, {G._ATL} SELECT technique_id, count(*) AS n FROM atlas GROUP BY ALL ORDER BY n DESC, technique_id LIMIT 8")
def top_techniques(spark, sf_dir):
    """Techniques matched most."""
    return correlate.top_techniques(mitre.atlas_map_iocs(iocs(spark, sf_dir, True)))


@query(r"WITH w AS (SELECT unnest(string_split_regex(text, '[ \n]+')) AS key FROM documents) SELECT key, count(*) AS n FROM w WHERE key <> '' GROUP BY ALL ORDER BY n DESC, key LIMIT 20")
def frequent_words(spark, sf_dir):
    """Most frequent of very many values: candidates by merged sketches, counted exactly."""
    words = load(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("key")).where("key <> ''")
    return correlate.model_usage(words, "key")


@query(f"SELECT n_findings, n_turns, n_secrets, true AS turns_close, true AS secrets_close FROM ({ORACLES['hunt_summary']})")
def hunt_estimates(spark, sf_dir):
    """Exact totals of a secret hunt, and whether distinct counts merged from sketches of each platform are within 3 %, or 1."""
    found = detect.secret_hunt(turns(spark, sf_dir), G._TURN_KEYS, salt="hunt")
    exact = correlate.hunt_summary(found, list(G._TURN_KEYS)).select("n_findings", "n_turns", "n_secrets")
    near = correlate.hunt_estimates(found, list(G._TURN_KEYS), ["platform"]).select(F.col("n_turns").alias("t"), F.col("n_secrets").alias("s"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1.0), 0.03 * F.col(a))
    return exact.crossJoin(F.broadcast(near)).select("n_findings", "n_turns", "n_secrets", close("n_turns", "t").alias("turns_close"), close("n_secrets", "s").alias("secrets_close"))


_OWN = (R.Rule("own_license", "own", r"(?i)\blicen[cs]e[sd]?\b", "low"), R.Rule("own_number", "own", r"\b[0-9]{3}-[0-9]{2,4}\b", "info"))
_REFUSED = (R.Rule("python_only", "own", r"(?P<q>license)", "low"), R.Rule("java_only", "own", r"\p{Lu}icense", "low"), R.Rule("read_apart", "own", r"[a-z&&[^x]]+", "low"), R.Rule("nested", "own", r"(a+)+", "low"), R.Rule("empty", "own", "", "low"))


@query(f"WITH {sql.WITH_PLANTED}, iocs AS ({sql.scan(R.COMMANDS + _OWN)}) {G._BY_RULE} FROM iocs GROUP BY ALL")
def registered_rules(spark, sf_dir):
    """Rules of a user beside the catalog's; those that the JVM can't read, or reads otherwise than Python, are left out."""
    rules = R.register_rules(R.COMMANDS, [*_OWN, *_REFUSED], spark=spark)
    return by_rule(detect.scan(evidence(spark, sf_dir, True), rules))


# --- report tables and inventories ---------------------------------------------------------------------------------


@query("SELECT 'turns' AS section, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations UNION ALL SELECT 'texts', count(*), CAST(sum(length(text)) AS BIGINT) FROM documents")
def report_tables(spark, sf_dir):
    """K3: sections of a report written as tables of their own and read back."""
    path = scratch(spark, "report")
    parts = {"turns": load(spark, sf_dir, "conversations"), "texts": load(spark, sf_dir, "documents")}
    sinks.write_report_tables(parts, path)
    back = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("section"), F.length("text").alias("size")) for name in parts]
    return back[0].unionByName(back[1]).groupBy("section").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))


@query(
    "WITH f AS (SELECT 'org/m' || (doc_id % 50) AS model_id, doc_id % 3 AS part, CASE WHEN doc_id % 3 = 0 THEN substr(md5(CAST(doc_id % 50 AS VARCHAR)), 1, 10) END AS commit, doc_id % 3 = 0 AND contains(text, 'license') AS custom FROM documents) "
    "SELECT 'models' AS kind, model_id, count(*) AS n_files, max(commit) AS commit, max(CASE WHEN part = 0 THEN 'llama' END) AS model_type, bool_or(coalesce(custom, false)) AS custom_code, CASE WHEN bool_or(coalesce(custom, false)) THEN 'high' ELSE 'info' END AS severity FROM f GROUP BY model_id"
)
def model_inventory(spark, sf_dir):
    """Models of a cache by the paths of its files, with the settings that documents give them."""
    d = load(spark, sf_dir, "documents")
    number = (F.col("doc_id") % 50).cast("string")
    settings = F.when(F.contains("text", F.lit("license")), '{"model_type": "llama", "auto_map": {}}').otherwise('{"model_type": "llama"}')
    path = F.concat(F.lit("/hub/models--org--m"), number, F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/snapshots/"), F.left(F.md5(number.cast("binary")), F.lit(10)), F.lit("/config.json"))).otherwise(F.concat(F.lit("/blobs/b"), "doc_id")))
    return inventory.model_inventory(d.select(path.alias("path"), F.when(F.col("doc_id") % 3 == 0, settings).alias("content"))).drop("atlas")


@query("SELECT 'conv/' || conv_id AS source_file, CAST(count(*) AS INT) AS n_messages, 'm' || (conv_id % 7) AS model, 'c' || (conv_id % 5) AS character, TIMESTAMP '2025-01-01' + to_seconds(conv_id) AS created_at FROM conversations GROUP BY conv_id")
def chat_log_meta(spark, sf_dir):
    """Message count, model, character and time of each conversation's JSON document, without its content."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    name = lambda letter, n: F.concat(F.lit(letter), (F.col("conv_id") % n).cast("string"))
    made = F.date_format(F.timestamp_seconds(F.lit(1735689600) + F.col("conv_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    doc = F.to_json(F.struct("messages", name("m", 7).alias("model"), name("c", 5).alias("character"), made.alias("created_at")))
    return inventory.chat_log_meta(c.select(F.concat(F.lit("conv/"), "conv_id").alias("source_file"), doc.alias("value")))


# --- the whole timeline --------------------------------------------------------------------------------------------

_DAY = "TIMESTAMP '2025-01-0{}' + to_seconds({})"
_NETWORK = sql.scan(R.NETWORK[:1] + R.HASHES)


@query(
    f"WITH {sql.DOCS}, ind AS ({_NETWORK}), m AS (SELECT 'doc/' || doc_id AS f, source AS platform, CASE WHEN doc_id % 2 = 0 THEN 'log' ELSE 'conversation' END AS kind, {_DAY.format(1, 'doc_id % 86400')} AS ts, doc_id FROM documents), "
    f"c AS (SELECT 'chat' AS platform, role, coalesce(text, '') AS t, {_DAY.format(2, 'conv_id * 60 + turn')} AS ts FROM conversations), "
    "a AS (SELECT platform, kind, ts, '' AS p, 'Collected ' || f AS d, true AS collected FROM m "
    "UNION ALL SELECT platform, 'log', ts, CASE WHEN doc_id % 4 = 0 THEN 'Collected ' ELSE 'Opened ' END || f, '', false FROM m "
    f"UNION ALL SELECT 'user' || (((user_id % 5) + 5) % 5), 'log', ts, {_preview('l')}, left(l, 200), false FROM (SELECT *, event_type || ' ' || coalesce(props, '') AS l FROM events) WHERE trim(l) <> '' "
    f"UNION ALL SELECT platform, 'conversation', ts, {_preview('t')}, {_SAID}, false FROM c "
    f"UNION ALL SELECT 'web', 'config', {_DAY.format(3, 'page_id % 86400')}, {_preview('html')}, 'Configuration page/' || page_id, false FROM pages "
    f"UNION ALL SELECT m.platform, 'indicator', ts, {_preview('value')}, 'Indicator ' || ind.kind || ': ' || left(value, 80), false FROM ind JOIN m ON f = source_file), "
    "k AS (SELECT platform, kind, date_trunc('second', ts) AS s, coalesce(nullif(p, ''), left(d, 80)) AS k, bool_and(collected) AS collected FROM a GROUP BY ALL) "
    "SELECT kind AS artifact_type, collected AS is_collection_event, count(*) AS n, count(DISTINCT platform || s) AS n_places FROM k GROUP BY ALL"
)
def whole_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection records, log lines, events, transcripts, a chat store, configurations and indicators on one timeline.

    The chat store repeats the transcripts, and some log lines say what a collection record says: the
    best of equal ones stays.  Indicators take the time of their file.
    """
    at = lambda day, seconds: F.timestamp_seconds(F.lit(1735689600 + 86400 * (day - 1)) + seconds)
    docs = load(spark, sf_dir, "documents")
    path = F.concat(F.lit("doc/"), "doc_id")
    manifest = docs.select(F.col("source").alias("platform"), F.when(F.col("doc_id") % 2 == 0, "log").otherwise("conversation").alias("artifact_type"), path.alias("original_path"), at(1, F.col("doc_id") % 86400).alias("collected_at"), F.lit(None).cast("timestamp").alias("modified_at"))
    said = F.concat(F.when(F.col("doc_id") % 4 == 0, "Collected ").otherwise("Opened "), path)
    lines = docs.select(F.col("source").alias("platform"), path.alias("source_file"), F.lit(0).alias("line_no"), said.alias("line"), at(1, F.col("doc_id") % 86400).alias("modified_at"))
    e = load(spark, sf_dir, "events")
    events = e.select(F.concat(F.lit("user"), F.pmod("user_id", F.lit(5)).cast("string")).alias("platform"), F.lit("events").alias("source_file"), F.col("event_id").alias("line_no"), F.concat("event_type", F.lit(" "), F.coalesce("props", F.lit(""))).alias("line"), F.col("ts").cast("timestamp").alias("modified_at"))
    c = load(spark, sf_dir, "conversations").withColumn("when", at(2, F.col("conv_id") * 60 + F.col("turn")))
    told = c.select(F.lit("chat").alias("platform"), "role", F.col("text").alias("content"), F.col("when").alias("timestamp"), F.concat(F.lit("chat/"), "conv_id").alias("source_file"), F.col("turn").alias("seq"))
    stored = c.select("conv_id", "turn", "role", F.col("text").alias("body"), F.date_format("when", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    store = transcripts.autodetect_message_table(stored, "chat", "chat.db")
    pages = load(spark, sf_dir, "pages").select(F.lit("web").alias("platform"), F.concat(F.lit("page/"), "page_id").alias("source_file"), F.col("html").alias("content"), at(3, F.col("page_id") % 86400).alias("modified_at"))
    seen = mitre.indicator_event_time(detect.scan(evidence(spark, sf_dir), R.NETWORK[:1] + R.HASHES), manifest)
    every = timeline.unified_timeline(timeline.collection_events(manifest), timeline.log_events(lines), timeline.log_events(events), timeline.turn_events(told), timeline.turn_events(store), timeline.config_events(pages), timeline.indicator_events(seen))
    return every.groupBy("artifact_type", "is_collection_event").agg(F.count("*").alias("n"), F.count_distinct("platform", F.date_trunc("second", "timestamp")).alias("n_places"))


@query(
    f"WITH {sql.WITH_PLANTED}, {G._IND}, k AS (SELECT kind, value, count(DISTINCT platform) AS np FROM ind GROUP BY ALL) "
    "SELECT kind, CASE WHEN np < 2 THEN severity WHEN severity = 'info' THEN 'low' WHEN severity = 'low' THEN 'medium' WHEN severity = 'medium' THEN 'high' ELSE 'critical' END AS severity, count(*) AS n FROM ind JOIN k USING (kind, value) GROUP BY ALL"
)
def upgraded_indicators(spark, sf_dir):
    """Detector rows of indicators on several platforms, one level up."""
    return correlate.upgrade_indicators(told_once(spark, sf_dir)).groupBy("kind", "severity").agg(F.count("*").alias("n"))
