"""Registered queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gumshoe.functions import text as X
from gumshoe.operators import correlate, dedup, detect, inventory, lookup, mitre, risk, sessions, timeline
from gumshoe.operators import rules as R
from gumshoe.plans import planted, sql
from gumshoe.sources import evidence as ev
from gumshoe.sources import sinks, transcripts
from gumshoe.sources.shared import written
from gumshoe.streaming import detect as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


# --- inputs --------------------------------------------------------------------------------------------------------


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str, more: bool = False) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_file"), F.col("source").alias("platform"), F.col("text").alias("content"))
    docs = ev.spread(docs)
    return docs.unionByName(spark.createDataFrame(list(planted.EVIDENCE), ["source_file", "platform", "content"])) if more else docs


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("string")
    real = load(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("platform"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turn").cast("long").alias("seq"), "role", null.alias("model"), F.col("text").alias("content"), null.alias("tool_command")
    )
    more = spark.createDataFrame(list(planted.TURNS), "platform string, session_id string, seq long, role string, model string, content string, tool_command string")
    return real.unionByName(more).withColumns({"source_file": F.col("session_id"), "tool_input": null, "timestamp": F.lit(None).cast("timestamp")})


def iocs(spark: SparkSession, sf_dir: str, more: bool = False) -> DataFrame:
    return detect.ioc_all(evidence(spark, sf_dir, more))


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scan(evidence(spark, sf_dir, True), R.AI_RULES)


def told_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector rows of one scan, written for queries that read them more than once."""
    return written(indicators(spark, sf_dir), "hits")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.indicators_to_findings(dedup.dedup_first(indicators(spark, sf_dir), ["kind", "value", "source_file"], ["rule"]))


def scanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(iocs, detector rows, findings) of one scan of the corpus, written once for all that follows."""
    hits = written(detect.scan(evidence(spark, sf_dir, True), R.IOC_RULES + R.AI_RULES), "hits")
    of = lambda rules: hits.where(F.col("kind").isin(sorted({r.kind for r in rules})))  # noqa: E731  no kind is in both catalogs
    told = of(R.AI_RULES)
    found = detect.indicators_to_findings(dedup.dedup_first(told, ["kind", "value", "source_file"], ["rule"]))
    return detect.kept_iocs(of(R.IOC_RULES)), told, found


_BY_RULE = "SELECT rule, kind, severity, count(*) AS n, count(DISTINCT value) AS n_values, count(DISTINCT platform) AS n_platforms"


def by_rule(df: DataFrame) -> DataFrame:
    return df.groupBy("rule", "kind", "severity").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"), F.count_distinct("platform").alias("n_platforms"))


# --- indicators ----------------------------------------------------------------------------------------------------

_NET = sql.iocs(R.NETWORK + R.HASHES)
_FIRST = "f AS (SELECT kind, value, source_file, min(platform) AS platform, min(severity) AS severity FROM iocs GROUP BY ALL)"
_UP = "k AS (SELECT kind, value, count(DISTINCT platform) AS np FROM f GROUP BY ALL)"


@query(f"WITH {sql.DOCS}, {_NET}, {_FIRST.replace('GROUP BY ALL', 'GROUP BY kind, value, source_file')}, {_UP.replace('GROUP BY ALL', 'GROUP BY kind, value')} SELECT platform, kind, CASE WHEN np >= 2 AND severity <> 'critical' THEN 'high' ELSE severity END AS severity, count(*) AS n FROM f JOIN k USING (kind, value) GROUP BY ALL")
def ioc_cross_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network and hash indicators, first of each, raised if several platforms have them."""
    found = detect.kept_iocs(detect.scan(evidence(spark, sf_dir), R.NETWORK + R.HASHES))
    first = dedup.dedup_first(found, ["kind", "value", "source_file"], ["rule"])
    return correlate.cross_platform_upgrade(first).groupBy("platform", "kind", "severity").agg(F.count("*").alias("n"))


flagship = ioc_cross_platform


def _detector(name: str, rules, f) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return by_rule(f(evidence(spark, sf_dir, True)))

    run.__name__, run.__doc__ = name, f.__doc__
    query(f"WITH {sql.WITH_PLANTED}, iocs AS ({sql.scan(rules)}) {_BY_RULE} FROM iocs GROUP BY ALL")(run)


for _name, _rules, _f in (
    ("ioc_command", R.COMMANDS, detect.ioc_command), ("ioc_exfil", R.EXFIL, detect.ioc_exfil), ("ai_jailbreak", R.JAILBREAK, detect.ai_jailbreak), ("ai_tool_abuse", R.TOOL_ABUSE, detect.ai_tool_abuse),
    ("ai_sensitive_path", R.SENSITIVE_PATHS, detect.ai_sensitive_path), ("ai_exfiltration", R.EXFILTRATION, detect.ai_exfiltration), ("ai_model_manipulation", R.MODEL_MANIPULATION, detect.ai_model_manipulation),
):
    _detector(_name, _rules, _f)


@query(f"WITH {sql.DOCS}, {sql.iocs(R.NETWORK)} {_BY_RULE} FROM iocs GROUP BY ALL")
def ioc_network(spark, sf_dir):
    """D1 with P1 and P2."""
    return by_rule(detect.ioc_network(evidence(spark, sf_dir)))


@query(f"WITH {sql.DOCS}, {sql.iocs(R.HASHES)} {_BY_RULE} FROM iocs GROUP BY ALL")
def ioc_hash(spark, sf_dir):
    """D2."""
    return by_rule(detect.ioc_hash(evidence(spark, sf_dir)))


_PAGES = "ev AS (SELECT 'page/' || page_id AS source_file, 'web' AS platform, url || ' ' || coalesce(html, '') AS content FROM pages)"


@query(f"WITH {_PAGES}, {sql.iocs(R.NETWORK + R.PATHS)} {_BY_RULE} FROM iocs GROUP BY ALL")
def ioc_pages(spark, sf_dir):
    """D1 and D3 over web pages with P1 to P3."""
    pages = load(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("source_file"), F.lit("web").alias("platform"), F.concat("url", F.lit(" "), F.coalesce("html", F.lit(""))).alias("content"))
    return by_rule(detect.ioc_network(pages).unionByName(detect.ioc_filepath(pages)))


@query(
    f"WITH {sql.WITH_PLANTED}, c AS ({sql.scan(R.CREDENTIALS)}) SELECT rule, CASE WHEN length(value) > 12 THEN left(value, 6) || '...' || right(value, 4) ELSE left(value, 4) || '...' END AS value, platform, count(*) AS n FROM c GROUP BY ALL"
)
def ai_credential(spark, sf_dir):
    """D10 with F3: masked credentials by rule and platform."""
    return detect.ai_credential(evidence(spark, sf_dir, True)).groupBy("rule", "value", "platform").agg(F.count("*").alias("n"))


@query(f"WITH {sql.DOCS} SELECT source_file, platform, length(content) AS n_chars FROM ev WHERE length(content) > 10000")
def ai_large_body(spark, sf_dir):
    """D12."""
    found = detect.ai_large_body(evidence(spark, sf_dir))
    return found.select("source_file", "platform", F.regexp_extract("value", "^[0-9]+", 0).cast("long").alias("n_chars"))


_SECRET_ARMS = " UNION ALL ".join(
    f"SELECT source_file, platform, {sql.lit(r.id)} AS rule, {sql.lit(r.severity)} AS severity, CAST({r.meta['entropy']} AS DOUBLE) AS least, unnest(regexp_extract_all(content, {sql.lit(r.pattern)}, 1)) AS v FROM ev" for r in R.SECRET_RULES
)
_ENTROPY = "list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -((length(v) - length(replace(v, c, ''))) / length(v)) * log2((length(v) - length(replace(v, c, ''))) / length(v))))"


@query(
    f"WITH {sql.WITH_PLANTED}, s AS (SELECT *, {_ENTROPY} AS e FROM ({_SECRET_ARMS}) WHERE NOT regexp_matches(v, {sql.lit(R.PLACEHOLDER)})) "
    "SELECT source_file, platform, rule, severity, left(v, 4) || '...' || right(v, 4) || ' (' || length(v) || ' chars)' AS redacted, left(sha256('case|' || rule || '|' || v), 16) AS fingerprint, length(v) AS raw_length FROM s WHERE e >= least"
)
def secret_scan(spark, sf_dir):
    """D13 with F3, F4, F25: secrets by catalog, entropy and placeholder filter."""
    found = detect.secret_scan(evidence(spark, sf_dir, True))
    return found.select("source_file", "platform", "rule", "severity", "redacted", "fingerprint", F.col("raw_length").cast("long").alias("raw_length"))


@query(f"WITH {sql.DOCS}, m AS (SELECT source_file, unnest(regexp_extract_all(content, {sql.lit(R.NETWORK[0].pattern)})) AS value FROM ev) SELECT source_file, value, count(*) AS n FROM m GROUP BY ALL")
def match_offsets(spark, sf_dir):
    """matches with positions, each checked against the text it came from."""
    found = detect.scan(evidence(spark, sf_dir), R.NETWORK[:1], id_cols=("source_file", "content"), positions=True)
    exact = F.substring(F.col("content"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("value")
    return found.where(exact & F.contains("context", F.col("value"))).groupBy("source_file", "value").agg(F.count("*").alias("n"))


_ZW = "".join(X.ZERO_WIDTH)


@query(f"WITH {sql.WITH_PLANTED} SELECT source_file, platform, length(content) - length(regexp_replace(content, '[{_ZW}]', '', 'g')) AS n FROM ev WHERE length(content) - length(regexp_replace(content, '[{_ZW}]', '', 'g')) >= 3")
def ai_zero_width(spark, sf_dir):
    """Texts with runs of invisible characters."""
    found = detect.ai_zero_width(evidence(spark, sf_dir, True))
    return found.groupBy("source_file", "platform").agg(F.sum("n").cast("long").alias("n"))


@query(f"WITH {sql.WITH_PLANTED} SELECT source_file, platform, length(content) - length(regexp_replace(content, '[{X.HOMOGLYPHS}]', '', 'g')) AS n FROM ev WHERE length(content) - length(regexp_replace(content, '[{X.HOMOGLYPHS}]', '', 'g')) >= 3")
def ai_homoglyph(spark, sf_dir):
    """Look-alike letters around a suspicious word."""
    return detect.ai_homoglyph(evidence(spark, sf_dir, True)).select("source_file", "platform", F.col("n").cast("long").alias("n"))


@query(
    f"WITH {sql.WITH_PLANTED}, b AS (SELECT source_file, platform, unnest(regexp_extract_all(content, {sql.lit(X.BASE64_BLOCK)})) AS block FROM ev), d AS (SELECT source_file, platform, decode(try(from_base64(block)), 'replace') AS value FROM b WHERE length(block) % 4 = 0) "
    f"SELECT source_file, platform, value FROM d WHERE regexp_matches(value, {sql.lit(R.INJECTION_WORDS)})"
)
def ai_base64_injection(spark, sf_dir):
    """Encoded instructions."""
    return detect.ai_base64_injection(evidence(spark, sf_dir, True)).select("source_file", "platform", "value")


# --- turns ---------------------------------------------------------------------------------------------------------

_TURN_TEXT = "concat_ws(chr(10), content, tool_command)"
_CONV = "c AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT platform, session_id, seq, {sql.lit(r.kind)} AS category, {sql.lit(r.id)} AS label, {sql.lit(r.severity)} AS severity, regexp_extract({_TURN_TEXT}, {sql.lit(r.pattern)}) AS value FROM turns" for r in R.TURN_RULES) + ") WHERE value <> '')"
_TURN_KEYS = ("platform", "session_id", "seq")


def turn_findings(spark, sf_dir) -> DataFrame:
    return detect.conv_patterns(turns(spark, sf_dir), _TURN_KEYS)


@query(f"WITH {sql.TURNS}, {_CONV} SELECT platform, session_id, seq, category, label, severity, value FROM c")
def conv_patterns(spark, sf_dir):
    """Labels found in turns."""
    return turn_findings(spark, sf_dir).drop("atlas")


@query(f"WITH {sql.TURNS}, {_CONV} SELECT CASE WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(category) = 0 THEN 'category' ELSE 'all' END AS dimension, coalesce(severity, category, 'all') AS key, count(*) AS n FROM c GROUP BY GROUPING SETS ((severity), (category), ())")
def findings_summary(spark, sf_dir):
    """Counts by severity, by category and in all."""
    return correlate.findings_summary(turn_findings(spark, sf_dir))


_PATHS = "[" + ", ".join(sql.lit(p) for p in R.TOOL_PATHS) + "]"
_CMDS = "[" + ", ".join(sql.lit(p) for p in R.TOOL_COMMANDS) + "]"


@query(
    f"WITH {sql.TURNS}, t AS (SELECT *, lower(coalesce(tool_command, '')) AS x FROM turns), r AS (SELECT platform, session_id, seq, 'tool_sensitive_path' AS rule, list_filter({_PATHS}, lambda p: contains(x, p))[1] AS value, 'critical' AS severity, 95 AS risk_score FROM t "
    f"UNION ALL SELECT platform, session_id, seq, 'tool_outbound_command', list_filter({_CMDS}, lambda p: contains(x, p))[1], 'high', 80 FROM t) SELECT * FROM r WHERE value IS NOT NULL"
)
def conv_tool_exfil(spark, sf_dir):
    """Sensitive paths and outbound commands in tool calls."""
    return detect.conv_tool_exfil(turns(spark, sf_dir), _TURN_KEYS)


@query()
def conv_base64(spark, sf_dir):
    """Keywords in encoded blocks of turns."""
    return detect.conv_base64(turns(spark, sf_dir), _TURN_KEYS)


_HUNT = "h AS (" + " UNION ALL ".join(
    f"SELECT platform, session_id, seq, role, {sql.lit(r.id)} AS rule, {sql.lit(r.severity)} AS severity, CAST({r.meta['entropy']} AS DOUBLE) AS least, unnest(regexp_extract_all({f}, {sql.lit(r.pattern)}, 1)) AS v FROM turns" for r in R.SECRET_RULES for f in ("content", "tool_command")
) + f"), k AS (SELECT * FROM h WHERE NOT regexp_matches(v, {sql.lit(R.PLACEHOLDER)}) AND {_ENTROPY} >= least)"
_DIRECTION = "CASE WHEN lower(role) IN ('assistant', 'ai', 'model') THEN 'model_to_user' WHEN lower(role) IN ('user', 'human') THEN 'user_to_model' WHEN lower(role) IN ('tool', 'function') THEN 'tool_to_model' ELSE 'unknown' END"


@query(
    f"WITH {sql.TURNS}, {_HUNT} SELECT count(*) AS n_findings, count(DISTINCT platform || '|' || session_id || '|' || seq) AS n_turns, count(DISTINCT rule || v) AS n_secrets, "
    + ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in X.SEVERITIES)
    + ", "
    + ", ".join(f"count(*) FILTER ({_DIRECTION} = '{d}') AS n_{d}" for d in ("model_to_user", "user_to_model", "tool_to_model", "unknown"))
    + " FROM k"
)
def hunt_summary(spark, sf_dir):
    """Secrets in turns, summed up."""
    found = detect.secret_hunt(turns(spark, sf_dir), _TURN_KEYS, salt="hunt")
    return correlate.hunt_summary(found, list(_TURN_KEYS))


@query(
    f"WITH {sql.TURNS}, u AS (SELECT *, trim(content) AS k, coalesce(model, '') AS m FROM turns WHERE lower(role) = 'user' AND trim(coalesce(content, '')) <> ''), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY k, m ORDER BY seq, platform, session_id) AS i FROM u), "
    "g AS (SELECT k, m, count(*) AS copies FROM u GROUP BY ALL) SELECT m AS model, count(*) AS n_prompts, CAST(sum(copies) AS BIGINT) AS n_copies FROM g GROUP BY ALL"
)
def cross_tool_dedup(spark, sf_dir):
    """Prompts kept and the copies they stand for, by model."""
    order = turns(spark, sf_dir).withColumn("order", F.struct("seq", "platform", "session_id"))
    kept = dedup.cross_tool_dedup(order, "order").where(F.lower("role") == "user")
    users = turns(spark, sf_dir).where((F.lower("role") == "user") & (F.trim(F.coalesce("content", F.lit(""))) != "")).groupBy(F.coalesce("model", F.lit("")).alias("model")).agg(F.count("*").alias("n_copies"))
    return kept.where(F.trim("content") != "").groupBy(F.coalesce("model", F.lit("")).alias("model")).agg(F.count("*").alias("n_prompts")).join(users, "model")


@query(f"WITH {sql.TURNS} SELECT platform, session_id, count(*) AS turn_count, arg_min(model, seq) FILTER (model IS NOT NULL AND model <> '') AS model, coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS models FROM turns GROUP BY ALL")
def session_table(spark, sf_dir):
    """Sessions with their models."""
    return sessions.sessions(turns(spark, sf_dir)).select("platform", "session_id", "turn_count", "model", F.array_join("models", ",").alias("models"))


@query(
    f"WITH {sql.TURNS}, {_CONV}, s AS (SELECT platform, session_id, count(*) AS turns, count(*) FILTER (lower(role) IN ('user', 'human')) AS user_turns, count(*) FILTER (lower(role) IN ('assistant', 'ai', 'model')) AS assistant_turns, count(tool_command) AS tool_calls FROM turns GROUP BY ALL), "
    f"f AS (SELECT platform, session_id, count(*) AS n_findings, max(CASE severity WHEN 'critical' THEN 90 WHEN 'high' THEN 70 WHEN 'medium' THEN 50 WHEN 'low' THEN 25 ELSE 10 END) AS risk_score, {sql.label('max(' + sql.RANK + ')')} AS risk_severity, count(*) FILTER (category = 'jailbreak') AS jailbreak_attempts FROM c GROUP BY ALL) "
    "SELECT platform, session_id, turns, user_turns, assistant_turns, tool_calls, coalesce(n_findings, 0) AS n_findings, coalesce(risk_score, 0) AS risk_score, coalesce(risk_severity, 'info') AS risk_severity, coalesce(jailbreak_attempts, 0) AS jailbreak_attempts FROM s LEFT JOIN f USING (platform, session_id)"
)
def session_summary(spark, sf_dir):
    """Sessions with their risk."""
    t = turns(spark, sf_dir)
    return sessions.session_summary(t, turn_findings(spark, sf_dir).withColumn("source_file", F.col("session_id")))


@query(f"WITH {sql.TURNS}, {_CONV}, t AS (SELECT platform, session_id, seq, EXISTS (SELECT 1 FROM c WHERE c.platform = turns.platform AND c.session_id = turns.session_id AND c.seq = turns.seq) AS flag FROM turns), w AS (SELECT *, sum(CAST(flag AS INT)) OVER (PARTITION BY platform, session_id ORDER BY seq ROWS 4 PRECEDING) AS flagged_in_window FROM t) SELECT platform, session_id, seq, CAST(flagged_in_window AS BIGINT) AS flagged_in_window FROM w WHERE flagged_in_window >= 2")
def turn_window_escalation(spark, sf_dir):
    """Two of the last five turns flagged."""
    flagged = turn_findings(spark, sf_dir).select(*_TURN_KEYS).distinct().withColumn("flag", F.lit(True))
    rows = turns(spark, sf_dir).join(flagged, list(_TURN_KEYS), "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
    return dedup.turn_window_escalation(rows, "flag", ["platform", "session_id"], "seq", 5, 2).select(*_TURN_KEYS, F.col("flagged_in_window").cast("long").alias("flagged_in_window"))


@query(f"WITH {sql.TURNS}, t AS (SELECT platform, session_id, seq, last_value(model IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq, platform ROWS UNBOUNDED PRECEDING) AS model FROM turns) SELECT coalesce(model, 'none') AS model, count(*) AS n FROM t GROUP BY ALL")
def model_carry_forward(spark, sf_dir):
    """Turns by the model in force."""
    rows = dedup.model_carry_forward(turns(spark, sf_dir), ["session_id"], ["seq", "platform"])
    return rows.groupBy(F.coalesce("model", F.lit("none")).alias("model")).agg(F.count("*").alias("n"))


@query("SELECT 'conv/' || conv_id AS session_id, role, count(*) AS n, min(turn) AS first_seq FROM conversations GROUP BY ALL")
def autodetect_message_table(spark, sf_dir):
    """A table with unknown column names read as turns."""
    found = transcripts.autodetect_message_table(load(spark, sf_dir, "conversations").select(F.concat(F.lit("conv/"), "conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("body")), "store", "conversations")
    return found.groupBy("session_id", "role").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("SELECT 'conv/' || conv_id AS session_id, role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE text IS NOT NULL GROUP BY ALL")
def message_documents(spark, sf_dir):
    """Conversations as key/value JSON documents, read back as turns."""
    c = load(spark, sf_dir, "conversations").where("text is not null")
    doc = c.groupBy("conv_id").agg(F.to_json(F.struct(F.concat(F.lit("conv/"), "conv_id").alias("id"), F.lit("m").alias("model"), F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))).alias("value"))
    found = transcripts.kv_store_messages(doc.select(F.col("conv_id").cast("string").alias("key"), "value"))
    return found.groupBy("session_id", "role").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS n, count(*) FILTER (turn % 2 = 0) AS own_model FROM conversations GROUP BY ALL")
def chat_store_join(spark, sf_dir):
    """Messages take their chat's model where they name none."""
    c = load(spark, sf_dir, "conversations")
    messages = c.select(F.col("conv_id").alias("chat_id"), "role", F.col("text").alias("content"), F.when(F.col("turn") % 2 == 0, "own").otherwise("").alias("model_name"), F.lit("2024-05-01T10:00:00Z").alias("created_at"), F.col("turn").alias("seq"))
    chats = c.select(F.col("conv_id").alias("id")).distinct().withColumns({"model": F.lit("chat"), "title": F.lit("t")})
    found = transcripts.chat_store_join(messages, chats)
    return found.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("model") == "own").alias("own_model"))


# --- correlation and scores ----------------------------------------------------------------------------------------

_IND = f"ind AS ({sql.scan(R.AI_RULES)})"
_FIND = (
    "fi AS (SELECT kind, value, source_file, min_by(rule, rule) AS rule, min_by(severity, rule) AS severity, min_by(platform, rule) AS platform, min_by(confidence, rule) AS confidence FROM ind GROUP BY kind, value, source_file), "
    "fnd AS (SELECT 'AI-' || left(sha256(kind || '|' || value || '|' || source_file), 12) AS id, list_reduce(list_transform(string_split(replace(kind, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) || ': ' || rule AS title, "
    "'Matched ' || rule || ' in ' || source_file AS description, severity, platform, source_file, kind AS category FROM fi WHERE confidence >= 0.7)"
)


@query(f"WITH {sql.WITH_PLANTED}, {_IND}, {_FIND} SELECT id, title, description, severity, platform, source_file, category FROM fnd")
def findings_table(spark, sf_dir):
    """Indicators of enough confidence as findings."""
    return findings(spark, sf_dir).select("id", "title", "description", "severity", "platform", "source_file", "category")


@query(f"WITH {sql.WITH_PLANTED}, {_IND}, g AS (SELECT kind AS of_kind, value, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms, count(*) AS n, count(DISTINCT source_file) AS n_files, count(DISTINCT platform) AS np FROM ind GROUP BY ALL) SELECT of_kind, value, platforms, n, n_files FROM g WHERE np >= 2")
def cross_platform_indicator(spark, sf_dir):
    """A3: indicators on several platforms."""
    found = correlate.cross_platform_indicator(told_once(spark, sf_dir))
    return found.select("of_kind", "value", F.array_join("platforms", ",").alias("platforms"), "n", "n_files")


@query(f"WITH {sql.WITH_PLANTED}, {_IND} SELECT value, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms, count(*) AS n, {sql.label('max(' + sql.RANK + ')')} AS severity FROM ind WHERE kind = 'credential' GROUP BY value HAVING count(DISTINCT platform) >= 2")
def shared_credentials(spark, sf_dir):
    """A4: credentials on several platforms."""
    return correlate.shared_credentials(indicators(spark, sf_dir)).withColumn("platforms", F.array_join("platforms", ","))


_COR = (
    "cor AS (SELECT 'shared_indicator' AS correlation, kind AS key, value, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms, count(*) AS n FROM iocs GROUP BY kind, value HAVING count(DISTINCT platform) >= 2 "
    "UNION ALL SELECT 'severity_pattern', severity, '', string_agg(DISTINCT platform, ',' ORDER BY platform), count(*) FROM fnd GROUP BY severity HAVING count(DISTINCT platform) >= 2)"
)


@query(f"WITH {sql.WITH_PLANTED}, {sql.iocs()}, {_IND}, {_FIND}, {_COR} SELECT * FROM cor")
def correlations(spark, sf_dir):
    """A5: indicators and severities that platforms share."""
    i, _, f = scanned(spark, sf_dir)
    found = correlate.correlations(i, f)
    return found.withColumn("platforms", F.array_join("platforms", ","))


@query(f"WITH {sql.WITH_PLANTED}, {sql.iocs()}, s AS (SELECT kind, value, list_sort(list(DISTINCT platform)) AS p FROM iocs GROUP BY kind, value HAVING count(DISTINCT platform) >= 2), e AS (SELECT a.x AS src, b.x AS dst FROM s, unnest(p) a(x), unnest(p) b(x) WHERE a.x < b.x) SELECT DISTINCT src, dst FROM e")
def platform_graph(spark, sf_dir):
    """Pairs of platforms that share an indicator."""
    i, _, f = scanned(spark, sf_dir)
    shared = correlate.correlations(i, f).where(F.col("correlation") == "shared_indicator")
    return correlate.platform_graph(shared, i)[1].select("src", "dst")


@query(f"WITH {sql.WITH_PLANTED}, {_IND}, {_FIND}, a AS (SELECT platform, count(*) AS n_artifacts FROM ev GROUP BY ALL), b AS (SELECT platform, count(*) AS n_findings, {sql.label('max(' + sql.RANK + ')')} AS max_severity FROM fnd GROUP BY ALL) SELECT platform, n_artifacts, coalesce(n_findings, 0) AS n_findings, coalesce(max_severity, 'info') AS max_severity FROM a LEFT JOIN b USING (platform)")
def platform_inventory(spark, sf_dir):
    """A10: artifacts and findings of each platform."""
    return correlate.platform_inventory(evidence(spark, sf_dir, True), findings(spark, sf_dir))


@query(f"WITH {sql.WITH_PLANTED}, {sql.iocs()}, c AS (SELECT severity, count(*) AS n, {sql.RANK} AS k FROM iocs GROUP BY severity) SELECT severity, n, round(100 * n / sum(n) OVER (), 2) AS share, round(100 * sum(n) OVER (ORDER BY k DESC) / sum(n) OVER (), 2) AS running_share FROM c")
def severity_share(spark, sf_dir):
    """Running share of severities."""
    return dedup.severity_share(iocs(spark, sf_dir, True))


_AT = sql.values(mitre.IOC_ATLAS, "kind, t")
_ATL = f"atl AS (SELECT i.*, CASE WHEN kind = 'filepath' AND regexp_matches(value, {sql.lit(mitre.MODEL_FILE)}) THEN 'AML.T0025' ELSE t END AS technique_id FROM iocs i LEFT JOIN {_AT} m USING (kind)), atlas AS (SELECT * FROM atl WHERE technique_id IS NOT NULL)"


@query(f"WITH {sql.WITH_PLANTED}, {sql.iocs()}, {_ATL} SELECT technique_id, count(*) AS n, {sql.label('max(' + sql.RANK + ')')} AS severity, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms FROM atlas GROUP BY ALL")
def atlas_summary(spark, sf_dir):
    """ATLAS techniques of indicators."""
    found = mitre.atlas_summary(mitre.atlas_map_iocs(iocs(spark, sf_dir, True)))
    return found.select("technique_id", "n", "severity", F.array_join("platforms", ",").alias("platforms"))


_FTEXT = "lower(concat_ws(' ', title, description))"
_FW = " UNION ALL ".join(f"SELECT id, '{t}' AS technique_id FROM fnd WHERE {sql.holds(_FTEXT, w)}" for t, w in mitre.FINDING_WORDS)


@query(f"WITH {sql.WITH_PLANTED}, {_IND}, {_FIND}, w AS ({_FW}), x AS (SELECT * FROM w UNION ALL SELECT id, 'AML.T0049' FROM fnd WHERE severity IN ('critical', 'high') AND id NOT IN (SELECT id FROM w)) SELECT technique_id, count(*) AS n FROM x GROUP BY ALL")
def atlas_map_findings(spark, sf_dir):
    """ATLAS techniques of findings."""
    return mitre.atlas_map_findings(findings(spark, sf_dir)).groupBy("technique_id").agg(F.count("*").alias("n"))


_A2A = sql.values(mitre.ATLAS_TO_ATTACK, "technique_id, attack_id")
_AW = " UNION ALL ".join(f"SELECT '{t}' AS attack_id, bool_or({sql.holds(_FTEXT, w)}) AS hit FROM fnd" for t, w in mitre.ATTACK_WORDS)


@query(
    f"WITH {sql.WITH_PLANTED}, {sql.iocs()}, {_IND}, {_FIND}, {_ATL}, i AS (SELECT attack_id, count(*) AS n FROM atlas JOIN {_A2A} m USING (technique_id) GROUP BY ALL), w AS (SELECT attack_id FROM ({_AW}) WHERE hit), "
    "p AS (SELECT DISTINCT CASE kind WHEN 'api_key' THEN 'T1552' ELSE 'T1048' END AS attack_id FROM iocs WHERE kind IN ('api_key', 'exfil_pattern')), a AS (SELECT attack_id FROM i UNION SELECT attack_id FROM w UNION SELECT attack_id FROM p) "
    "SELECT attack_id, CAST(CASE WHEN i.n IS NOT NULL THEN i.n + CAST(w.attack_id IS NOT NULL AS INT) WHEN p.attack_id IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS n FROM a LEFT JOIN i USING (attack_id) LEFT JOIN w USING (attack_id) LEFT JOIN p USING (attack_id)"
)
def attack_map(spark, sf_dir):
    """ATT&CK techniques with counts."""
    i, _, f = scanned(spark, sf_dir)
    return mitre.attack_map(mitre.atlas_map_iocs(i), f, i).select("attack_id", "n")


_SW = " UNION ALL ".join(f"SELECT '{t}' AS stage, count(*) AS n FROM fnd WHERE {sql.holds(_FTEXT, w)}" for t, w in mitre.STAGE_WORDS)


@query(
    f"WITH {sql.WITH_PLANTED}, {sql.iocs()}, {_IND}, {_FIND}, {_ATL}, l AS (SELECT stage, count(*) AS n FROM iocs JOIN {sql.values(mitre.IOC_STAGES, 'kind, stage')} m USING (kind) GROUP BY ALL UNION ALL {_SW} UNION ALL SELECT 'Exploitation', count(*) FROM atlas), s AS (SELECT stage, sum(n) AS n FROM l GROUP BY ALL) "
    f"SELECT no, stage, coalesce(n, 0) > 0 AS detected, CAST(coalesce(n, 0) AS BIGINT) AS n FROM {sql.values(list(enumerate(mitre.STAGES)), 'no, stage')} d LEFT JOIN s USING (stage)"
)
def kill_chain(spark, sf_dir):
    """Kill-chain stages."""
    i, _, f = scanned(spark, sf_dir)
    return mitre.kill_chain(f, i, mitre.atlas_map_iocs(i)).select(F.col("no").cast("int").alias("no"), "stage", "detected", "n")


@query()
def merge_attack(spark, sf_dir):
    """Techniques that only detectors name."""
    i, told, f = scanned(spark, sf_dir)
    return mitre.merge_attack(mitre.attack_map(mitre.atlas_map_iocs(i), f, i), told)


def _risk4_sql() -> str:
    text = [f"coalesce(bool_or({sql.holds(_FTEXT, w)}), false) AS p{n}" for n, (_, s, w, _) in enumerate(risk.POINTS) if s == "text"]
    kinds = [(f"coalesce(bool_or(kind IN ({', '.join(map(sql.lit, w))})), false)" if s == "type" else f"coalesce(bool_or({sql.holds('lower(value)', w)}), false)") + f" AS p{n}" for n, (_, s, w, _) in enumerate(risk.POINTS) if s != "text"]
    jail = sql.holds("lower(title)", ("jailbreak", "injection", "bypass"))
    f = (
        f"f AS (SELECT platform, {', '.join(text)}, coalesce(bool_or({sql.holds(_FTEXT, ('log', 'history'))}), false) AS logs, bool_or(contains({_FTEXT}, 'exfil')) AS exfil, count(*) FILTER (severity = 'critical' AND {sql.holds('lower(title)', ('credential', 'key', 'token'))}) AS b_cred, "
        f"count(*) FILTER (severity IN ('critical', 'high')) AS b_exf, count(*) FILTER (severity = 'critical' AND {jail}) AS b5, count(*) FILTER (severity = 'high' AND {jail}) AS b3, count(*) FILTER (severity = 'critical') AS b_auto FROM fnd GROUP BY ALL)"
    )
    i = f"i AS (SELECT platform, {', '.join(kinds)}, coalesce(bool_or({sql.holds('lower(value)', ('sk-', 'ghp_', 'key-'))}), false) AS keys FROM iocs GROUP BY ALL)"
    sums = {c: " + ".join(f"CASE WHEN coalesce(p{n}, false) THEN {p} ELSE 0 END" for n, (k, _, _, p) in enumerate(risk.POINTS) if k == c) for c in risk.FOUR}
    sums["credentials"] += " + CASE WHEN coalesce(logs, false) AND coalesce(keys, false) THEN 8 ELSE 0 END + 3 * coalesce(b_cred, 0)"
    sums["exfiltration"] += " + CASE WHEN coalesce(exfil, false) THEN 3 * coalesce(b_exf, 0) ELSE 0 END"
    sums["jailbreak"] += " + 5 * coalesce(b5, 0) + 3 * coalesce(b3, 0)"
    sums["autonomy"] += " + 2 * coalesce(b_auto, 0)"
    r = f"r AS (SELECT platform, {', '.join(f'CAST(least(25, {s}) AS INT) AS {c}' for c, s in sums.items())} FROM f FULL JOIN i USING (platform))"
    return f"WITH {sql.WITH_PLANTED}, {sql.iocs()}, {_IND}, {_FIND}, {f}, {i}, {r}, r4 AS (SELECT *, least(100, credentials + exfiltration + jailbreak + autonomy) AS score FROM r)"


_BAND = "CASE WHEN score >= 90 THEN 'Critical' WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END"


def scores4(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(four-category scores, findings, iocs)."""
    i, _, f = scanned(spark, sf_dir)
    return risk.risk4(f, i), f, i


@query(f"{_risk4_sql()} SELECT *, {_BAND} AS severity FROM r4")
def risk4(spark, sf_dir):
    """Four-category score of each platform."""
    return scores4(spark, sf_dir)[0]


@query(
    f"{_risk4_sql()}, c AS (SELECT platform, count(*) AS w FROM fnd GROUP BY ALL), j AS (SELECT r4.*, greatest(coalesce(w, 0), 1) AS w FROM r4 LEFT JOIN c USING (platform)), o AS (SELECT CAST(sum(score * w) // sum(w) AS BIGINT) AS score, "
    + ", ".join(f"CAST(least(25, sum({c} * w) // sum(w)) AS BIGINT) AS {c}" for c in risk.FOUR)
    + f" FROM j) SELECT *, {_BAND} AS severity FROM o"
)
def risk_overall(spark, sf_dir):
    """Score of all platforms together."""
    scores, f, _ = scores4(spark, sf_dir)
    return risk.risk_overall(scores, f)


def _advice_sql() -> str:
    """Advice by tier, from the scores of the four-category twin."""
    tiers = (
        ("credentials", "Rotate exposed credentials now and scan for secrets before merging.", "Review exposed credentials and use a vault.", "Audit where credentials are stored."),
        ("exfiltration", "Investigate ongoing exfiltration and control outgoing traffic.", "Review ways out and watch outgoing traffic.", "Review how data is handled."),
        ("jailbreak", "Harden guardrails against ongoing jailbreaks.", "Detect injections and clean inputs.", "Review prompt handling."),
        ("autonomy", "Add approval gates for autonomous agents.", "Put a person in the loop for tools.", "Review what agents may do."),
    )
    parts = [f"CASE WHEN {c} >= 15 THEN {sql.lit(a)} WHEN {c} >= 8 THEN {sql.lit(b)} WHEN {c} > 0 THEN {sql.lit(d)} END" for c, a, b, d in tiers]
    parts.append("CASE WHEN score >= 90 THEN 'Start incident response.' WHEN score >= 70 THEN 'Remediate the top findings first.' END")
    return f"{_risk4_sql()} SELECT *, {_BAND} AS severity, list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL) AS recommendations FROM r4"


@query(_advice_sql())
def recommendations4(spark, sf_dir):
    """T4: advice by tier."""
    return risk.recommendations4(scores4(spark, sf_dir)[0])


@query()
def enhanced_basic(spark, sf_dir):
    """Eight categories from four."""
    scores, f, i = scores4(spark, sf_dir)
    return risk.enhanced_basic(risk.risk_overall(scores, f), i, f)


def _rules8_sql() -> str:
    """One row a rule, group and keyword in order; a rule's evidence in a scope is each group's first keyword that a finding there holds."""
    words = [(n, k, m, w) for n, (*_, groups) in enumerate(risk.RULES) for k, g in enumerate(groups) for m, w in enumerate(g)]
    rules = [(n, label, cat, stage, float(conf), float(weight), len(groups)) for n, (label, cat, stage, conf, weight, groups) in enumerate(risk.RULES)]
    return (
        f"WITH {sql.WITH_PLANTED}, {sql.iocs()}, {_IND}, {_FIND}, s AS (SELECT *, {_FTEXT} AS t, unnest([platform, 'ALL']) AS scope FROM fnd), "
        f"kw AS {sql.values(words, 'no, grp, nth, word')}, rl AS {sql.values(rules, 'no, label, category, stage, confidence, base, n_groups')}, "
        "hit AS (SELECT DISTINCT scope, w.word FROM s JOIN (SELECT DISTINCT word FROM kw) w ON contains(s.t, w.word)), "
        "evi AS (SELECT scope, no, grp, arg_min(kw.word, nth) AS word FROM kw JOIN hit USING (word) GROUP BY scope, no, grp), "
        "fired AS (SELECT scope, no, list(word) AS evidence FROM evi GROUP BY scope, no HAVING count(*) = (SELECT n_groups FROM rl WHERE rl.no = evi.no)), "
        "told AS (SELECT scope, no, sum(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 ELSE 0 END) AS boost, count(*) AS n_findings "
        "FROM s JOIN fired USING (scope) WHERE len(list_filter(evidence, lambda w: contains(t, w))) > 0 GROUP BY scope, no), "
        "r8 AS (SELECT scope, label, category, stage, CAST(confidence AS DOUBLE) AS confidence, CAST(least(base + boost, 12.5) AS DOUBLE) AS weight, CAST(n_findings AS BIGINT) AS n_findings FROM told JOIN rl USING (no))"
    )


_IR = sql.values(risk.IOC_RISK, "kind, category, stage, base")
_CONFIDENCE8 = "CAST(CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.4 ELSE 0.2 END AS DOUBLE) AS confidence"
_I8 = (
    f"i8 AS (SELECT scope, 'IOC: ' || kind AS label, category, stage, {_CONFIDENCE8}, CAST(base AS DOUBLE) AS weight, CAST(1 AS BIGINT) AS n_findings "
    f"FROM (SELECT *, unnest([platform, 'ALL']) AS scope FROM (SELECT DISTINCT kind, value, severity, platform FROM iocs)) JOIN {_IR} m USING (kind))"
)
_SUM8 = ", ".join(f"round(least(sum(CASE WHEN category = '{c}' THEN weight ELSE 0 END), 12.5), 2) AS {c}" for c in risk.CATEGORIES)


def _told8_sql() -> str:
    """Scores of what the risk rules find in titles, and of scanned indicators."""
    return (
        f"{_rules8_sql()}, {_I8}, s8 AS (SELECT scope, {_SUM8}, round(sum(confidence * weight) / sum(weight), 2) AS confidence FROM (SELECT * FROM r8 UNION ALL SELECT * FROM i8) GROUP BY scope), "
        f"t8 AS (SELECT *, CAST(least(100, floor({' + '.join(risk.CATEGORIES)})) AS INT) AS score FROM s8)"
    )


def _whole8_sql() -> str:
    """All risk indicators and the findings and values behind them: of rules on quoted findings of every detector, of scanned indicators and secrets, of shared credentials."""
    masked = "CASE WHEN kind <> 'credential' THEN value WHEN length(value) > 12 THEN left(value, 6) || '...' || right(value, 4) ELSE left(value, 4) || '...' END"
    rules = _rules8_sql()
    return (
        f"WITH {sql.WITH_PLANTED}, {sql.iocs()}, {_IND}, "
        f"sv AS (SELECT * FROM (SELECT *, {_ENTROPY} AS e FROM ({_SECRET_ARMS}) WHERE NOT regexp_matches(v, {sql.lit(R.PLACEHOLDER)})) WHERE e >= least), "
        f"sec AS (SELECT source_file, platform, rule, severity, CAST(c.confidence AS DOUBLE) AS confidence, left(v, 4) || '...' || right(v, 4) || ' (' || length(v) || ' chars)' AS value FROM sv JOIN {sql.values([(r.id, float(r.confidence)) for r in R.SECRET_RULES], 'rule, confidence')} c USING (rule)), "
        f"b64 AS (SELECT source_file, platform, decode(try(from_base64(block)), 'replace') AS value FROM (SELECT source_file, platform, unnest(regexp_extract_all(content, {sql.lit(X.BASE64_BLOCK)})) AS block FROM ev) WHERE length(block) % 4 = 0), "
        "every AS (SELECT kind, value, source_file, platform, rule, severity, confidence FROM ind UNION ALL SELECT 'credential', value, source_file, platform, rule, severity, confidence FROM sec "
        f"UNION ALL SELECT 'jailbreak', value, source_file, platform, 'base64_injection', 'critical', 0.9 FROM b64 WHERE regexp_matches(value, {sql.lit(R.INJECTION_WORDS)})), "
        "fi AS (SELECT kind, value, source_file, min_by(rule, rule) AS rule, min_by(severity, rule) AS severity, min_by(platform, rule) AS platform, min_by(confidence, rule) AS confidence FROM every GROUP BY kind, value, source_file), "
        "fnd AS (SELECT 'AI-' || left(sha256(kind || '|' || value || '|' || source_file), 12) AS id, replace(kind, '_', ' ') || ': ' || rule AS title, "
        f"'Matched ' || rule || ' in ' || source_file || ': ' || {masked} AS description, severity, platform FROM fi WHERE confidence >= 0.7), "
        + rules[rules.index("s AS (SELECT *, ") : rules.index("evi AS (")]
        + "evi AS (SELECT scope, no, grp, arg_min(kw.word, nth) AS word FROM kw JOIN hit USING (word) GROUP BY scope, no, grp), "
        "fired AS (SELECT scope, no, list(word ORDER BY grp) AS evidence FROM evi GROUP BY scope, no HAVING count(*) = (SELECT n_groups FROM rl WHERE rl.no = evi.no)), "
        "held AS (SELECT scope, no, evidence, id, severity, platform FROM s JOIN fired USING (scope) WHERE len(list_filter(evidence, lambda w: contains(t, w))) > 0), "
        "told AS (SELECT scope, no, evidence, sum(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 ELSE 0 END) AS boost, count(*) AS n_findings, list_sort(list(DISTINCT platform)) AS platforms FROM held GROUP BY scope, no, evidence), "
        "r8 AS (SELECT scope, label, category, stage, CAST(confidence AS DOUBLE) AS confidence, CAST(least(base + boost, 12.5) AS DOUBLE) AS weight, CAST(n_findings AS BIGINT) AS n_findings, array_to_string(evidence, ', ') AS evidence, array_to_string(platforms, ', ') AS platforms, no FROM told JOIN rl USING (no)), "
        "every_ioc AS (SELECT kind, value, severity, platform FROM iocs UNION ALL SELECT 'api_key', value, 'critical', platform FROM sec), "
        f"i8 AS (SELECT scope, 'IOC: ' || kind AS label, category, stage, {_CONFIDENCE8}, CAST(CASE WHEN kind = 'api_key' AND regexp_matches(value, '{risk.KEY_PREFIX}') THEN {risk.CAP} ELSE base END AS DOUBLE) AS weight, CAST(1 AS BIGINT) AS n_findings, value AS evidence, platform AS platforms "
        f"FROM (SELECT *, unnest([platform, 'ALL']) AS scope FROM (SELECT DISTINCT * FROM every_ioc)) JOIN {_IR} m USING (kind)), "
        "p8 AS (SELECT list_sort(list(DISTINCT platform)) AS p FROM every_ioc WHERE kind = 'api_key'), "
        "a8 AS (SELECT 'ALL' AS scope, 'Credentials on several platforms' AS label, 'lateral_movement' AS category, 'exploitation' AS stage, CAST(0.2 AS DOUBLE) AS confidence, CAST(8 AS DOUBLE) AS weight, CAST(len(p) AS BIGINT) AS n_findings, array_to_string(p, ', ') AS evidence, array_to_string(p, ', ') AS platforms, p FROM p8 WHERE len(p) > 1)"
    )


@query(
    f"{_whole8_sql()} SELECT r8.* EXCLUDE (no), id AS source_id FROM r8 JOIN held USING (scope, no) UNION ALL SELECT *, evidence FROM i8 UNION ALL SELECT * EXCLUDE (p), unnest(p) FROM a8"
)
def risk8_indicators(spark, sf_dir):
    """Risk indicators of each scope with their evidence and platforms, a row for each finding, value or platform behind one."""
    i, f = scanned8(spark, sf_dir)
    shared = risk.risk8_shared_cred(i).withColumn("source_id", F.explode("platforms"))
    rows = risk.risk8_sources(risk.risk8_indicators(f), f).unionByName(risk.risk8_ioc_indicators(i).withColumn("source_id", F.col("evidence")[0])).unionByName(shared)
    return rows.withColumns({"evidence": F.array_join("evidence", ", "), "platforms": F.array_join("platforms", ", ")})


def scanned8(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(iocs with secrets, findings of all detectors with what they matched), of scans written once."""
    docs, null = evidence(spark, sf_dir, True), F.array().cast("array<string>")
    more = {"phase": F.lit(""), "atlas": null, "attack": null, "advice": F.lit("")}
    secrets = detect.secret_scan(docs).select("source_file", "platform", "rule", F.lit("api_key").alias("kind"), "severity", "confidence", F.col("redacted").alias("value")).withColumns(more)
    hits = written(detect.scan(docs, R.IOC_RULES + R.AI_RULES).unionByName(secrets).unionByName(detect.ai_base64_injection(docs).withColumns(more)), "hits")
    kinds = lambda rules: sorted({r.kind for r in rules})
    key = F.col("kind") == "api_key"
    i = hits.where(F.col("kind").isin("api_key", *kinds(R.IOC_RULES))).withColumn("severity", F.when(key, "critical").otherwise(F.col("severity")))
    told = hits.where(F.col("kind").isin("api_key", *kinds(R.AI_RULES))).withColumn("kind", F.when(key, "credential").otherwise(F.col("kind")))
    return detect.kept_iocs(i), detect.indicators_to_findings(dedup.dedup_first(told, ["kind", "value", "source_file"], ["rule"]), quoted=True)


def indicators8(spark, sf_dir) -> DataFrame:
    """Risk indicators of rules, scanned indicators, secrets and shared credentials."""
    i, f = scanned8(spark, sf_dir)
    return risk.risk8_indicators(f).unionByName(risk.risk8_ioc_indicators(i)).unionByName(risk.risk8_shared_cred(i))


def told8(spark, sf_dir) -> DataFrame:
    """Risk indicators of rules on titles and of scanned indicators, all that the SQL of narratives and actions has."""
    i, _, f = scanned(spark, sf_dir)
    return risk.risk8_indicators(f).unionByName(risk.risk8_ioc_indicators(i))


_STAGES8 = f"array_to_string(list_filter([{', '.join(map(sql.lit, risk.STAGES))}], lambda x: list_contains(stages, x)), ',') AS stages"


@query(
    f"{_whole8_sql()}, s8 AS (SELECT scope, {_SUM8}, round(sum(confidence * weight) / sum(weight), 2) AS confidence, list(DISTINCT stage) AS stages FROM (SELECT scope, category, stage, confidence, weight FROM r8 UNION ALL SELECT scope, category, stage, confidence, weight FROM i8 UNION ALL SELECT scope, category, stage, confidence, weight FROM a8) GROUP BY scope), "
    f"t8 AS (SELECT *, CAST(least(100, floor({' + '.join(risk.CATEGORIES)})) AS INT) AS score FROM s8) SELECT * EXCLUDE (stages), {_BAND} AS severity, {_STAGES8} FROM t8"
)
def risk8_score(spark, sf_dir):
    """Eight-category score of each platform and of all, with the stages seen."""
    return risk.risk8_score(indicators8(spark, sf_dir), 2).withColumn("stages", F.array_join("stages", ","))


@query()
def narratives8(spark, sf_dir):
    """Narratives of each scope."""
    return risk.narratives8(told8(spark, sf_dir))


@query()
def narratives_report(spark, sf_dir):
    """Report narratives."""
    return risk.narratives_report(*reversed(scanned(spark, sf_dir)[::2]))


@query()
def priority_actions(spark, sf_dir):
    """Most urgent actions."""
    return risk.priority_actions(risk.risk8_score(told8(spark, sf_dir)))


# --- timeline ------------------------------------------------------------------------------------------------------


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL ORDER BY day DESC LIMIT 30")
def daily_activity(spark, sf_dir):
    """Events of the last 30 days present."""
    return correlate.daily_activity(load(spark, sf_dir, "events"), "ts").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def window_counts(spark, sf_dir):
    """X3 as batch: rows per hour and type."""
    return stream.window_counts(load(spark, sf_dir, "events"), ["event_type"], "ts")


@query(
    "WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE ts IS NOT NULL), s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e) "
    "SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, g"
)
def session_counts(spark, sf_dir):
    """X4 as batch: sessions of each user."""
    return stream.session_counts(load(spark, sf_dir, "events"), ["user_id"], "ts")


def _event_rows(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events")
    text = F.concat("event_type", F.lit(" "), F.coalesce("props", F.lit("")))
    return e.select(
        F.col("ts").alias("timestamp"), F.concat(F.lit("user"), F.pmod("user_id", F.lit(5)).cast("string")).alias("platform"), F.lit("log").alias("artifact_type"), text.alias("description"), X.infer_severity(text).alias("severity"), F.lit("events").alias("source_path"),
        F.lit(False).alias("is_collection_event"), X.preview(text).alias("content_preview"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("seq"),
    )


@query(
    "WITH t AS (SELECT 'user' || (((user_id % 5) + 5) % 5) AS platform, date_trunc('second', ts) AS s, trim(replace(left(event_type || ' ' || coalesce(props, ''), 120), chr(10), ' ')) AS k FROM events), "
    "d AS (SELECT DISTINCT platform, 'log' AS artifact_type, s, k, false AS is_collection_event FROM t UNION ALL "
    "SELECT DISTINCT source, 'conversation', TIMESTAMP '2025-01-01' + to_seconds(doc_id % 86400), 'Collected doc/' || doc_id, true FROM documents) "
    "SELECT platform, artifact_type, is_collection_event, count(*) AS n, count(DISTINCT s) AS n_seconds FROM d GROUP BY ALL"
)
def unified_timeline(spark, sf_dir):
    """Log events, their own collection records (which yield to them) and records of collected files on one timeline, best of equal ones."""
    real = _event_rows(spark, sf_dir)
    collected_at = F.timestamp_seconds(F.lit(1735689600) + F.pmod("doc_id", F.lit(86400)))
    manifest = load(spark, sf_dir, "documents").select(F.col("source").alias("platform"), F.lit("conversation").alias("artifact_type"), F.concat(F.lit("doc/"), "doc_id").alias("original_path"), collected_at.alias("collected_at"))
    every = timeline.unified_timeline(real.withColumn("is_collection_event", F.lit(True)), real, timeline.collection_events(manifest))
    return every.groupBy("platform", "artifact_type", "is_collection_event").agg(F.count("*").alias("n"), F.count_distinct(F.date_trunc("second", "timestamp")).alias("n_seconds"))


@query()
def turn_timeline(spark, sf_dir):
    """Turns, configurations and indicators as events by kind and severity."""
    collected = F.to_timestamp(F.lit("2025-01-01 00:00:00"))
    told = timeline.turn_events(turns(spark, sf_dir).withColumn("timestamp", collected))
    files = evidence(spark, sf_dir, True).withColumn("modified_at", collected)
    seen = timeline.indicator_events(indicators(spark, sf_dir).withColumn("event_time", collected))
    every = timeline.unified_timeline(told, timeline.config_events(files), seen)
    return every.groupBy("artifact_type", "severity").agg(F.count("*").alias("n"))


_SEV = "CASE " + " ".join(f"WHEN regexp_matches(content, {sql.lit(p)}) THEN '{s}'" for s, p in X.SEVERITY_PATTERNS) + " ELSE 'info' END"


@query(f"WITH {sql.WITH_PLANTED} SELECT platform, {_SEV} AS severity, count(*) AS n FROM ev WHERE content IS NOT NULL GROUP BY ALL")
def infer_severity(spark, sf_dir):
    """severity of each text."""
    return evidence(spark, sf_dir, True).where("content is not null").groupBy("platform", X.infer_severity(F.col("content")).alias("severity")).agg(F.count("*").alias("n"))


@query(
    "SELECT count(*) AS n, count(DISTINCT epoch(ts)) AS n_seconds, CAST(sum(CAST(floor(epoch(ts)) AS BIGINT)) AS BIGINT) AS checksum FROM events WHERE ts IS NOT NULL"
)
def normalize_timestamp(spark, sf_dir):
    """Times of events through their text, epoch, log-line and browser forms; all forms must agree."""
    e = load(spark, sf_dir, "events").where("ts is not null").select(F.col("ts").cast("timestamp").alias("ts")).withColumn("s", F.date_trunc("second", "ts"))
    iso = F.date_format("s", "yyyy-MM-dd'T'HH:mm:ss")
    seconds = F.unix_seconds("s")
    forms = [X.normalize_timestamp(iso), X.normalize_timestamp(seconds.cast("string")), X.normalize_timestamp((seconds * 1000 + 1).cast("string")), X.log_line_timestamp(F.concat(F.lit("["), iso, F.lit("] started"))), X.webkit_time(seconds * 1000000 + 11644473600000000)]
    agree = [F.date_trunc("second", f) == F.col("s") for f in forms]
    good = agree[0]
    for a in agree[1:]:
        good = good & a
    return e.where(good).agg(F.count("*").alias("n"), F.count_distinct("ts").alias("n_seconds"), F.sum(F.unix_seconds("ts")).alias("checksum"))


# --- lookups and inventories ---------------------------------------------------------------------------------------

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1))"
_MORE = (("example.org", "Example Site", "web"), ("example.net", "Example Net", "web"))
_DOM = sql.values([(n, *d) for n, d in enumerate((*lookup.DOMAINS, *_MORE))], "no, suffix, provider, category")


@query(f"WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), j AS (SELECT host, min_by(provider, no) AS provider FROM h JOIN {_DOM} d ON host = suffix OR ends_with(host, '.' || suffix) GROUP BY host) SELECT provider, count(*) AS n_hosts FROM h LEFT JOIN j USING (host) GROUP BY ALL")
def classify_domain(spark, sf_dir):
    """Provider of each host by suffix."""
    hosts = load(spark, sf_dir, "pages").select(lookup.host_of(F.col("url")).alias("host")).distinct()
    return lookup.classify_domain(hosts, lookup.domains(spark, _MORE)).groupBy("provider").agg(F.count("*").alias("n_hosts"))


_FRM = sql.values([(n, *d) for n, d in enumerate(lookup.FRAMEWORKS)], "no, prefix, framework, category")


@query(
    f"WITH {sql.WITH_PLANTED}, m AS (SELECT DISTINCT source_file AS path, unnest(regexp_extract_all(content, '(?m)^[ \\t]*(?:from|import)[ \\t]+([A-Za-z_][A-Za-z0-9_.]*)', 1)) AS module FROM ev), j AS (SELECT path, module, min_by(framework, no) AS framework FROM m JOIN {_FRM} d ON module = prefix OR starts_with(module, prefix || '.') GROUP BY ALL) "
    "SELECT framework, count(DISTINCT path) AS n_files FROM j GROUP BY ALL"
)
def scan_code_imports(spark, sf_dir):
    """AI frameworks imported."""
    return detect.scan_code_imports(evidence(spark, sf_dir, True), lookup.frameworks(spark)).select("framework", "n_files")


_URLP = "CASE " + " ".join(f"WHEN contains(lower(url), {sql.lit(p)}) THEN {sql.lit(n)}" for p, n in lookup.URL_PROVIDERS) + f" ELSE {sql.lit(lookup.UNKNOWN_PROVIDER)} END"
_HIST = f"hist AS (SELECT url, CAST(1 AS BIGINT) AS visit_count FROM pages UNION ALL SELECT url, CAST(visits AS BIGINT) FROM {sql.values(planted.HISTORY, 'url, title, visits, last')})"


def history(spark, sf_dir) -> DataFrame:
    real = load(spark, sf_dir, "pages").select("url", F.lit("").alias("title"), F.lit(1).cast("long").alias("visit_count"), (F.col("page_id") * 1000000 + 13370000000000000).alias("last_visit_time"))
    return real.unionByName(spark.createDataFrame(list(planted.HISTORY), "url string, title string, visit_count long, last_visit_time long"))


@query(f"WITH {_HIST} SELECT {_URLP} AS provider, CAST(sum(visit_count) AS BIGINT) AS visits, count(*) AS n_urls FROM hist GROUP BY ALL")
def provider_visits(spark, sf_dir):
    """Visits by chat provider."""
    return lookup.provider_visits(history(spark, sf_dir)).drop("sample")


@query()
def browser_history(spark, sf_dir):
    """Newest visits to model sites."""
    return ev.browser_history(history(spark, sf_dir)).select("url", "provider", "visit_count", "visited_at")


def net(spark, sf_dir) -> DataFrame:
    """Connections derived from events: a process, a port and a host each."""
    hosts = F.array(*[F.lit(h) for h in ("api.openai.com", "eu.api.anthropic.com", "files.example.org", "huggingface.co", "10.0.0.8")])
    ports = F.array(*[F.lit(p) for p in (443, 11434, 22, 8000)])
    e = load(spark, sf_dir, "events")
    at = lambda a, c, n: F.element_at(a, (F.pmod(c, F.lit(n)) + 1).cast("int"))
    return e.select(F.col("user_id").alias("pid"), F.col("event_type").alias("process"), at(hosts, F.col("event_id"), 5).alias("domain"), at(ports, F.col("event_id"), 4).alias("port"), F.lit("open").alias("state"))


_CONN = "conn AS (SELECT user_id AS pid, event_type AS process, (['api.openai.com', 'eu.api.anthropic.com', 'files.example.org', 'huggingface.co', '10.0.0.8'])[event_id % 5 + 1] AS domain, ([443, 11434, 22, 8000])[event_id % 4 + 1] AS port FROM events)"


@query(f"WITH {_CONN}, h AS (SELECT DISTINCT domain FROM conn), j AS (SELECT domain, min_by(provider, no) AS provider FROM h JOIN {_DOM} d ON (domain = suffix OR ends_with(domain, '.' || suffix)) AND no < {len(lookup.DOMAINS)} GROUP BY domain) SELECT domain, provider, count(DISTINCT pid) AS n_pids, string_agg(DISTINCT process, ',' ORDER BY process) AS processes, count(*) AS n FROM conn JOIN j USING (domain) GROUP BY ALL")
def network_ai(spark, sf_dir):
    """Connections to model services."""
    found = lookup.network_ai(ev.connections(net(spark, sf_dir)), lookup.domains(spark))
    return found.select("domain", "provider", "n_pids", F.array_join("processes", ",").alias("processes"), "n")


@query(f"WITH {_CONN} SELECT port, service, count(*) AS n FROM conn LEFT JOIN {sql.values(X.SERVICE_PORTS.items(), 'port, service')} p USING (port) GROUP BY ALL")
def resolve_port_service(spark, sf_dir):
    """Services of ports."""
    ports = spark.createDataFrame(list(X.SERVICE_PORTS.items()), "port int, service string")
    return lookup.resolve_port_service(net(spark, sf_dir), ports).groupBy("port", "service").agg(F.count("*").alias("n"))


@query(f"WITH {_CONN}, p AS (SELECT DISTINCT user_id AS pid, CASE WHEN user_id % 3 = 0 THEN 'ollama serve' ELSE 'bash' END AS command FROM events) SELECT process, count(*) AS n FROM conn WHERE pid IN (SELECT pid FROM p WHERE contains(command, 'ollama')) GROUP BY ALL")
def ai_pid_connections(spark, sf_dir):
    """Connections of model processes."""
    p = load(spark, sf_dir, "events").select(F.col("user_id").alias("pid")).distinct().withColumns({"name": F.lit("proc"), "command": F.when(F.col("pid") % 3 == 0, "ollama serve").otherwise("bash")})
    return lookup.ai_pid_connections(net(spark, sf_dir), p).groupBy("process").agg(F.count("*").alias("n"))


def files(spark, sf_dir) -> DataFrame:
    """A file inventory derived from documents: a path below a home and a size each."""
    roots = F.array(*[F.lit(p) for p in (".claude/projects/x.jsonl", ".cursor/mcp.json", "notes/readme.txt", ".ollama/history", "src/node_modules/a.py", "src/app.py", ".env")])
    d = load(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("/home/"), F.col("source"), F.lit("/"), F.element_at(roots, (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))).alias("path"), F.col("source").alias("platform"), F.length("text").cast("long").alias("size"), F.col("doc_id"))


_FILES = "files AS (SELECT '/home/' || source || '/' || (['.claude/projects/x.jsonl', '.cursor/mcp.json', 'notes/readme.txt', '.ollama/history', 'src/node_modules/a.py', 'src/app.py', '.env'])[doc_id % 7 + 1] AS path, source AS platform, length(text) AS size, doc_id FROM documents)"


@query(f"WITH {_FILES} SELECT CASE WHEN contains(path, '/.claude/') THEN 'claude_code' WHEN contains(path, '/.cursor/') THEN 'cursor' ELSE 'ollama' END AS tool, count(DISTINCT path) AS n_files FROM files WHERE contains(path, '/.claude/') OR contains(path, '/.cursor/') OR contains(path, '/.ollama/') GROUP BY ALL")
def shadow_ai_tools(spark, sf_dir):
    """Tools by the folders that hold their files."""
    return lookup.shadow_ai_tools(files(spark, sf_dir).dropDuplicates(["path"]), lookup.shadow_tools(spark)).select("tool", "n_files")


@query(f"WITH {_FILES} SELECT CASE WHEN path LIKE '%/.env' THEN 'credential' WHEN path LIKE '%history' OR path LIKE '%.jsonl' THEN 'history' ELSE 'text' END AS kind, count(*) AS n FROM files WHERE NOT contains(path, 'node_modules') AND NOT path LIKE '%.py' GROUP BY ALL")
def curated_files(spark, sf_dir):
    """P5: files worth collecting."""
    rows = files(spark, sf_dir).withColumn("kind", lookup.curated(F.col("path"), F.col("size"))).where("kind is not null")
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {_FILES} SELECT platform, count(*) AS n FROM files WHERE path LIKE '%.py' AND NOT contains(path, 'node_modules') GROUP BY ALL")
def code_files(spark, sf_dir):
    """Source files."""
    return files(spark, sf_dir).where(lookup.code_file(F.col("path"))).groupBy("platform").agg(F.count("*").alias("n"))


@query(f"WITH {_FILES}, w AS (SELECT *, count(*) OVER (PARTITION BY platform ORDER BY path, doc_id ROWS UNBOUNDED PRECEDING) AS nth FROM files) SELECT platform, count(*) FILTER (nth <= 20) AS kept, count(*) FILTER (nth > 20) AS skipped FROM w GROUP BY ALL")
def budgeted_collection(spark, sf_dir):
    """Files within a budget, and what was skipped."""
    rows = files(spark, sf_dir).withColumn("path", F.concat("path", F.lit("#"), F.lpad(F.col("doc_id").cast("string"), 12, "0")))
    kept, cut = lookup.budgeted_collection(rows, 20, 1 << 60)
    counts = kept.groupBy("platform").agg(F.count("*").alias("kept"))
    return counts.join(cut.select("platform", "skipped"), "platform", "left").withColumn("skipped", F.coalesce("skipped", F.lit(0)).cast("long"))


@query("SELECT event_type AS key, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL ORDER BY n DESC, key LIMIT 20")
def model_usage(spark, sf_dir):
    """Most frequent values of a column."""
    return correlate.model_usage(load(spark, sf_dir, "events"), "event_type")


_ENVK = "(?m)^(?:export +)?([A-Za-z_][A-Za-z0-9_]*)="


@query(f"WITH {sql.WITH_PLANTED}, k AS (SELECT source_file, platform, unnest(regexp_extract_all(content, '{_ENVK}', 1)) AS key FROM ev) SELECT source_file, platform, key, regexp_matches(key, '(?i)(key|secret|token|password|credential)') AS sensitive FROM k")
def env_entries(spark, sf_dir):
    """names in environment lines; values are never kept."""
    rows = evidence(spark, sf_dir, True).select("source_file", "platform", F.explode(X.env_entries(F.col("content"))).alias("e"))
    return rows.select("source_file", "platform", "e.key", "e.sensitive")


@query()
def env_redaction(spark, sf_dir):
    """Environment files with values of sensitive keys replaced."""
    return detect.env_redaction(evidence(spark, sf_dir, True)).where("had_secrets").select("source_file", "content", "severity")


@query()
def log_stats(spark, sf_dir):
    """Configuration flags, log statistics, commands and settings of all texts, counted by platform."""
    e = evidence(spark, sf_dir, True)
    stats = detect.gateway_log_stats(e).where((F.col("n_errors") > 0) | (F.size("models") > 0)).select("platform", F.lit("log").alias("kind"), "severity")
    flags = detect.config_flags(e).select("platform", F.lit("config").alias("kind"), "severity")
    commands = detect.session_log_commands(e).select("platform", F.lit("command").alias("kind"), F.when(F.col("sensitive"), "medium").otherwise("info").alias("severity"))
    settings = detect.agent_settings_flags(e).where(F.col("severity") != "info").select("platform", F.lit("settings").alias("kind"), "severity")
    return lookup.chain(stats, flags, commands, settings).groupBy("platform", "kind", "severity").agg(F.count("*").alias("n"))


_KEY = "CASE WHEN length(k) > 12 THEN left(k, 6) || '...' || right(k, 4) ELSE left(k, 4) || '...' END"


@query(
    f"WITH {sql.WITH_PLANTED}, l AS (SELECT platform, unnest(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM ev), "
    "a AS (SELECT source_file, platform, unnest(regexp_extract_all(content, '\\b(sk-[A-Za-z0-9_-]{20,})\\b', 1)) AS k FROM ev), "
    f"d AS (SELECT platform, count(DISTINCT source_file || ' ' || {_KEY}) AS n FROM a GROUP BY platform) "
    "SELECT platform, 'headings' AS kind, CAST(sum(len(regexp_extract_all(content, '(?m)^#### ')) + len(regexp_extract_all(content, '(?m)^# '))) AS BIGINT) AS n FROM ev GROUP BY platform "
    "UNION ALL SELECT platform, 'lines', count(*) FROM l WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') GROUP BY platform "
    "UNION ALL SELECT platform, 'keys', coalesce(max(d.n), 0) FROM ev LEFT JOIN d USING (platform) GROUP BY platform"
)
def inventories(spark, sf_dir):
    """Markdown histories, command histories and routes of all texts, counted by platform."""
    e = evidence(spark, sf_dir, True)
    aider = inventory.aider_history(e).select("platform", (F.col("n_prompts") + F.col("n_sessions")).alias("n"), F.lit("headings").alias("kind"))
    cli = inventory.cli_history_summary(inventory.cli_history(e)).select("platform", F.col("n_lines").alias("n"), F.lit("lines").alias("kind"))
    routes = inventory.routing_rules(e).select("platform", F.size("keys").alias("n"), F.lit("keys").alias("kind"))
    return lookup.chain(aider, cli, routes).groupBy("platform", "kind").agg(F.sum("n").cast("long").alias("n"))


@query(f"WITH {sql.DOCS}, c AS (SELECT source_file, unnest(range(0, greatest(length(content) - 1024, 1), 7168)) AS pos, content FROM ev), m AS (SELECT source_file, count(*) AS chunks, CAST(sum(length(substr(content, pos + 1, 8192))) AS BIGINT) AS chars FROM c GROUP BY ALL) SELECT * FROM m")
def chunk_text(spark, sf_dir):
    """Long texts as overlapping chunks."""
    rows = ev.chunk_text(evidence(spark, sf_dir).where("content is not null"), size=8192, overlap=1024)
    return rows.groupBy("source_file").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query()
def stix_objects(spark, sf_dir):
    """STIX objects of indicators, findings and techniques; a finding refers to the indicators of its own value."""
    i, seen, _ = scanned(spark, sf_dir)
    i = dedup.dedup_first(i, ["kind", "value", "source_file"], ["rule"])
    atlas = mitre.atlas_map_iocs(i)
    first = dedup.dedup_first(seen, ["kind", "value", "source_file"], ["rule"])
    told = detect.indicators_to_findings(first)
    links = first.select(F.concat(F.lit("AI-"), F.left(F.sha2(F.concat_ws("|", "kind", "value", "source_file"), 256), F.lit(12))).alias("id"), "value").join(told.select("id"), "id", "left_semi")
    return sinks.stix_objects(i, told, atlas, mitre.coa_lookup(atlas.select("technique_id").distinct()), links)


_CT = sql.values(list(sinks.CASE_TYPES.items()), "kind, t")


@query(f"WITH {sql.WITH_PLANTED}, {sql.iocs()} SELECT DISTINCT coalesce(t, 'other') AS ioc_type, value AS ioc_value, 'amber' AS tlp, 'evidence:' || platform AS tags, 'From ' || source_file AS description FROM iocs LEFT JOIN {_CT} m USING (kind)")
def case_rows(spark, sf_dir):
    """K5: indicators for a case system."""
    return sinks.case_rows(iocs(spark, sf_dir, True))


@query(f"WITH {sql.TURNS} SELECT platform, role, content, model, session_id, session_id AS source_file, tool_command FROM turns")
def export_rows(spark, sf_dir):
    """Turns with the export's columns."""
    t = turns(spark, sf_dir).withColumns({"tool_description": F.lit(None).cast("string"), "workspace": F.lit(None).cast("string")})
    return sinks.export_rows(t).select("platform", "role", "content", "model", "session_id", "source_file", "tool_command")


@query("SELECT 'doc/' || doc_id AS source_file, CAST(1 AS BIGINT) AS row_count, CAST(strlen(text) AS INT) AS size_bytes, sha256(text) AS sha256 FROM documents")
def manifest_rows(spark, sf_dir):
    """K2: digest and size of each source."""
    e = evidence(spark, sf_dir).withColumn("modified_at", F.lit(None).cast("timestamp"))
    return sinks.manifest_rows(e, e).drop("modified_at")


from gumshoe.plans import ingest, reports  # noqa: E402, F401  register their queries
