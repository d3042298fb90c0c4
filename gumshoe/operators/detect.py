"""Detection operators: text corpora to indicator rows.

Every detector is one projection over the corpus: an array of (rule, matches)
built by native regular expressions, exploded to one row per match.  Rules carry
their attributes as literals, so no join with a catalog is needed.  A pattern runs
only on texts that hold the strings it needs (``functions.screen``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.functions import text as X
from gumshoe.functions.screen import candidates, screened
from gumshoe.operators import rules as R
from gumshoe.operators.links import linked
from gumshoe.operators.rules import Rule

EVIDENCE = ("source_file", "platform")


def _strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _found(rule: Rule, matches: Column) -> Column:
    return F.struct(
        F.lit(rule.id).alias("rule"),
        F.lit(rule.kind).alias("kind"),
        F.lit(rule.severity).alias("severity"),
        F.lit(float(rule.confidence)).alias("confidence"),
        F.lit(rule.phase).alias("phase"),
        _strings(rule.atlas).alias("atlas"),
        _strings(rule.attack).alias("attack"),
        F.lit(rule.advice).alias("advice"),
        F.lit(int(rule.meta.get("pad", 75))).alias("pad"),
        matches.alias("matches"),
    )


def scan(df: DataFrame, rules: Iterable[Rule], text_col: str = "content", id_cols: tuple[str, ...] = EVIDENCE, positions: bool = False, context: int | None = None) -> DataFrame:
    """One row per match of each rule: ids, rule attributes, value and, with ``positions``, start, end and context.

    Rows whose text is null or has no match give no rows.
    """
    text, rules = F.col("_text"), list(rules)
    match = X.all_matches if positions else lambda t, p: F.regexp_extract_all(t, F.lit(X.in_java(p)), F.lit(0))
    rows, may = candidates(df.select(*id_cols, F.col(text_col).alias("_text")), rules, "_text")
    each = [_found(r, F.when(m, match(text, r.pattern))) for r, m in zip(rules, may)]
    hits = rows.select(*id_cols, *(["_text"] if positions else []), F.explode(F.filter(F.array(*each), lambda s: F.size(s["matches"]) > 0)).alias("r"))
    hits = hits.select("*", F.explode("r.matches").alias("m"))
    keep = [F.col(f"r.{c}") for c in ("rule", "kind", "severity", "confidence", "phase", "atlas", "attack", "advice")]
    if not positions:
        return hits.select(*id_cols, *keep, F.col("m").alias("value")).where("value <> ''")
    pad = F.col("r.pad") if context is None else F.lit(context)
    most = F.when(F.col("r.pad") == 75, 150).otherwise(200)
    near = X.context_window(F.col("_text"), F.col("m.start"), F.col("m.end"), pad, 200)
    return hits.select(*id_cols, *keep, F.col("m.value").alias("value"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.left(near, most).alias("context")).where("value <> ''")


# --- predicates on indicators --------------------------------------------------------------------------------------


def drop_private_ips(df: DataFrame, strict: bool = False) -> DataFrame:
    """Without loopback and private addresses; 172.* as a whole unless ``strict``."""
    private = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|127\.|0\.)" if strict else r"^(10\.|172\.|192\.168\.|127\.|0\.)"
    return df.where(~((F.col("kind") == "ip") & F.col("value").rlike(private)))


def drop_benign_domains(df: DataFrame) -> DataFrame:
    """Without the reserved example hosts."""
    return df.where(~((F.col("kind") == "domain") & F.lower("value").isin("example.com", "localhost.com")))


def drop_short_paths(df: DataFrame, least: int = 8) -> DataFrame:
    """Paths of at most ``least`` characters go."""
    return df.where(~((F.col("kind") == "filepath") & (F.length("value") <= least)))


def indicators_to_findings(df: DataFrame, least: float = 0.7, quoted: bool = False) -> DataFrame:
    """Indicators of enough confidence as findings; ids hash the identity, so reruns agree.

    ``quoted`` ends descriptions with the matched text, of credentials with its edges only.
    """
    shown = [F.lit(": "), F.when(F.col("kind") == "credential", X.redact_edges(F.col("value"))).otherwise(F.col("value"))] if quoted else []
    return df.where(F.col("confidence") >= least).select(
        F.concat(F.lit("AI-"), F.left(F.sha2(F.concat_ws("|", "kind", "value", "source_file"), 256), F.lit(12))).alias("id"),
        F.concat(F.initcap(F.translate("kind", "_", " ")), F.lit(": "), F.col("rule")).alias("title"),
        F.concat(F.lit("Matched "), F.col("rule"), F.lit(" in "), F.col("source_file"), *shown).alias("description"),
        "severity", "platform", "source_file", F.col("kind").alias("category"), F.col("atlas").alias("mitre_atlas"),
        F.floor(F.col("confidence") * 100 + 1e-9).cast("int").alias("risk_score"), F.col("advice").alias("recommendation"),
    )


# --- detectors -----------------------------------------------------------------------------------------------------


def ioc_network(df: DataFrame, strict: bool = False, **opts) -> DataFrame:
    """Addresses, URLs, domains, e-mails."""
    return drop_benign_domains(drop_private_ips(scan(df, R.NETWORK, **opts), strict))


def ioc_hash(df: DataFrame, **opts) -> DataFrame:
    """MD5, SHA-1 and SHA-256."""
    return scan(df, R.HASHES, **opts)


def ioc_filepath(df: DataFrame, **opts) -> DataFrame:
    """Unix and drive paths (D3)."""
    return drop_short_paths(scan(df, R.PATHS, **opts))


def ioc_command(df: DataFrame, **opts) -> DataFrame:
    """Dangerous commands."""
    return scan(df, R.COMMANDS, **opts)


def ioc_exfil(df: DataFrame, **opts) -> DataFrame:
    """Exfiltration commands."""
    return scan(df, R.EXFIL, **opts)


def ioc_all(df: DataFrame, strict: bool = False, **opts) -> DataFrame:
    """D1 to D5 in one pass over the text."""
    return kept_iocs(scan(df, R.IOC_RULES, **opts), strict)


def kept_iocs(hits: DataFrame, strict: bool = False) -> DataFrame:
    """Matches of indicator rules that the address, domain and path predicates keep."""
    return drop_short_paths(drop_benign_domains(drop_private_ips(hits, strict)))


def ioc_secret(df: DataFrame, **opts) -> DataFrame:
    """Secrets as indicators of type api_key, redacted."""
    found = secret_scan(df, **opts)
    return found.select("source_file", "platform", F.lit("api_key").alias("kind"), F.col("redacted").alias("value"), F.lit("critical").alias("severity"), "rule")


def ai_jailbreak(df: DataFrame, **opts) -> DataFrame:
    """Attempts to talk a model out of its rules."""
    return scan(df, R.JAILBREAK, **opts)


def ai_tool_abuse(df: DataFrame, **opts) -> DataFrame:
    """Dangerous tool use."""
    return scan(df, R.TOOL_ABUSE, **opts)


def ai_sensitive_path(df: DataFrame, **opts) -> DataFrame:
    """Paths tools shouldn't touch."""
    return scan(df, R.SENSITIVE_PATHS, **opts)


def ai_credential(df: DataFrame, **opts) -> DataFrame:
    """Credential shapes, masked."""
    return scan(df, R.CREDENTIALS, **opts).withColumn("value", X.redact_edges(F.col("value")))


def ai_exfiltration(df: DataFrame, **opts) -> DataFrame:
    """Data on its way out."""
    return scan(df, R.EXFILTRATION, **opts)


def ai_large_body(df: DataFrame, text_col: str = "content", id_cols: tuple[str, ...] = EVIDENCE, most: int = 10_000) -> DataFrame:
    """One row per text longer than ``most`` characters."""
    n = F.length(text_col)
    return df.where(n > most).select(
        *id_cols, F.lit("large_response_dump").alias("rule"), F.lit("exfiltration").alias("kind"), F.lit("medium").alias("severity"), F.lit(0.60).alias("confidence"),
        F.concat(n.cast("string"), F.lit(" chars")).alias("value"),
    )


def secret_scan(
    df: DataFrame, text_col: str = "content", id_cols: tuple[str, ...] = EVIDENCE, rules: Iterable[Rule] = R.SECRET_RULES, salt: str = "case", field: str | None = None
) -> DataFrame:
    """Secrets by catalog, entropy gate and placeholder filter; raw values never leave.

    Columns: ids, rule, secret_type, severity, confidence, redacted, fingerprint, raw_length, entropy, detection_layer.
    """
    text, rules = F.col("_text"), list(rules)
    rows, may = candidates(df.select(*id_cols, F.col(text_col).alias("_text")), rules, "_text")
    each = [
        F.struct(
            F.lit(r.id).alias("rule"), F.lit(r.kind).alias("secret_type"), F.lit(r.severity).alias("severity"), F.lit(float(r.confidence)).alias("confidence"),
            F.lit(float(r.meta.get("entropy", 0.0))).alias("least"), F.lit("context" if r.id.startswith("named-") else "pattern").alias("detection_layer"),
            F.when(m, F.regexp_extract_all(text, F.lit(X.in_java(r.pattern)), F.lit(1))).alias("matches"),
        )
        for r, m in zip(rules, may)
    ]
    hits = rows.select(*id_cols, F.explode(F.filter(F.array(*each), lambda s: F.size(s["matches"]) > 0)).alias("r")).select("*", F.explode("r.matches").alias("v"))
    hits = hits.where(~F.col("v").rlike(R.PLACEHOLDER)).withColumn("entropy", X.entropy(F.col("v"))).where(F.col("entropy") >= F.col("r.least"))
    return hits.select(
        *id_cols, "r.rule", "r.secret_type", "r.severity", "r.confidence", X.redact_sized(F.col("v")).alias("redacted"), X.fingerprint(salt, F.col("r.rule"), F.col("v")).alias("fingerprint"),
        F.length("v").alias("raw_length"), F.round("entropy", 4).alias("entropy"), "r.detection_layer",
        *([F.lit(field).alias("evidence_field")] if field else []),
    )


def ai_model_manipulation(df: DataFrame, **opts) -> DataFrame:
    """Model and sampling settings."""
    return scan(df, R.MODEL_MANIPULATION, **opts)


def zero_width_runs(df: DataFrame, text_col: str = "content", id_cols: tuple[str, ...] = EVIDENCE, gap: int = 5, least: int = 3) -> DataFrame:
    """Runs of invisible characters with gaps of at most ``gap`` and ``least`` characters."""
    spots = X.zero_width_positions(F.col(text_col))
    start = F.struct(F.array().cast("array<struct<start:int,end:int,n:int>>").alias("runs"))

    def fold(s: Column, p: Column) -> Column:
        n = F.size(s["runs"])
        last = F.get(s["runs"], n - 1)
        joins = (n > 0) & (p - last["end"] <= gap)
        grown = F.struct(last["start"].alias("start"), p.alias("end"), (last["n"] + 1).alias("n"))
        fresh = F.struct(p.alias("start"), p.alias("end"), F.lit(1).alias("n"))
        more = F.when(joins, F.concat(F.slice(s["runs"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(s["runs"], F.array(fresh)))
        return F.struct(more.alias("runs"))

    runs = F.aggregate(spots, start, fold, lambda s: s["runs"])
    gated = df.where(F.col(text_col).rlike(f"[{X.ZERO_WIDTH}]"))
    return gated.select(*id_cols, F.explode(runs).alias("r")).where(F.col("r.n") >= least).select(*id_cols, "r.start", "r.end", F.col("r.n").alias("n"))


def ai_zero_width(df: DataFrame, **opts) -> DataFrame:
    """Invisible-character runs as jailbreak indicators."""
    found = zero_width_runs(df, **opts)
    return found.withColumns({"rule": F.lit("zero_width"), "kind": F.lit("jailbreak"), "severity": F.lit("high"), "confidence": F.lit(0.85)})


def ai_homoglyph(df: DataFrame, text_col: str = "content", id_cols: tuple[str, ...] = EVIDENCE, least: int = 3) -> DataFrame:
    """Texts with Latin look-alikes around a suspicious word."""
    t = F.col(text_col)
    gated = df.where(t.rlike(f"[{X.HOMOGLYPHS}]")).withColumn("_n", X.count_of(t, X.HOMOGLYPHS)).where(F.col("_n") >= least)
    spots = X.all_matches(t, f"[{X.HOMOGLYPHS}]")
    low = F.greatest(F.get(spots, 0)["start"] - 20, F.lit(0))
    near = F.substring(t, low + 1, F.element_at(spots, -1)["end"] + 20 - low)
    plain = F.translate(F.lower(near), X.HOMOGLYPHS, "aeopcyijhii")
    hits = gated.withColumn("_near", plain).where(F.col("_near").rlike(r"(ignore|system|prompt|admin|password|execute|bypass|instruction)"))
    return hits.select(*id_cols, F.col("_n").cast("int").alias("n"), F.lit("homoglyph").alias("rule"), F.lit("jailbreak").alias("kind"), F.lit("high").alias("severity"), F.lit(0.75).alias("confidence"))


def ai_base64_injection(df: DataFrame, text_col: str = "content", id_cols: tuple[str, ...] = EVIDENCE) -> DataFrame:
    """Base64 blocks that decode to an instruction."""
    gated = df.where(F.col(text_col).rlike(X.BASE64_BLOCK))
    rows = gated.select(*id_cols, F.explode(X.decode_base64_blocks(F.col(text_col))).alias("decoded")).where(F.col("decoded").rlike(X.in_java(R.INJECTION_WORDS)))
    return rows.select(*id_cols, F.col("decoded").alias("value"), F.lit("base64_injection").alias("rule"), F.lit("jailbreak").alias("kind"), F.lit("critical").alias("severity"), F.lit(0.90).alias("confidence"))


def turn_text(df: DataFrame) -> Column:
    """Content, tool command and tool input of a turn, as far as the columns exist."""
    return F.concat_ws("\n", *[F.col(c) for c in ("content", "tool_command", "tool_input") if c in df.columns])


def conv_patterns(df: DataFrame, id_cols: tuple[str, ...], text: Column | None = None, per: str = "label") -> DataFrame:
    """First match of each label (or category) in a turn."""
    text = turn_text(df) if text is None else text
    rows = df.withColumn("_t", text).withColumn("_low", F.lower("_t"))
    each = [F.struct(F.lit(n).alias("no"), F.lit(r.kind).alias("category"), F.lit(r.id).alias("label"), F.lit(r.severity).alias("severity"), F.lit(r.atlas[0]).alias("atlas"), screened(F.regexp_extract("_t", X.in_java(r.pattern), 0), F.col("_t"), F.col("_low"), r.pattern, r.gate).alias("value")) for n, r in enumerate(R.TURN_RULES)]
    hits = rows.select(*id_cols, F.explode(F.filter(F.array(*each), lambda s: s["value"] != "")).alias("r")).select(*id_cols, "r.*")
    if per == "label":
        return hits.drop("no")
    first = hits.groupBy(*id_cols, "category").agg(F.min_by(F.struct("label", "severity", "atlas", "value"), "no").alias("r"))
    return first.select(*id_cols, "category", "r.*")


def conv_base64(df: DataFrame, id_cols: tuple[str, ...]) -> DataFrame:
    """Base64 blocks of a turn whose decoding holds a keyword; the first keyword counts."""
    decoded = df.where(F.col("content").rlike(X.BASE64_BLOCK)).select(*id_cols, F.explode(X.decode_base64_blocks(F.col("content"), whole_groups=False)).alias("decoded"))
    words = F.filter(_strings(R.CONV_KEYWORDS), lambda k: F.lower(F.col("decoded")).contains(k))
    return decoded.withColumn("keyword", F.get(words, 0)).where("keyword is not null").select(*id_cols, "keyword", F.left("decoded", F.lit(200)).alias("value"), F.lit("high").alias("severity"), F.lit(75).alias("risk_score"))


def conv_tool_exfil(df: DataFrame, id_cols: tuple[str, ...]) -> DataFrame:
    """Tool calls that name a sensitive path (critical) or an outbound command (high); the first of each."""
    t = F.lower(F.concat_ws(" ", "tool_command", "tool_input"))

    def first(words: tuple[str, ...]) -> Column:
        return F.get(F.filter(_strings(words), lambda w: F.contains(t, w)), 0)

    pair = F.array(
        F.struct(F.lit("tool_sensitive_path").alias("rule"), first(R.TOOL_PATHS).alias("value"), F.lit("critical").alias("severity"), F.lit(95).alias("risk_score")),
        F.struct(F.lit("tool_outbound_command").alias("rule"), first(R.TOOL_COMMANDS).alias("value"), F.lit("high").alias("severity"), F.lit(80).alias("risk_score")),
    )
    return df.select(*id_cols, F.explode(F.filter(pair, lambda s: s["value"].isNotNull())).alias("r")).select(*id_cols, "r.*")


HUNT_FIELDS = ("content", "tool_command", "tool_input", "tool_description")


def secret_hunt(turns: DataFrame, id_cols: tuple[str, ...], salt: str) -> DataFrame:
    """Secrets in every text field of turns with leak direction (D21); one scan per field, no shuffle."""
    out = None
    for name in HUNT_FIELDS:
        if name in turns.columns:
            part = secret_scan(turns, name, (*id_cols, "role"), salt=salt, field=name)
            out = part if out is None else out.unionByName(part)
    return out.withColumn("leak_direction", X.leak_direction(F.col("role")))


def code_imports(files: DataFrame, path_col: str = "source_file", text_col: str = "content") -> DataFrame:
    """(path, module) of each import line (first half of D22)."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(r"(?m)^[ \t]*(?:from|import)[ \t]+([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))
    return files.select(F.col(path_col).alias("path"), F.explode(found).alias("module"))


def scan_code_imports(files: DataFrame, frameworks: DataFrame, most: int = 20) -> DataFrame:
    """AI frameworks imported, with the number of files that do and at most ``most`` of them."""
    from gumshoe.operators.lookup import classify_import

    named = classify_import(code_imports(files).distinct(), frameworks, "module", ("path", "module")).where("framework is not null")
    return linked(named, ["framework", "category"], "path", most).withColumnsRenamed({"n": "n_files", "sample": "files"})


def scan_code_secrets(files: DataFrame, salt: str = "case", most: int = 20) -> DataFrame:
    """Secrets in source files, grouped by redacted form: matches, number of files and at most ``most`` of them."""
    found = secret_scan(files, salt=salt).select("redacted", "rule", "source_file")
    held = linked(found, ["redacted", "rule"], "source_file", most).withColumnsRenamed({"n": "n_files", "sample": "files"})
    return found.groupBy("redacted", "rule").agg(F.count("*").alias("n")).join(held, ["redacted", "rule"]).withColumn("severity", F.lit("critical"))


def config_flags(df: DataFrame, text_col: str = "content", id_cols: tuple[str, ...] = EVIDENCE) -> DataFrame:
    """Tool-server registration and the first credential word of a configuration."""
    t = F.lower(text_col)
    word = F.when(t.contains("api_key"), "api_key").when(t.contains("apikey"), "apikey").when(t.contains("token"), "token").when(t.contains("secret"), "secret")
    rows = df.select(*id_cols, t.rlike(r"mcp_?servers?|\[mcp").alias("registers_tools"), word.alias("credential_word"))
    return rows.where(F.col("registers_tools") | F.col("credential_word").isNotNull()).withColumn("severity", F.when(F.col("credential_word").isNotNull(), "high").otherwise("medium"))


def gateway_log_stats(df: DataFrame, text_col: str = "content", id_cols: tuple[str, ...] = EVIDENCE, most: int = 50) -> DataFrame:
    """Errors, models, request ids, keys and loss values named in a log."""
    t = F.col(text_col)
    every = lambda p, g=0: F.regexp_extract_all(t, F.lit(X.in_java(p)), F.lit(g))
    keys = every(r"\bsk-[A-Za-z0-9_-]{20,}\b")
    return df.select(
        *id_cols,
        F.size(every(r"(?i)\b(?:error|exception|traceback|failed)\b")).alias("n_errors"),
        F.array_sort(F.array_distinct(every(r"(?i)\bmodel[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9._/-]+)", 1))).alias("models"),
        F.slice(F.array_distinct(every(r"(?i)\brequest[_-]?id[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9-]+)", 1)), 1, most).alias("request_ids"),
        F.slice(F.transform(every(r"(?i)\bloss[\"']?[ ]*[:=][ ]*([0-9.]+)", 1), lambda x: x.try_cast("double")), 1, 20).alias("losses"),
        F.size(keys).alias("n_keys"),
        F.when(F.size(keys) > 0, "high").otherwise("info").alias("severity"),
    )


def session_log_commands(df: DataFrame, text_col: str = "content", id_cols: tuple[str, ...] = EVIDENCE, most: int | None = None) -> DataFrame:
    """Command lines of a session log, sensitive ones flagged; the first ``most`` of a text for a display."""
    lines = F.filter(F.split(text_col, "\n"), lambda x: x.rlike(r"^[ \t]*(?:\$|>|#|%)[ \t]+[^ \t]"))
    rows = df.select(*id_cols, F.posexplode(lines if most is None else F.slice(lines, 1, most)).alias("seq", "line"))
    command = F.left(F.regexp_replace("line", r"^[ \t]*(?:\$|>|#|%)[ \t]+", ""), F.lit(500))
    return rows.select(*id_cols, "seq", command.alias("command"), F.lower("line").rlike("password|secret|token|credential|api_key").alias("sensitive"))


def agent_settings_flags(df: DataFrame, text_col: str = "content", id_cols: tuple[str, ...] = EVIDENCE) -> DataFrame:
    """Goals, key and password references of agent settings."""
    t = F.lower(text_col)
    goals = F.size(F.regexp_extract_all(t, F.lit(r"(?m)^[ \t]*-[ \t]+[^ \t\n]"), F.lit(0)))
    rows = df.select(*id_cols, F.when(t.contains("goals"), goals).otherwise(0).alias("n_goals"), t.rlike("api_?key").alias("names_key"), t.contains("password").alias("names_password"))
    return rows.withColumn("severity", F.when(F.col("names_key") | F.col("names_password"), "high").when(F.col("n_goals") > 0, "medium").otherwise("info"))


def env_redaction(df: DataFrame, text_col: str = "content", id_cols: tuple[str, ...] = EVIDENCE) -> DataFrame:
    """Environment files with the values of sensitive keys replaced, names kept."""
    masked = F.regexp_replace(text_col, r"(?im)^([ \t]*(?:export[ \t]+)?[A-Za-z0-9_]*(?:key|secret|token|password|credential)[A-Za-z0-9_]*[ ]*=)[^\n]*$", "$1[REDACTED]")
    return df.select(*id_cols, masked.alias("content"), (masked != F.col(text_col)).alias("had_secrets")).withColumn("severity", F.when(F.col("had_secrets"), "critical").otherwise("info"))
