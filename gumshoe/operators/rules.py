"""Rule registry: what detectors look for.

A ``Rule`` names a pattern and what a hit means.  Patterns keep to the subset
that Java, Python and RE2 share: no look-around, bounded repeats, no nested
quantifiers.  ``register_rules`` checks user rules by the same validator.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gumshoe.functions.text import in_java

MAX_PATTERN = 1000


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    pattern: str
    severity: str
    confidence: float = 1.0
    phase: str = ""
    atlas: tuple[str, ...] = ()
    attack: tuple[str, ...] = ()
    advice: str = ""
    gate: str = ""
    meta: dict = field(default_factory=dict, hash=False, compare=False)


class UnsafeRule(ValueError):
    """A rule whose pattern is empty, too long, malformed, or may backtrack without bound."""


def validate(rule: Rule) -> Rule:
    """``rule`` if its pattern compiles, is short enough, and has no quantified group that holds a quantifier."""
    if not rule.pattern or len(rule.pattern) > MAX_PATTERN:
        raise UnsafeRule(f"{rule.id}: empty or longer than {MAX_PATTERN}")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            re.compile(rule.pattern)
    except re.error as e:
        raise UnsafeRule(f"{rule.id}: {e}") from e
    if re.search(r"\((?:[^()\\]|\\.)*(?<!\\)[+*](?:[^()\\]|\\.)*\)(?:[+*]|\{\d+,\})", rule.pattern):
        raise UnsafeRule(f"{rule.id}: nested quantifier")
    return rule


#: Texts on which Python and Java must find the same: letters, digits and marks inside and outside ASCII, line ends, class operators.
PROBES = ("", "a", "abc ABC xyz", "foo_bar-9 42", "a\nb\n", "line one\nline two\n", "caf\u00e9 \u0130\u017f\u212a", "\u0661\u0662 \u4e2d\u6587", "tab\there \x0b\x0c", "a&&b [c] ^d]", "key=val; x:y, (z) {1,2}", "~!@#$%^&*()_+`|\\/<>?'\"", "aaaa bbbb", "\u00a0 \u2003")


def probes(pattern: str) -> list[str]:
    """The fixed texts, and texts made of the pattern's own words."""
    words = re.findall(r"[A-Za-z0-9]{2,}", pattern)[:40]
    joined = " ".join(words)
    return [*PROBES, pattern, joined, joined + "\n", joined.upper(), joined.lower(), "-".join(words), *(w + "\n" for w in words[:8])]


def check_in_jvm(spark: SparkSession, rule: Rule) -> Rule:
    """``rule`` if the JVM, which runs it, takes its pattern and finds what Python does in all ``probes``.

    Character classes are ASCII's in both, as they are in Java.  Patterns that only one of the two
    can read, or that they read differently, are refused.  Nothing but constants is computed, so no
    job runs.
    """
    texts = probes(rule.pattern)
    try:
        row = spark.sql("SELECT 1").select(*[F.regexp_extract_all(F.lit(t), F.lit(in_java(rule.pattern)), F.lit(0)).alias(f"c{n}") for n, t in enumerate(texts)]).first()
    except Exception as e:
        raise UnsafeRule(f"{rule.id}: Java can't read it: {str(e)[:120]}") from e
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", FutureWarning)
        compiled = re.compile(rule.pattern, re.ASCII)
    for found, text in zip(row, texts):
        if list(found) != [m[0] for m in compiled.finditer(text)]:
            raise UnsafeRule(f"{rule.id}: Java and Python read it differently")
    return rule


def register_rules(base: tuple[Rule, ...], more: list[Rule], strict: bool = False, spark: SparkSession | None = None) -> tuple[Rule, ...]:
    """``base`` and the valid ones of ``more``; a rule with a known id replaces it; bad rules are dropped, or raise if ``strict``.

    With ``spark`` patterns are checked by the JVM as well.
    """
    out = {r.id: r for r in base}
    for r in more:
        try:
            out[r.id] = validate(r) if spark is None else check_in_jvm(spark, validate(r))
        except UnsafeRule:
            if strict:
                raise
    return tuple(out.values())


# Separator of words in phrases.
S = r"[ \t\n]+"
Q = r"[\"']?"

_TLD = "com|net|org|io|dev|ai|co|app|xyz|info|biz|edu|gov|mil|me|us|uk|de|fr|ru|cn|jp"
# Gates of patterns without fixed strings: 32 characters of a hash or base64, nine digits.
_LONG = r"[A-Za-z0-9+/]{32}"
_NUMBERS = r"[0-9](?:[ -]{0,2}[0-9]){8}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"

# Network indicators, hashes, paths.
NETWORK = (
    Rule("ip", "ip", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", "medium", gate=r"[0-9]\.[0-9]", meta={"pad": 40}),
    Rule("url", "url", r"(?i)\b(?:https?|ftp)://[^ \t\r\n<>\"]*[^ \t\r\n<>\".]", "medium", meta={"pad": 30}),
    Rule("domain", "domain", rf"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+(?:{_TLD})\b", "low", gate=r"[A-Za-z0-9]\.[A-Za-z]", meta={"pad": 30}),
    Rule("email", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "low", gate=r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]", meta={"pad": 30}),
)
HASHES = (
    Rule("hash_md5", "hash_md5", r"\b[0-9a-fA-F]{32}\b", "low", gate=_LONG, meta={"pad": 30}),
    Rule("hash_sha1", "hash_sha1", r"\b[0-9a-fA-F]{40}\b", "low", gate=_LONG, meta={"pad": 30}),
    Rule("hash_sha256", "hash_sha256", r"\b[0-9a-fA-F]{64}\b", "info", gate=_LONG, meta={"pad": 30}),
)
PATHS = (
    Rule("filepath", "filepath", r"(?:/[A-Za-z0-9_.-]+){2,}|[A-Za-z]:\\(?:[^ \t\r\n\\/:*?\"<>|]+\\)*[^ \t\r\n\\/:*?\"<>|]+", "info", meta={"pad": 20}),
)


def _commands(kind: str, severity: str, table: dict[str, str]) -> tuple[Rule, ...]:
    return tuple(Rule(k, kind, p, severity, meta={"pad": 30}) for k, p in table.items())


# Dangerous shell commands.  ``dd_of``, ``pip_exec`` and ``curl_upload`` match the common spellings.
COMMANDS = _commands(
    "command",
    "high",
    {
        "rm_rf": rf"\brm{S}-rf\b",
        "wget": r"\bwget\b",
        "curl": r"\bcurl\b",
        "chmod_777": rf"\bchmod{S}777\b",
        "chmod_000": rf"\bchmod{S}000\b",
        "chown_root": rf"\bchown{S}root\b",
        "sudo_rm": rf"\bsudo{S}rm\b",
        "shutdown": r"\bshutdown\b",
        "reboot": r"\breboot\b",
        "mkfs": r"\bmkfs\b",
        "dd_of": rf"\bdd{S}[^\n]{{0,200}}of=",
        "fork_bomb": r":\(\)[ ]?\{[^\n]{0,40}:[ ]?\|[ ]?:[ ]?&",
        "netcat": rf"\bnc{S}[^\n]{{0,200}}-[el]\b",
        "reverse_shell": r"/dev/tcp/",
        "pip_exec": rf"\bpip{S}install\b[^\n]{{0,200}}--exec\b",
    },
)
# Ways out of the host.
EXFIL = _commands(
    "exfil_pattern",
    "critical",
    {
        "base64_encode": r"\bbase64\b[^\n]{0,200}\bencode\b|\bencode\b[^\n]{0,200}\bbase64\b",
        "pipe_network": r"\|[ \t\n]*(?:nc|curl|wget|ssh|scp|telnet)\b",
        "curl_upload": r"\bcurl\b[^\n]{0,200}(?:-T|--upload-file)\b",
        "scp_outbound": r"\bscp\b[^\n]{0,200}@[A-Za-z0-9_]",
        "dns_exfil": r"\bdig\b[^\n]{0,200}@[A-Za-z0-9_]|\bnslookup\b[^\n]{0,200}",
        "env_secret_dump": r"(?i)\bprintenv\b|\benv\b|\bexport\b[^\n]{0,200}\b(?:key|secret|token|password|api)\b",
    },
)
IOC_RULES = NETWORK + HASHES + PATHS + COMMANDS + EXFIL

_INJECT = ("AML.T0010",)
_LEAK = ("AML.T0050",)
_TUNE = ("AML.T0043",)
_PRIOR = "(?:previous|above|prior)"

# Attempts to talk a model out of its rules.
JAILBREAK = (
    Rule("dan_mode", "jailbreak", rf"(?i)\bDAN\b[^\n]{{0,200}}\bmode\b|do{S}anything{S}now|\bDAN[ ]*:|you{S}are{S}now{S}DAN|jailbreak|(?:bypass|disable|turn{S}off){S}(?:your{S})?safety|ignore{S}(?:all{S})?{_PRIOR}{S}(?:instructions|rules|constraints)", "critical", 0.90, "initial_access", _INJECT, ("T1190",), "Harden system prompts and refuse known override phrases."),
    Rule("roleplay_escape", "jailbreak", rf"(?i)pretend{S}you{S}are|act{S}as{S}if{S}you{S}(?:are|were)|simulate{S}(?:being|you{S}are)|roleplay{S}as|forget{S}(?:that{S}you{S}are|you're){S}(?:an?{S})?AI|you{S}are{S}no{S}longer{S}(?:an?{S})?AI|you{S}are{S}(?:now{S})?(?:an?{S})?(?:evil|unethical|malicious|uncensored|unfiltered|unrestricted)", "critical", 0.75, "initial_access", _INJECT, ("T1190",), "Watch for persona shifts across turns."),
    Rule("system_prompt_extraction", "jailbreak", rf"(?i)what{S}are{S}your{S}(?:initial|original|system|hidden){S}instructions|reveal{S}your{S}(?:system{S})?prompt|show{S}me{S}(?:your{S})?(?:system|initial){S}(?:instructions|prompt)|(?:repeat|output){S}(?:your|the){S}(?:system|initial){S}(?:prompt|instructions)|(?:forget|disregard|ignore){S}(?:your{S}|all{S})?(?:{_PRIOR}{S})?(?:instructions|directives|rules)", "critical", 0.85, "recon", ("AML.T0010", "AML.T0043"), ("T1082",), "Detect prompt leaks and test extraction."),
    Rule("prompt_injection_pasted", "jailbreak", rf"(?i)ignore{S}the{S}(?:above|following|previous){S}(?:text|content|instructions){S}and|the{S}above{S}text{S}is{S}(?:not|no)\b|\[INST\][^\n]{{0,400}}\[/INST\]|<![ ]?--[ ]?ignore|```[ ]*(?:system|instruction|prompt)|NEW{S}RULES?[ ]*:|from{S}now{S}on[,.]?{S}(?:you|your|the){S}(?:must|will|should|shall|are)", "critical", 0.80, "initial_access", _INJECT, ("T1190",), "Treat instructions in pasted content as data."),
    Rule("encoding_attack", "jailbreak", rf"(?i)decode{S}(?:this|the{S}following)[ ]*:[ ]*[A-Za-z0-9+/]{{40,}}|base64{S}decode|execute{S}(?:this{S})?(?:base64|b64|encoded)", "critical", 0.70, "execution", _INJECT, ("T1059.001", "T1059.004"), "Decode and inspect payloads before use."),
    Rule("multi_turn_escalation", "jailbreak", rf"(?i)now{S}that{S}you(?:'ve|{S}have){S}(?:started|agreed|shown)|continue{S}(?:from{S})?(?:where{S}we{S})?left{S}off|since{S}you{S}already{S}(?:told|showed|gave)|one{S}more{S}(?:thing|step|request)|can{S}you{S}(?:also|additionally|now){S}(?:do|tell|show|give|provide)|I{S}know{S}you{S}(?:can't|shouldn't|won't){S}but", "critical", 0.55, "initial_access", _INJECT, ("T1190",), "Score risk by turn."),
)
# What tools are made to do.
TOOL_ABUSE = (
    Rule("dangerous_deletion", "tool_abuse", rf"(?i)\brm{S}-rf{S}(?:/(?:etc|home|var|root|usr)\b|~)", "critical", 0.95, "impact", (), ("T1059.004",), "Check for data loss."),
    Rule("privilege_escalation", "tool_abuse", rf"(?i)\bsudo{S}(?:(?:rm|chmod|chown|cat|tee|bash|sh|python|perl|su)\b|-i\b)", "high", 0.90, "execution", (), ("T1059.004",), "Audit sudo use."),
    Rule("permission_modification", "tool_abuse", rf"(?i)\bchmod{S}(?:777|666|000)\b|\bchown{S}[A-Za-z0-9_]+{S}/", "high", 0.85, "persistence", (), ("T1059.004",), "Restore permissions."),
    Rule("network_exfil_tool", "tool_abuse", rf"(?i)\bcurl{S}[^\n]{{0,200}}(?:--data|-d|-T|--upload-file)\b|\bwget{S}[^\n]{{0,200}}--post-file\b|\bscp{S}[^ \t\n]{{1,100}}@[^ \t\n]{{1,100}}:|\bsftp{S}[^\n]{{0,200}}@[ ]|\bssh{S}-[NRD]\b|\b(?:nc|ncat){S}[^\n]{{0,200}}-[el]\b|\bsocat{S}[^\n]{{0,200}}(?:TCP|EXEC|SYSTEM)", "critical", 0.90, "exfiltration", _LEAK, ("T1048", "T1567"), "Block outbound transfers."),
    Rule("env_dump", "tool_abuse", rf"(?i)\bprintenv\b|\benv\b|\bexport{S}[A-Za-z0-9_]*(?:KEY|SECRET|TOKEN|PASSWORD|API|CREDENTIAL)[A-Za-z0-9_]*[ ]*=", "high", 0.85, "exfiltration", (), ("T1082",), "Keep secrets out of the environment."),
    Rule("pip_dangerous", "tool_abuse", rf"(?i)\bpip{S}install\b[^\n]{{0,200}}(?:--exec|--user|--target{S}/(?:etc|root))", "high", 0.80, "execution", (), ("T1059.004",), "Use virtual environments."),
    Rule("database_access", "tool_abuse", rf"(?i)(?:mysql|psql|pg|sqlite3|mongosh){S}[^\n]{{0,200}}(?:-p\b|password|secret)|(?:postgres|mysql|mongodb)://[^ \t\n:]{{1,100}}:[^ \t\n@]{{1,100}}@|connection_string[ ]*=[ ]*[\"'][^\n]{{0,200}}(?:password|pwd)[ ]*=", "critical", 0.90, "exfiltration", (), ("T1078", "T1530"), "Rotate database credentials."),
)
_HOME = "(?:~|/home/[A-Za-z0-9_]+)"
# Paths that tools have no business with.
SENSITIVE_PATHS = (
    Rule("sensitive_credential_file", "tool_abuse", r"(?i)/etc/shadow", "high", 0.95, "execution", (), ("T1005",)),
    Rule("sensitive_system_file", "tool_abuse", r"(?i)/etc/passwd", "high", 0.85, "recon", (), ("T1082",)),
    Rule("sensitive_crypto_dir", "tool_abuse", rf"(?i){_HOME}/\.(?:ssh|gnupg)", "high", 0.95, "execution", (), ("T1005",)),
    Rule("sensitive_config_dir", "tool_abuse", rf"(?i){_HOME}/\.(?:aws|azure|gcloud|config|env|netrc|gitconfig)", "high", 0.90, "recon", (), ("T1082",)),
    Rule("sensitive_ssh_key", "tool_abuse", rf"(?i){_HOME}/\.ssh/(?:id_rsa|id_ed25519|config|authorized_keys)", "high", 0.95, "execution", (), ("T1005",)),
    Rule("sensitive_network_config", "tool_abuse", r"(?i)/etc/(?:hosts\.allow|hosts\.deny|ssh/sshd_config)", "high", 0.80, "recon", (), ("T1082",)),
    Rule("sensitive_auth_file", "tool_abuse", r"(?i)(?:/etc|/var)/(?:shadow|passwd|group)", "high", 0.85, "execution", (), ("T1005",)),
)


def _keys(*rows: tuple[str, str, str, float]) -> tuple[Rule, ...]:
    return tuple(Rule(i, "credential", p, sev, conf, "exfiltration", _LEAK if "key" in i or "token" in i else (), ("T1078",), "Revoke and rotate.") for i, p, sev, conf in rows)


# Credential shapes.
CREDENTIALS = _keys(
    ("openai_api_key", r"\bsk-[A-Za-z0-9_-]{20,}\b", "critical", 0.95),
    ("anthropic_api_key", r"\banthropic_[A-Za-z0-9_-]{20,}\b", "critical", 0.95),
    ("github_token", r"\bgh[pous]_[A-Za-z0-9]{36,}\b|\bgithub_pat_[A-Za-z0-9_]{20,}\b", "critical", 0.95),
    ("xai_api_key", r"\bxai-[A-Za-z0-9_-]{20,}\b", "critical", 0.95),
    ("google_ai_key", r"\bAIza[A-Za-z0-9_-]{30,}\b", "critical", 0.95),
    ("aws_access_key", r"\bAKIA[A-Z0-9]{16}\b", "critical", 0.95),
    ("azure_key", rf"(?i)\b(?:azure|tenant|subscription|client[_-]?secret)[_-]?(?:key|id|secret)[ ]*[:=][ ]*{Q}[A-Za-z0-9_.-]{{20,}}", "critical", 0.90),
    ("oauth_token", rf"(?i)\b(?:access_token|refresh_token|bearer)[ ]*[:=][ ]*{Q}[A-Za-z0-9._~+/-]{{40,}}", "high", 0.85),
    ("private_pem", rf"-----BEGIN{S}(?:RSA{S})?PRIVATE{S}KEY-----", "critical", 0.95),
    ("private_openssh", rf"-----BEGIN{S}OPENSSH{S}PRIVATE{S}KEY-----", "critical", 0.95),
    ("private_pgp", rf"-----BEGIN{S}PGP{S}PRIVATE{S}KEY{S}BLOCK-----", "critical", 0.95),
    ("credential_in_cli", rf"(?i)--(?:password|secret|token|api-?key|credential){S}[^ \t\n]{{1,200}}|-p{S}[^ \t\n-][^ \t\n]{{1,200}}|\b(?:password|secret)[ ]*[:=][ ]*{Q}[^ \t\n\"']{{6,200}}", "high", 0.80),
    ("generic_api_key", r"\bkey-[A-Za-z0-9_-]{10,}\b", "high", 0.70),
)
# Data on its way out.
EXFILTRATION = (
    Rule("base64_smuggling", "exfiltration", r"[A-Za-z0-9+/]{100,}={0,2}(?:[ \t\n]|$)", "high", 0.75, "exfiltration", _LEAK, ("T1048",), gate=_LONG),
    Rule("url_in_response", "exfiltration", r"(?i)\bhttps?://(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/[^ \t\n]{10,200})?\.(?:exe|ps1|sh|bat|dll|py|rb|bin)\b", "high", 0.70, "exfiltration", (), ("T1567", "T1190")),
    Rule("piped_network_command", "exfiltration", rf"(?i)\|[ \t\n]*(?:nc|ncat|curl|wget|ssh|telnet|socat|nslookup|dig)\b|(?:cat|head|tail){S}[^ \t\n]{{1,200}}[ \t]*\|[ \t]*(?:curl|wget|nc|ssh)\b", "critical", 0.90, "exfiltration", _LEAK, ("T1048",)),
    Rule("clipboard_access", "exfiltration", r"(?i)\b(?:pbcopy|pbpaste|xclip|xsel|clip|Get-Clipboard|Set-Clipboard)\b|\bclipboard\b[^\n]{0,200}\b(?:read|write|copy|paste)\b", "medium", 0.55, "exfiltration", (), ("T1530",)),
    Rule("credit_card_in_response", "exfiltration", r"\b[0-9](?:[ -]{0,2}[0-9]){12,15}\b", "critical", 0.70, "exfiltration", _LEAK, ("T1530",), gate=_NUMBERS),
    Rule("ssn_in_response", "exfiltration", r"\b[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4}\b", "critical", 0.60, "exfiltration", _LEAK, ("T1530",), gate=_NUMBERS),
    Rule("dns_exfil", "exfiltration", rf"(?i)\b(?:dig|nslookup|host){S}[^\n]{{0,200}}[|>]|\bdig{S}[^ \t\n]{{1,100}}@[^ \t\n]{{1,100}}", "high", 0.85, "exfiltration", (), ("T1048",)),
)
_MODELS = "(?:gpt-4|claude-3|claude-opus|o1|o3|gemini|deepseek-r1)"
_K = r'\\?"?'
# Settings that change what a model does.
MODEL_MANIPULATION = (
    Rule("model_switch", "model_manipulation", rf"(?i)(?:switch|change|use){S}(?:to{S})?(?:model|engine|llm)[ ]*[:=]?[ ]*{_MODELS}|{_K}model{_K}[ ]*[:=][ ]*{_K}{_MODELS}|\b(?:openai|anthropic|google){S}model[ ]*[:=]", "high", 0.70, "initial_access", _TUNE, ("T1190",)),
    Rule("temperature_manipulation", "model_manipulation", rf"(?i){_K}temp(?:erature)?{_K}[ ]*[:=][ ]*{_K}[ ]*(?:[2-9]|[0-9]\.[0-9])|{_K}top_p{_K}[ ]*[:=][ ]*{_K}[ ]*0[.,]0?[0-9]?\b", "high", 0.80, "execution", _TUNE, ("T1190",)),
    Rule("system_prompt_modification", "model_manipulation", rf"(?i){_K}system{_K}[ ]*[:=][ ]*{_K}[^\n]{{0,200}}(?:ignore|override|bypass|disable|jailbreak|\bDAN\b)|(?:new|modified|updated){S}system{S}(?:prompt|message|instruction)[ ]*[:=]", "high", 0.85, "execution", ("AML.T0010", "AML.T0043"), ("T1190",)),
    Rule("finetuning_artifact", "model_manipulation", rf"(?i)(?:fine[- ]?tun|adapter|lora)[A-Za-z0-9_]*[ ]*(?:model|checkpoint|weights?|file|path)[ ]*[:=]|\.safetensors\b|\badapter_config\.json\b|\bq?lora{S}(?:rank|alpha|dropout)[ ]*[:=]", "high", 0.65, "persistence", _TUNE, ("T1190",)),
)
AI_RULES = JAILBREAK + TOOL_ABUSE + SENSITIVE_PATHS + CREDENTIALS + EXFILTRATION + MODEL_MANIPULATION

_OWN = "(?:your|the|my|system|initial|original|secret|hidden)"
_LAWS = "(?:instructions?|prompts?|directives?|rules?|guidelines?|constraints?)"
_HARM = "(?:/etc/passwd|/etc/shadow|/etc/hosts|\\.ssh/id_rsa|\\.ssh/authorized_keys|\\.aws/credentials|\\.git/config)"


def _turns(category: str, severity: str, atlas: str, table: dict[str, str]) -> tuple[Rule, ...]:
    return tuple(Rule(label, category, "(?i)" + p, severity, atlas=(atlas,)) for label, p in table.items())


# What conversation turns are searched for; the first match of each label counts.
# Categories, severities, techniques and patterns; labels are our own.
TURN_RULES = (
    *_turns("system_prompt_extraction", "high", "AML.T0040", {
        "asks to see the instructions": rf"(?:reveal|show|display|print|output|repeat|recite|write{S}out){S}{_OWN}[ ]*{_LAWS}",
        "asks what the prompt is": rf"what{S}(?:are|is){S}(?:your|the|my){S}(?:system|initial|original|secret|hidden|base)[ ]*(?:prompt|instruction|directive|rule)",
        "sets earlier instructions aside": rf"ignore{S}(?:all{S})?(?:previous|prior|above|earlier|past)[ ]*{_LAWS}",
        "names the taking of a prompt": r"(?:system|initial|base|secret)[ ]*prompt[ ]*(?:extraction|leak|dump|read|reveal|output)",
        "asks to drop the instructions": rf"(?:pretend|act{S}as|forget|disregard){S}(?:your|the|all)[ ]*(?:previous|prior|above|normal|original)[ ]*{_LAWS}",
    }),
    *_turns("jailbreak", "critical", "AML.T0011", {
        "do-anything persona": rf"do{S}anything{S}now|DAN[ ]*mode|you{S}are{S}now{S}DAN|(?:enable|become|act{S}as){S}DAN|DAN{S}jailbreak",
        "persona without limits": rf"you{S}are{S}now{S}(?:an?{S})?unrestricted|you{S}have{S}no{S}(?:rules|restrictions|limitations|filters?)|bypass{S}(?:your|the|all){S}(?:safety|filter|restrictions?|rules?)",
        "encoded request": rf"base64[ ]*(?:decode|encode|string)|rot13|hex[ ]*(?:decode|encode)|decode{S}(?:this|the){S}(?:base64|hex|encoded)",
        "encoded text to be run": r"[A-Za-z0-9+/]{40,}={0,2}[ ]*(?:decode|execute|run|interpret)[ ]",
        "claims an operator mode": rf"(?:developer|debug|admin|god|root|sudo)[ ]*mode|override{S}(?:safety|security|filter|restrictions?|policy)",
        "wrapped in a supposition": rf"in{S}a{S}hypothetical{S}(?:scenario|world|situation|universe)|hypothetically(?:{S}speaking)?,?[ ]*(?:what|how|if|could|would)|imagine{S}an?{S}(?:world|scenario|situation){S}where{S}there{S}are{S}no{S}(?:rules|restrictions|safety)",
    }),
    *_turns("data_exfiltration", "critical", "AML.T0050", {
        "asks for a protected file": rf"(?:read|cat|type|display|show|print|dump|exfiltrate){S}(?:the{S})?files?[ ]*(?:at|from|in|containing)[ ]*(?:/etc/passwd|/etc/shadow|/etc/hosts|\.ssh|\.env|\.git|id_rsa|authorized_keys|credentials|secrets?|config)",
        "names a protected path": rf"{_HARM}|\.env\b",
        "asks for the environment": rf"(?:print|echo|show|display|output|list|dump|exfiltrate)[ ]*(?:the{S})?(?:environment|env)[ ]*(?:variables?|vars?)",
        "sends something to an address": r"(?:send|transmit|upload|post|curl|wget|fetch|webhook|exfil)[^\n]{0,200}(?:to|toward|at|via)[ ]*https?://",
        "tool reads a protected path": rf"(?:read_file|cat|type)[ ]*[(\"]?[ ]*(?:{_HARM}|\.env|\.bashrc|\.zshrc|/root/)",
        "tool lists the environment": r"printenv|env|export|getenv",
    }),
    *_turns("privilege_escalation", "high", "AML.T0049", {
        "asks for root rights": rf"sudo{S}|run{S}as{S}root|execute{S}as{S}(?:root|admin|system)|escalate{S}privilege|privilege{S}escalation|(?:become|switch{S}to){S}root",
        "switches a safeguard off": rf"(?:disable|turn{S}off|bypass|remove|deactivate|skip)[ ]*(?:the{S})?(?:safety|security|guard|filter|restriction|content[ ]*policy|moderation)",
        "goes round a safeguard": rf"(?:bypass|circumvent|evade|work{S}around|get{S}around|sidestep|subvert)[ ]*(?:the{S})?(?:restrictions?|safeguards?|filters?|polic(?:y|ies)|guards?|guardrails?|limits?|boundaries|boundary)",
        "destructive command": rf"rm{S}-rf{S}/|format{S}[A-Z]:|del{S}/[sfq]|:\(\)[ ]?\{{[ ]?:|fork[ ]*bomb|chmod{S}777|chown{S}root",
    }),
    *_turns("credential_harvesting", "critical", "AML.T0055", {
        "asks for an API key": rf"(?:give{S}me|show|reveal|tell{S}me|what{S}is|what's{S}the|output|print)[ ]*(?:the{S}|your{S}|my{S})?(?:api|access)[ ]*(?:key|token)",
        "asks for a password": rf"(?:give{S}me|show|reveal|tell{S}me|what{S}is|what's{S}the|output|print)[ ]*(?:the{S}|your{S}|my{S})?(?:password|passwd|pass|secret)",
        "takes tokens or secrets": rf"(?:extract|dump|exfiltrate|steal|harvest|collect)[ ]*(?:the{S})?(?:tokens?|secrets?|credentials?|keys?|certificates?)",
        "names cloud credentials": rf"aws_(?:access|secret)_key|aws_session_token|azure_client_secret|gcp_service_account|service_account\.json|\.aws/credentials|export{S}(?:AWS|AZURE|GCP|GOOGLE)_",
        "names a private key": rf"-----BEGIN{S}(?:RSA{S})?PRIVATE{S}KEY|ssh-rsa{S}AAAA|(?:extract|show)[^\n]{{0,200}}private{S}key",
    }),
    *_turns("indirect_injection", "high", "AML.T0045", {
        "builds on earlier turns": rf"now{S}that{S}you{S}have|since{S}we(?:'ve|{S}have){S}established|building{S}on{S}(?:our|the|that)|continue{S}from{S}(?:where|the{S}previous)|as{S}(?:we{S})?discussed",
        "pasted text gives orders": rf"ignore{S}(?:the{S})?(?:above|previous|prior|earlier)[ ]*(?:text|content|instructions?|prompt)|the{S}(?:above|following|text|content){S}(?:contains?|has|includes?)[ ]*(?:new|updated|real|actual)[ ]*(?:instructions?|rules?|directives?)",
        "data poses as an instruction": r"\bsystem[ ]*:|<system>|\[system\]|\[/?INST\]|<[ ]?![ ]?--[ ]?(?:ignore|system|instruction|prompt|rule)",
    }),
)


def _secret(i: str, what: str, pattern: str, severity: str = "critical", confidence: float = 0.9, least_entropy: float = 0.0) -> Rule:
    return Rule(i, what, pattern, severity, confidence, meta={"entropy": least_entropy})


_NAMED = r"[ ]*[:=][ ]*[\"']?"
# Our own secret catalog, from public token formats; group 1 is the secret where there is one.
SECRET_RULES = (
    _secret("openai-key", "api_key", r"\b(sk-(?:proj-)?[A-Za-z0-9_-]{20,200})\b", least_entropy=3.0),
    _secret("anthropic-key", "api_key", r"\b(sk-ant-[A-Za-z0-9_-]{20,200})\b", least_entropy=3.0),
    _secret("xai-key", "api_key", r"\b(xai-[A-Za-z0-9_-]{20,200})\b", least_entropy=3.0),
    _secret("google-key", "api_key", r"\b(AIza[A-Za-z0-9_-]{35})\b", least_entropy=3.0),
    _secret("groq-key", "api_key", r"\b(gsk_[A-Za-z0-9]{40,60})\b", least_entropy=3.0),
    _secret("huggingface-token", "token", r"\b(hf_[A-Za-z0-9]{30,40})\b", least_entropy=3.0),
    _secret("replicate-token", "token", r"\b(r8_[A-Za-z0-9]{37})\b", least_entropy=3.0),
    _secret("perplexity-key", "api_key", r"\b(pplx-[A-Za-z0-9]{40,60})\b", least_entropy=3.0),
    _secret("aws-access-key", "access_key", r"\b((?:AKIA|ASIA)[A-Z0-9]{16})\b"),
    _secret("aws-secret-key", "secret_key", rf"(?i)aws_?secret_?(?:access_?)?key{_NAMED}([A-Za-z0-9/+=]{{40}})", least_entropy=3.5),
    _secret("azure-storage-key", "secret_key", r"AccountKey=([A-Za-z0-9+/]{86}==)"),
    _secret("gcp-service-account", "private_key", r"\"private_key_id\"[ ]*:[ ]*\"([0-9a-f]{40})\""),
    _secret("github-token", "token", r"\b(gh[pousr]_[A-Za-z0-9]{36,255})\b"),
    _secret("github-fine-token", "token", r"\b(github_pat_[A-Za-z0-9_]{22,255})\b"),
    _secret("gitlab-token", "token", r"\b(glpat-[A-Za-z0-9_-]{20,64})\b"),
    _secret("npm-token", "token", r"\b(npm_[A-Za-z0-9]{36})\b"),
    _secret("pypi-token", "token", r"\b(pypi-[A-Za-z0-9_-]{50,250})\b"),
    _secret("dockerhub-token", "token", r"\b(dckr_pat_[A-Za-z0-9_-]{20,64})\b"),
    _secret("slack-token", "token", r"\b(xox[abpors]-[A-Za-z0-9-]{10,250})\b"),
    _secret("slack-webhook", "webhook", r"(https://hooks\.slack\.com/services/[A-Za-z0-9/]{20,100})", "high"),
    _secret("discord-webhook", "webhook", r"(https://discord(?:app)?\.com/api/webhooks/[0-9]{10,20}/[A-Za-z0-9_-]{20,100})", "high"),
    _secret("telegram-bot-token", "token", r"\b([0-9]{8,10}:AA[A-Za-z0-9_-]{33})\b", "high"),
    _secret("stripe-key", "api_key", r"\b([rs]k_(?:live|test)_[A-Za-z0-9]{20,100})\b"),
    _secret("sendgrid-key", "api_key", r"\b(SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43})\b"),
    _secret("twilio-key", "api_key", r"\b(SK[0-9a-f]{32})\b", "high"),
    _secret("mailgun-key", "api_key", r"\b(key-[0-9a-f]{32})\b", "high"),
    _secret("shopify-token", "token", r"\b(shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32})\b"),
    _secret("digitalocean-token", "token", r"\b(do[opr]_v1_[0-9a-f]{64})\b"),
    _secret("databricks-token", "token", r"\b(dapi[0-9a-f]{32})\b"),
    _secret("linear-key", "api_key", r"\b(lin_api_[A-Za-z0-9]{40})\b", "high"),
    _secret("notion-token", "token", r"\b(ntn_[A-Za-z0-9]{40,60})\b", "high"),
    _secret("json-web-token", "token", r"\b(eyJ[A-Za-z0-9_-]{10,500}\.eyJ[A-Za-z0-9_-]{10,800}\.[A-Za-z0-9_-]{10,500})", "high", 0.8),
    _secret("private-key-block", "private_key", rf"(-----BEGIN{S}(?:RSA{S}|EC{S}|DSA{S}|OPENSSH{S})?PRIVATE{S}KEY-----)"),
    _secret("pgp-private-key", "private_key", rf"(-----BEGIN{S}PGP{S}PRIVATE{S}KEY{S}BLOCK-----)"),
    _secret("database-url", "connection_string", r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^ \t\n:@/]{1,64}:([^ \t\n@/]{4,100})@", "high", 0.85),
    _secret("basic-auth-url", "connection_string", r"(?i)\bhttps?://[^ \t\n:@/]{1,64}:([^ \t\n@/]{4,100})@", "high", 0.7),
    _secret("bearer-header", "token", r"(?i)authorization[\"']?[ ]*[:=][ ]*[\"']?bearer[ ]+([A-Za-z0-9._~+/-]{20,500})", "high", 0.85, 3.0),
    _secret("named-api-key", "api_key", rf"(?i)\b(?:api_?key|apikey|access_?key){_NAMED}([A-Za-z0-9_-]{{16,128}})", "high", 0.75, 3.0),
    _secret("named-token", "token", rf"(?i)\b(?:auth_?token|access_?token|token){_NAMED}([A-Za-z0-9._-]{{16,256}})", "high", 0.7, 3.0),
    _secret("named-password", "password", rf"(?i)\b(?:password|passwd|pwd){_NAMED}([^ \t\n\"',;]{{8,128}})", "high", 0.65, 2.5),
    _secret("named-secret", "secret", rf"(?i)\b(?:client_?secret|secret_?key|secret){_NAMED}([A-Za-z0-9_./+-]{{12,128}})", "high", 0.7, 3.0),
)
# Values that are placeholders, not secrets.
PLACEHOLDER = r"(?i)(example|placeholder|changeme|your[_-]|dummy|xxxx|\*\*\*|\$\{|<[a-z_ ]+>|redacted|0123456789|abcdefgh)"

# Words that betray an encoded instruction.
INJECTION_WORDS = r"(?i)(ignore|override|bypass|disable|jailbreak|\bDAN\b|system prompt|instructions)"
CONV_KEYWORDS = ("system", "prompt", "instruction", "ignore", "bypass", "password", "secret", "token", "api_key", "execute", "eval", "curl", "wget", "/etc/", "admin")
TOOL_PATHS = ("/etc/passwd", "/etc/shadow", "/etc/hosts", ".ssh/id_rsa", ".ssh/authorized_keys", ".aws/credentials", ".env", ".git/config", ".bashrc", ".zshrc", "/root/")
TOOL_COMMANDS = ("curl ", "wget ", "nc ", "scp ", "rsync ", "base64 ", "printenv", "rm -rf")


def with_pattern(rule: Rule, pattern: str) -> Rule:
    return replace(rule, pattern=pattern)
