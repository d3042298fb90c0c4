"""Catalog lookups.  Prefix and suffix matches become equi-joins on exploded prefixes or suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gumshoe.functions import text as X
from gumshoe.operators.dedup import first_rule_wins
from gumshoe.operators.links import linked
from gumshoe.operators.scans import running_totals

# Hosts of model services, in catalog order (suffix, provider, category).  A suffix covers its
# subdomains, so "api." hosts stand here only where their parent doesn't.
DOMAINS = (
    ("openai.com", "OpenAI", "inference"), ("anthropic.com", "Anthropic", "inference"), ("deepseek.com", "DeepSeek", "inference"), ("mistral.ai", "Mistral", "inference"),
    ("groq.com", "Groq", "inference"), ("cohere.com", "Cohere", "inference"), ("together.xyz", "Together AI", "inference"), ("replicate.com", "Replicate", "inference"),
    ("stability.ai", "Stability AI", "image"), ("eleuther.ai", "EleutherAI", "inference"), ("fireworks.ai", "Fireworks AI", "inference"), ("perplexity.ai", "Perplexity", "search"),
    ("x.ai", "xAI", "inference"), ("grok.x", "xAI Grok", "inference"), ("api.llama.ai", "Meta Llama", "inference"), ("llama.com", "Meta Llama", "inference"),
    ("api.gemini.google.com", "Google Gemini", "inference"), ("generativelanguage.googleapis.com", "Google Gemini", "inference"), ("aiplatform.googleapis.com", "Google Vertex AI", "inference"),
    ("vertexai.googleapis.com", "Google Vertex AI", "inference"), ("api.azure.com", "Azure OpenAI", "inference"), ("openai.azure.com", "Azure OpenAI", "inference"),
    ("bedrock-runtime.amazonaws.com", "AWS Bedrock", "inference"), ("bedrock.amazonaws.com", "AWS Bedrock", "inference"), ("api.aws.amazon.com", "AWS AI", "inference"),
    ("inference.ai.azure.com", "Azure AI", "inference"), ("api.databricks.com", "Databricks", "inference"), ("watsonx.ai", "IBM watsonx", "inference"), ("api.nvidia.com", "NVIDIA NIM", "inference"),
    ("integrate.api.nvidia.com", "NVIDIA NIM", "inference"), ("api.ibm.com", "IBM AI", "inference"), ("sambanova.ai", "SambaNova", "inference"), ("cerebras.ai", "Cerebras", "inference"),
    ("scale.com", "Scale AI", "inference"), ("anyscale.com", "Anyscale", "inference"), ("baseten.co", "Baseten", "inference"), ("runpod.ai", "RunPod", "inference"), ("modal.com", "Modal", "inference"),
    ("lambdalabs.com", "Lambda", "inference"), ("predibase.com", "Predibase", "inference"), ("octoai.cloud", "OctoAI", "inference"), ("deepinfra.com", "DeepInfra", "inference"),
    ("lemonfox.ai", "Lemonfox", "inference"), ("portkey.ai", "Portkey", "inference"), ("helicone.ai", "Helicone", "inference"), ("langfuse.com", "Langfuse", "inference"),
    ("langsmith.com", "LangSmith", "inference"), ("wandb.ai", "Weights & Biases", "inference"), ("huggingface.co", "HuggingFace", "inference"), ("api.ollama.com", "Ollama Cloud", "inference"),
    ("ollama.com", "Ollama", "inference"), ("lmstudio.ai", "LM Studio", "inference"), ("gpt4all.io", "GPT4All", "inference"), ("unsloth.ai", "Unsloth", "inference"), ("vllm.ai", "vLLM", "inference"),
    ("litellm.ai", "LiteLLM", "inference"), ("bifrost.ai", "Bifrost", "inference"), ("jan.ai", "Jan", "inference"), ("anythingllm.com", "AnythingLLM", "inference"), ("localai.io", "LocalAI", "inference"),
    ("koboldai.net", "KoboldAI", "inference"), ("llamacpp.ai", "llama.cpp", "inference"), ("api.text-gen.com", "text-generation-webui", "inference"), ("voyageai.com", "Voyage AI", "embedding"),
    ("jina.ai", "Jina AI", "embedding"), ("mixedbread.ai", "MixedBread", "embedding"), ("midjourney.com", "Midjourney", "image"), ("runwayml.com", "Runway", "video"), ("elevenlabs.io", "ElevenLabs", "audio"),
    ("assemblyai.com", "AssemblyAI", "audio"), ("deepgram.com", "Deepgram", "audio"), ("api.whisper.ai", "Whisper", "audio"), ("suno.ai", "Suno", "audio"), ("udio.com", "Udio", "audio"),
    ("ideogram.ai", "Ideogram", "image"), ("leonardo.ai", "Leonardo AI", "image"), ("fliki.ai", "Fliki", "video"), ("api.githubcopilot.com", "GitHub Copilot", "code"),
    ("copilot-proxy.githubusercontent.com", "GitHub Copilot", "code"), ("cursor.sh", "Cursor", "code"), ("aider.chat", "Aider", "code"), ("windsurf.com", "Windsurf", "code"), ("codeium.com", "Codeium", "code"),
    ("tabby.sh", "Tabby", "code"), ("continue.dev", "Continue", "code"), ("cline.bot", "Cline", "code"), ("roocode.com", "Roo Code", "code"), ("kilocode.com", "Kilo Code", "code"), ("devin.ai", "Devin", "code"),
    ("antigravity.google", "Antigravity", "code"), ("eigent.ai", "Eigent", "code"), ("openclaw.ai", "OpenClaw", "agent"), ("clawdbot.ai", "Clawdbot", "agent"), ("moltbot.ai", "Moltbot", "agent"),
    ("nanoclaw.ai", "NanoClaw", "agent"), ("openhands.ai", "OpenHands", "agent"), ("autogpt.ai", "AutoGPT", "agent"), ("crewai.com", "CrewAI", "agent"), ("langchain.com", "LangChain", "agent"),
    ("langgraph.com", "LangGraph", "agent"), ("autogen.ai", "AutoGen", "agent"), ("openinterpreter.com", "Open Interpreter", "agent"), ("goose.ai", "Goose", "agent"), ("sweagent.com", "SWE-agent", "agent"),
    ("gptengineer.com", "GPT Engineer", "agent"), ("devika.ai", "Devika", "agent"), ("replit.com", "Replit", "code"), ("v0.dev", "Vercel v0", "code"), ("bolt.new", "Bolt.new", "code"), ("lovable.dev", "Lovable", "code"),
    ("blackbox.ai", "Blackbox AI", "code"), ("fitten.ai", "Fitten Code", "code"), ("amazonq.dev", "Amazon Q", "code"), ("warp.dev", "Warp", "code"), ("shellgpt.ai", "Shell-GPT", "code"), ("mcp.ai", "MCP", "agent"),
    ("modelcontextprotocol.io", "MCP", "agent"),
)
# Import prefixes of model libraries, in catalog order (prefix, framework, category).
FRAMEWORKS = (
    ("langchain", "LangChain", "agent"), ("langchain_core", "LangChain Core", "agent"), ("langchain_community", "LangChain Community", "agent"), ("langgraph", "LangGraph", "agent"), ("langsmith", "LangSmith", "inference"),
    ("llama_index", "LlamaIndex", "agent"), ("llamaindex", "LlamaIndex", "agent"), ("crewai", "CrewAI", "agent"), ("autogen", "AutoGen", "agent"), ("autogen_agentchat", "AutoGen AgentChat", "agent"),
    ("openai", "OpenAI SDK", "inference"), ("anthropic", "Anthropic SDK", "inference"), ("mistralai", "Mistral SDK", "inference"), ("cohere", "Cohere SDK", "inference"), ("together", "Together SDK", "inference"),
    ("replicate", "Replicate SDK", "inference"), ("groq", "Groq SDK", "inference"), ("deepseek", "DeepSeek SDK", "inference"), ("google.generativeai", "Google Gemini SDK", "inference"), ("vertexai", "Google Vertex AI SDK", "inference"),
    ("boto3", "AWS SDK (Bedrock)", "inference"), ("azure.ai", "Azure AI SDK", "inference"), ("openai_whisper", "Whisper", "audio"), ("whisper", "Whisper", "audio"), ("transformers", "HuggingFace Transformers", "inference"),
    ("torch", "PyTorch", "inference"), ("tensorflow", "TensorFlow", "inference"), ("keras", "Keras", "inference"), ("unsloth", "Unsloth", "inference"), ("vllm", "vLLM", "inference"), ("litellm", "LiteLLM", "inference"),
    ("bifrost", "Bifrost", "inference"), ("ollama", "Ollama", "inference"), ("llama_cpp", "llama.cpp", "inference"), ("llamacpp", "llama.cpp", "inference"), ("gpt4all", "GPT4All", "inference"),
    ("text_generation", "text-generation-webui", "inference"), ("koboldcpp", "KoboldCpp", "inference"), ("localai", "LocalAI", "inference"), ("jan", "Jan", "inference"), ("anythingllm", "AnythingLLM", "inference"),
    ("haystack", "Haystack", "agent"), ("dspy", "DSPy", "agent"), ("semantic_kernel", "Semantic Kernel", "agent"), ("instructor", "Instructor", "agent"), ("guidance", "Guidance", "agent"), ("outlines", "Outlines", "agent"),
    ("pydantic_ai", "Pydantic AI", "agent"), ("smolagents", "SmolAgents", "agent"), ("openinterpreter", "Open Interpreter", "agent"), ("interpreter", "Open Interpreter", "agent"), ("openhands", "OpenHands", "agent"),
    ("autogpt", "AutoGPT", "agent"), ("sweagent", "SWE-agent", "agent"), ("gpt_engineer", "GPT Engineer", "agent"), ("devika", "Devika", "agent"), ("goose", "Goose", "agent"), ("openclaw", "OpenClaw", "agent"),
    ("clawdbot", "Clawdbot", "agent"), ("moltbot", "Moltbot", "agent"), ("nanoclaw", "NanoClaw", "agent"), ("aider", "Aider", "code"), ("codex", "Codex", "code"), ("claude", "Claude Code", "code"), ("cursor", "Cursor", "code"),
    ("windsurf", "Windsurf", "code"), ("codeium", "Codeium", "code"), ("tabby", "Tabby", "code"), ("continue", "Continue", "code"), ("cline", "Cline", "code"), ("roo", "Roo Code", "code"), ("kilo", "Kilo Code", "code"),
    ("devin", "Devin", "code"), ("eigent", "Eigent", "code"), ("antigravity", "Antigravity", "code"), ("replit", "Replit", "code"), ("v0", "Vercel v0", "code"), ("bolt", "Bolt.new", "code"), ("lovable", "Lovable", "code"),
    ("blackbox", "Blackbox AI", "code"), ("fitten", "Fitten Code", "code"), ("amazonq", "Amazon Q", "code"), ("warp", "Warp", "code"), ("shellgpt", "Shell-GPT", "code"), ("sgpt", "Shell-GPT", "code"), ("mcp", "MCP", "agent"),
    ("fastmcp", "FastMCP", "agent"), ("mcp_server", "MCP Server", "agent"),
)
# Chat sites by address part, in order.
URL_PROVIDERS = (
    ("chatgpt.com", "OpenAI ChatGPT"), ("chat.openai.com", "OpenAI ChatGPT"), ("chatgpt", "OpenAI ChatGPT"), ("openai.com", "OpenAI"), ("claude.ai", "Anthropic Claude"), ("anthropic", "Anthropic"), ("perplexity", "Perplexity"),
    ("gemini.google", "Google Gemini"), ("bard.google", "Google Bard"), ("aistudio", "Google AI Studio"), ("copilot", "Microsoft Copilot"), ("leo.brave", "Brave Leo"), ("grok", "xAI Grok"), ("poe.com", "Poe"), ("deepseek", "DeepSeek"),
    ("mistral", "Mistral"), ("character.ai", "Character AI"), ("huggingface", "HuggingFace Chat"), ("you.com", "You.com"), ("phind", "Phind"), ("devin.ai", "Devin"), ("cognition", "Cognition/Devin"), ("replit", "Replit"),
    ("cursor.sh", "Cursor"), ("windsurf", "Windsurf"),
)
UNKNOWN_PROVIDER = "Unknown AI provider"
_MAC = "Library/Application Support/"
# Where tools keep files below a home folder (tool, risk, roots).
SHADOW_TOOLS = (
    ("deepseek_harness", "high", (".dsh",)), ("cursor", "high", (".cursor", ".config/Cursor")), ("claude_code", "high", (".claude",)), ("codex_cli", "high", (".codex",)), ("aider", "low", (".aider", ".aider.conf.yml", ".aider.input.history")),
    ("continue", "high", (".continue",)), ("cline", "high", (".cline",)), ("warp", "low", (".warp",)), ("shell_gpt", "low", (".shell_gpt",)), ("ollama", "medium", (".ollama",)),
    ("lm_studio", "medium", (_MAC + "LM Studio", ".lmstudio", "AppData/Local/LM-Studio")), ("jan", "medium", (".jan",)), ("anythingllm", "medium", (".anythingllm", _MAC + "anythingllm-desktop")), ("openclaw", "high", (".openclaw", ".config/openclaw")),
    ("clawdbot", "high", (".clawdbot", ".config/clawdbot")), ("moltbot", "high", (".moltbot", ".config/moltbot")), ("nanoclaw", "high", (".nanoclaw", ".config/nanoclaw")), ("openinterpreter", "high", (".open-interpreter",)),
    ("autogen", "medium", (".autogen",)), ("langchain", "low", (".langchain",)), ("copilot", "medium", (".copilot", ".config/github-copilot")), ("gemini_cli", "high", (".gemini",)), ("amazon_q", "medium", (".aws/amazonq", ".config/amazonq")),
    ("windsurf", "high", (".codeium", ".config/Windsurf")), ("kilo_code", "high", (".kilo",)), ("roo_code", "high", (".roo",)), ("goose", "high", (".config/goose", ".goose")), ("openhands", "high", (".openhands", ".config/openhands")),
    ("devika", "high", (".devika",)), ("swe_agent", "high", (".swe-agent",)), ("gpt_engineer", "medium", (".gpt_engineer",)), ("tabby", "low", (".tabby",)), ("fitten", "low", (".fitten",)), ("codeium", "low", (".codeium",)),
    ("blackbox", "low", (".blackbox",)), ("replit", "low", (".replit",)), ("v0", "low", (".v0",)), ("bolt", "low", (".bolt",)), ("lovable", "low", (".lovable",)), ("cursor_rules", "low", (".cursorrules",)),
    ("antigravity", "high", (".antigravity", ".config/Antigravity", _MAC + "Antigravity")), ("devin", "high", (".devin", ".config/devin", _MAC + "Devin")), ("vscodium", "low", (".config/VSCodium", _MAC + "VSCodium")),
    ("eigent", "high", (".eigent", ".config/eigent", _MAC + "Eigent")), ("gordon", "high", (".docker/gordon",)), ("docker_ai", "medium", (".docker/models", ".docker/gordon")),
    ("browser_ai", "medium", (_MAC + "BraveSoftware", _MAC + "Google/Chrome", _MAC + "Microsoft Edge")),
)
_HOME = r"^(/home/[^/]+/|/root/|/Users/[^/]+/|[A-Za-z]:[\\/]Users[\\/][^\\/]+[\\/])"


def catalog(spark: SparkSession, rows, names: tuple[str, ...]) -> DataFrame:
    """A catalog as DataFrame with its order in ``no``."""
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], ["no", *names])


def domains(spark: SparkSession, more=()) -> DataFrame:
    return catalog(spark, (*DOMAINS, *more), ("suffix", "provider", "category"))


def frameworks(spark: SparkSession, more=()) -> DataFrame:
    return catalog(spark, (*FRAMEWORKS, *more), ("prefix", "framework", "category"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def dotted_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def prefixes(name: Column, sep: str) -> Column:
    parts = F.split(name, rf"\{sep}" if sep == "." else sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))


def classify_domain(df: DataFrame, known: DataFrame, host: str = "host", keys: tuple[str, ...] = ("host",)) -> DataFrame:
    """Provider and category of each host by the first catalog suffix that fits; null if none.

    ``known`` is a fixed catalog of a few hundred rows, so it is broadcast.
    """
    long = df.select(*keys, F.explode(dotted_suffixes(F.rtrim(F.lower(F.trim(host)), F.lit(".")))).alias("suffix"))
    hits = first_rule_wins(long.join(F.broadcast(known), "suffix"), list(keys), "no", ["provider", "category"])
    return df.join(hits, list(keys), "left")


def classify_import(df: DataFrame, known: DataFrame, module: str = "module", keys: tuple[str, ...] = ("module",)) -> DataFrame:
    """Framework of each import by the first catalog prefix that fits; null if none."""
    long = df.select(*keys, F.explode(prefixes(F.lower(F.trim(module)), ".")).alias("prefix"))
    hits = first_rule_wins(long.join(F.broadcast(known), "prefix"), list(keys), "no", ["framework", "category"])
    return df.join(hits, list(keys), "left")


def provider_for_url(url: Column) -> Column:
    """Chat provider by the first address part found."""
    out = F.when(F.lit(False), F.lit(""))
    for part, name in URL_PROVIDERS:
        out = out.when(F.lower(url).contains(part), name)
    return out.otherwise(UNKNOWN_PROVIDER)


def network_ai(connections: DataFrame, known: DataFrame, most: int = 20) -> DataFrame:
    """Connections to model services by domain: provider, counts, and at most ``most`` processes and pids of each."""
    named = classify_domain(connections.select("domain").distinct(), known, "domain", ("domain",)).where("provider is not null")
    counts = connections.groupBy("domain").agg(F.count("*").alias("n"))
    processes = linked(connections, ["domain"], "process", most).select("domain", F.col("n").alias("n_processes"), F.col("sample").alias("processes"))
    pids = linked(connections, ["domain"], "pid", most).select("domain", F.col("n").alias("n_pids"), F.col("sample").alias("pids"))
    rows = named.join(counts, "domain").join(processes, "domain").join(pids, "domain")
    return rows.select("domain", "provider", "category", "n_processes", "processes", "n_pids", "pids", "n")


AI_PROCESS = r"(?i)(ollama|lm[ -]?studio|llama[-_.]?(cpp|server)|vllm|litellm|text-generation|koboldcpp|gpt4all|localai|open-?webui|comfyui|aider|autogpt|openhands|claude|codex|cursor|windsurf)"
AI_ENV_PREFIXES = ("OPENAI_", "ANTHROPIC_", "GOOGLE_API", "GEMINI_", "MISTRAL_", "COHERE_", "GROQ_", "HUGGINGFACE", "HF_", "OLLAMA_", "LITELLM_", "AZURE_OPENAI", "XAI_", "DEEPSEEK_", "REPLICATE_")
AI_IMAGES = ("ollama", "vllm", "localai", "open-webui", "text-generation-inference", "tgi", "litellm", "langfuse", "flowise", "dify", "anythingllm", "comfyui", "stable-diffusion", "koboldcpp", "llama.cpp", "llama-cpp", "tritonserver", "jupyter-ai", "autogpt", "openhands", "n8n", "qdrant", "weaviate", "chroma", "milvus")


def ai_process(name: Column, command: Column, port: Column) -> Column:
    """A process that runs a model service, by name, command line or port."""
    return F.coalesce(name.rlike(AI_PROCESS) | command.rlike(AI_PROCESS) | port.isin(*X.SERVICE_PORTS), F.lit(False))


def ai_env_var(name: Column) -> Column:
    """An environment variable of a model service."""
    return F.upper(name).rlike("^(" + "|".join(AI_ENV_PREFIXES) + ")")


def ai_image(image: Column) -> Column:
    """A container image of a model service."""
    return F.lower(image).rlike("(" + "|".join(i.replace(".", r"\.") for i in AI_IMAGES) + ")")


def ai_pid_connections(connections: DataFrame, processes: DataFrame) -> DataFrame:
    """Connections of processes that run model services."""
    ours = processes.where(ai_process(F.col("name"), F.col("command"), F.lit(None).cast("int"))).select("pid")
    return connections.join(ours, "pid", "left_semi")


def shadow_ai_tools(files: DataFrame, tools: DataFrame, path: str = "path") -> DataFrame:
    """Tools whose folder below a home holds a file: number of files, first root wins."""
    rel = F.translate(F.regexp_replace(F.col(path), _HOME, ""), "\\", "/")
    rows = files.where(F.col(path).rlike(_HOME)).withColumn("_rel", rel).select(F.col(path).alias("path"), F.explode(prefixes(F.col("_rel"), "/")).alias("root"))
    hits = first_rule_wins(rows.join(F.broadcast(tools), "root"), ["path"], "no", ["tool", "risk"])
    score = F.when(F.col("risk") == "high", 8).when(F.col("risk") == "medium", 5).otherwise(2)
    return hits.groupBy("tool", "risk").agg(F.count("*").alias("n_files")).withColumn("score", score)


def shadow_tools(spark: SparkSession) -> DataFrame:
    return catalog(spark, [(tool, root, risk) for tool, risk, roots in SHADOW_TOOLS for root in roots], ("tool", "root", "risk"))


def resolve_port_service(rows: DataFrame, ports: DataFrame) -> DataFrame:
    """Service that listens on each port."""
    return rows.join(F.broadcast(ports), "port", "left")


def provider_visits(history: DataFrame, most: int = 20) -> DataFrame:
    """Visits, addresses and a sample of them by provider."""
    rows = history.withColumn("provider", provider_for_url(F.col("url")))
    least = rows.withColumn("_nth", F.dense_rank().over(Window.partitionBy("provider").orderBy("url"))).where(F.col("_nth") <= most)
    sample = least.groupBy("provider").agg(F.array_sort(F.collect_set("url")).alias("sample"))
    return rows.groupBy("provider").agg(F.sum("visit_count").alias("visits"), F.count("*").alias("n_urls")).join(sample, "provider")


def curated(path: Column, size: Column, deep: bool = False) -> Column:
    """Type of a file worth collecting, else null (P5)."""
    p, name = F.lower(path), F.lower(F.element_at(F.split(path, "/"), -1))
    noise = p.rlike(r"/(node_modules|\.git|__pycache__|\.venv|venv|site-packages|cache|caches|gpucache|code cache|blobs?|extensions|locales|crashpad|shadercache|dist|build|target|tmp|logs?/old|statsig|telemetry)/") | name.rlike(
        r"^(\.ds_store|thumbs\.db|desktop\.ini|license(\.txt|\.md)?|readme\.md|package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|go\.sum|changelog\.md|lock|cookies(-journal)?|favicons|\.gitignore)$"
    )
    return (
        F.when(noise, None)
        .when(name.rlike(r"^(\.env(\..*)?|credentials(\.json)?|auth\.json|\.netrc|token(s)?(\.json)?|.*\.pem|id_rsa|id_ed25519)$"), "credential")
        .when(name.rlike(r"\.(db|sqlite|sqlite3|vscdb)$"), "chat_store")
        .when(name.rlike(r"\.jsonl\.zst(d)?$"), "compressed")
        .when(name.rlike(r"history|\.jsonl$"), "history")
        .when(name.rlike(r"\.(json|ya?ml|toml|md|txt|log|conf|ini)$"), "text")
        .when(F.lit(deep) & (size <= 1 << 20), "deep_text")
    )


def code_file(path: Column) -> Column:
    """A source file outside dependency folders."""
    return F.lower(path).rlike(r"\.(py|js|ts|jsx|tsx|go|rs|java|rb|php|cs|cpp|c|h|sh|ipynb)$") & ~path.rlike(r"/(node_modules|\.venv|venv|site-packages|__pycache__|\.git|dist|build)/")


def llama_history(lines: DataFrame, column: str = "line") -> DataFrame:
    """Shell-history lines that name a llama program (P10)."""
    return lines.where(F.lower(column).contains("llama"))


def on_os(df: DataFrame, name: str) -> DataFrame:
    """Rows of one operating system."""
    return df.where(F.lower("source_os") == name.lower())


def collection_toggles(df: DataFrame, chat_history: bool = True, logs: bool = True, deep: bool = False) -> DataFrame:
    """Row sources switched by what is to be collected."""
    off = [t for t, on in (("conversation", chat_history), ("history", chat_history), ("log", logs), ("deep_text", deep)) if not on]
    return df.where(~F.col("artifact_type").isin(*off)) if off else df


def budgeted_collection(files: DataFrame, most_files: int = 200, most_bytes: int = 1 << 30) -> tuple[DataFrame, DataFrame]:
    """(kept, truncations): files of each platform in path order within a count and a byte budget.

    Counts and sizes are running totals over ranges of paths, so a platform's files may be in many tasks.
    """
    ranked = running_totals(files, ["platform"], ["path"], {"nth": F.lit(1), "bytes": F.col("size")})
    fits = (F.col("nth") <= most_files) & (F.col("bytes") <= most_bytes)
    skipped = ranked.where(~fits).groupBy("platform").agg(F.count("*").alias("skipped")).withColumn("max_files", F.lit(most_files))
    return ranked.where(fits).drop("nth", "bytes"), skipped


def chain(*frames: DataFrame) -> DataFrame:
    """Row sources of different columns, one after another."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
