"""Text policies checked against code: claims, ignore entries, query plans, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions import text as tx
from siftwell.operators import fusion, joins, lexical, vector
from siftwell.operators.names import substring_pairs
from siftwell.runtime import cut_lineage, fixed_table

# Keywords per claim category.
CATEGORY_KEYWORDS = {
    "data_sharing": ["share", "sell", "disclose", "provide to", "transfer", "third party", "partner"],
    "encryption": ["encrypt", "secure", "protect", "SSL", "TLS", "hash", "bcrypt"],
    "retention": ["retain", "store", "keep", "delete", "purge", "expire", "TTL"],
    "user_rights": ["request", "right to", "access your", "delete your", "export", "portability", "GDPR", "CCPA"],
    "third_party": ["third-party", "service provider", "vendor", "processor", "sub-processor", "analytics", "tracking"],
    "logging_pii": ["log", "record", "track", "monitor", "audit trail", "PII", "personal"],
    "consent": ["consent", "agree", "opt-in", "opt-out", "permission", "authorize"],
    "security": ["firewall", "authentication", "access control", "vulnerability", "penetration"],
    "access_control": ["role", "permission", "admin", "authorize", "credential"],
}

# Sentence patterns that make a claim, verbs, negation and clear subjects.
WE = r"\b(?:we|our\s+(?:company|organization|service|app|application))\b[^.]*?"
NEGATION = r"\b(?:do\s+not|don't|never|will\s+not|won't|does\s+not|doesn't)\b"
CLAIM_PATTERNS = [
    WE + NEGATION,
    WE + r"\b(?:collect|gather|receive|obtain|acquire)\b",
    WE + r"\b(?:share|disclose|provide|sell|transfer|send)\b",
    r"\b(?:data|information|communications?|traffic|passwords?|credentials?)\b[^.]*?"
    r"\b(?:encrypt(?:ed|ion)|secur(?:ed|ity)|protect(?:ed|ion)|SSL|TLS|hash(?:ed)?|bcrypt)\b",
    WE + r"\b(?:encrypt|secur|protect|hash)\b",
    r"\b(?:you|users?)\b[^.]*?\b(?:can\s+request|have\s+the\s+right\s+to|may\s+request|are\s+entitled|can\s+access|can\s+delete|can\s+export"
    r"|have\s+the\s+ability|right\s+to\s+access|right\s+to\s+delete|right\s+to\s+erasure|right\s+to\s+portability)\b",
    r"\b(?:we|data|information|records?)\b[^.]*?\b(?:retain(?:ed)?|stor(?:ed|e)|keep|kept|delet(?:ed|ion)|purge[d]?|expir(?:es?|ation)|TTL)\b"
    r"[^.]*?\b(?:for|after|within|until|days?|months?|years?|period)\b",
    r"\b(?:third[- ]party|service\s+providers?|vendors?|processors?|sub-?processors?|analytics\s+providers?|advertising\s+partners?)\b",
    r"\b(?:with\s+your\s+consent|you\s+agree|opt[- ]in|opt[- ]out|your\s+permission|you\s+authorize|explicit\s+consent)\b",
]
PRIVACY_VERBS = (
    r"\b(encrypt|secure|protect|share|sell|disclose|collect|gather|receive|retain|store|keep|delete|purge|log|record|track"
    r"|monitor|provide|transfer|authorize|consent)\b"
)
CLEAR_SUBJECT = r"\b(?:we|our|you|users?|data|information)\b"
SECTION_HEADER = r"(?m)^(?:#{1,4}\s+(.+)|(\d+(?:\.\d+)*)\.\s+(.+)|([A-Z][A-Z\s]{4,}[A-Z]))\s*$"
SENTENCE_END = r"(?<=[.!?])\s+"

# Search plans per claim category (tool, query, weight) and the keyword template.
STRATEGIES = {
    "data_sharing": [
        ("search_hybrid", "third party SDK send data external API", 1.0),
        ("search_code", "requests.post fetch axios http.post", 0.9),
        ("kg_query", "outgoing HTTP calls external endpoints", 0.8),
        ("search_hybrid", "data transfer upload telemetry analytics", 0.7),
        ("search_code", "urllib.request httpx.post aiohttp.post", 0.7),
    ],
    "encryption": [
        ("search_code", "AES encrypt decrypt TLS SSL bcrypt argon2 cryptography", 1.0),
        ("find_smells", "crypto weak encryption plaintext password", 0.9),
        ("kg_query", "encryption key management cipher", 0.8),
        ("search_hybrid", "HTTPS certificate verify TLS configuration", 0.8),
        ("search_code", "hashlib hmac fernet nacl pycryptodome", 0.7),
        ("search_hybrid", "at rest encryption database field encrypt", 0.7),
    ],
    "logging_pii": [
        ("search_hybrid", "log PII redact mask scrub personally identifiable", 1.0),
        ("find_smells", "logging sensitive data password email phone", 0.9),
        ("search_code", "logger.info logger.debug logger.warning print email password", 0.8),
        ("search_hybrid", "structured logging sanitize filter sensitive fields", 0.7),
        ("search_code", "log_filter redact_fields mask_pii scrub_sensitive", 0.8),
        ("search_hybrid", "audit trail access log user activity", 0.6),
    ],
    "retention": [
        ("search_hybrid", "delete purge TTL expire retention period", 1.0),
        ("search_code", "DELETE FROM DROP TABLE truncate cleanup expire", 0.9),
        ("kg_query", "data deletion purge schedule", 0.8),
        ("search_hybrid", "data lifecycle expiration scheduled cleanup job", 0.7),
        ("kg_callers_at_commit", "delete_user remove_data purge_records", 0.8),
        ("search_code", "max_age expires_in ttl retention_days", 0.7),
    ],
    "third_party": [
        ("search_code", "analytics segment amplitude mixpanel google_analytics", 1.0),
        ("search_hybrid", "third party vendor SDK integration analytics tracking", 0.9),
        ("search_code", "import stripe twilio sendgrid datadog sentry", 0.8),
        ("kg_query", "external service integration vendor dependency", 0.8),
        ("search_hybrid", "advertising pixel tracking script embed", 0.7),
        ("search_code", "facebook twitter linkedin oauth social", 0.6),
    ],
    "user_rights": [
        ("search_hybrid", "GDPR CCPA DSAR user rights data export portability", 1.0),
        ("kg_query", "user export endpoint data access request", 0.9),
        ("search_code", "right_to_erasure right_to_access data_export gdpr", 0.9),
        ("search_hybrid", "delete account user data request download", 0.8),
        ("search_code", "users export download privacy request erasure", 0.7),
        ("search_hybrid", "consent withdrawal opt out unsubscribe", 0.6),
    ],
}
KEYWORD_TEMPLATES = {
    "data_sharing": "{keywords} data transfer external service",
    "encryption": "{keywords} encrypt implementation",
    "logging_pii": "{keywords} log sensitive data",
    "retention": "{keywords} delete expire retention",
    "third_party": "{keywords} third party integration vendor",
    "user_rights": "{keywords} user rights request",
}
# Evidence paths that are noise.
NOISE_PATTERNS = [
    "*.css", "*.scss", "*.less", "*.svg", "*.png", "*.jpg", "*.jpeg", "*.ico", "**/ui/*.tsx", "**/ui/*.jsx",
    "**/components/ui/*.tsx", "**/components/ui/*.jsx", "*.lock", "*.map", "**/*.test.*", "**/*.spec.*",
]
THIRD_PARTY_WORDS = ["third party", "third-party", "package.json", "analytics", "vendor"]


def _rx(pattern: str) -> str:
    return "(?iU)" + pattern


def policy_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(…, section, body): header-delimited parts of a policy, the first one called Preamble."""
    heads = F.regexp_extract_all(text, F.lit(SECTION_HEADER), 0)
    bare = F.transform(heads, lambda h: F.trim(F.regexp_replace(F.trim(h), r"^(#{1,4}\s+|\d+(\.\d+)*\.\s+)", "")))
    titles = F.transform(bare, lambda h: F.when(h.rlike(r"^[A-Z][A-Z\s]{4,}[A-Z]$"), F.initcap(F.lower(h))).otherwise(h))
    bodies = F.split(text, SECTION_HEADER)
    rows = F.arrays_zip(F.concat(F.array(F.lit("Preamble")), titles).alias("section"), bodies.alias("body"))
    out = docs.select(*[c for c in docs.columns if c != text], F.explode(rows).alias("_r"))
    return out.select(*[c for c in docs.columns if c != text], F.col("_r.section").alias("section"), F.regexp_replace("_r.body", r"^\s+|\s+$", "").alias("body")).filter(F.col("body") != "")


def category_votes(sentence: Column) -> Column:
    """Struct(category, keywords): the category with most keywords in the sentence, earlier ones winning ties."""
    low = F.lower(sentence)
    votes = []
    for i, (name, kws) in enumerate(CATEGORY_KEYWORDS.items()):
        found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k.lower())), k) for k in kws]))
        votes.append(F.struct(F.size(found).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("category"), found.alias("keywords")))
    best = F.array_max(F.array(*votes))
    empty = F.array().cast("array<string>")
    return F.when(best["n"] > 0, F.struct(best["category"].alias("category"), best["keywords"].alias("keywords"))).otherwise(
        F.struct(F.lit("security").alias("category"), empty.alias("keywords"))
    )


def normalize_claim(sentence: Column) -> Column:
    verb = F.regexp_instr(sentence, F.lit(_rx(PRIVACY_VERBS)))
    action = F.lower(F.trim(F.split(F.expr("substring(sentence, _verb)"), "[.,;]")[0]))
    does = F.when(F.lower(sentence).rlike(_rx(NEGATION)), "does not").otherwise("does")
    return verb, F.when(F.col("_verb") > 0, F.concat_ws(" ", F.lit("The application"), does, action)).otherwise(sentence)


def confidence(sentence: Column, keywords: Column) -> Column:
    low, n = F.lower(sentence), F.size(keywords)
    clear = low.rlike(_rx(CLEAR_SUBJECT))
    return F.when(low.rlike(_rx(NEGATION)) & (n > 0), 0.9).when(clear & (n >= 2), 0.85).when(clear & (n == 1), 0.75).otherwise(0.55)


def policy_claims(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Claims per policy text: claim_id, category, keywords, confidence, section, sentence, normalized.

    A sentence counts when a claim pattern fits; ``a and b`` splits when both
    halves hold a privacy verb and vote for different categories. One claim per
    normalized text and policy (partial aggregation, earliest sentence kept).
    """
    sentences = policy_sections(docs.select(key, text), text).select(key, "section", F.posexplode(F.split("body", SENTENCE_END)).alias("_pos", "sentence"))
    hit = tx.any_of([F.col("sentence").rlike(_rx(p)) for p in CLAIM_PATTERNS])
    rows = sentences.withColumn("sentence", F.trim("sentence")).filter(hit)
    halves = F.split("sentence", r"(?i)\s+and\s+", 2)
    left, right = F.trim(F.get("_halves", F.lit(0))), F.trim(F.get("_halves", F.lit(1)))
    both = (F.size("_halves") == 2) & left.rlike(_rx(PRIVACY_VERBS)) & right.rlike(_rx(PRIVACY_VERBS))
    splits = both & (category_votes(left)["category"] != category_votes(right)["category"])
    rows = (
        rows.withColumn("_halves", halves)
        .withColumn("sentence", F.explode(F.when(splits, F.array(left, right)).otherwise(F.array("sentence"))))
        .drop("_halves").withColumn("_v", category_votes(F.col("sentence")))
        .select(key, "section", "_pos", "sentence", F.col("_v.category").alias("category"), F.col("_v.keywords").alias("keywords"))
    )
    verb, normalized = normalize_claim(F.col("sentence"))
    rows = rows.withColumn("_verb", verb).withColumn("normalized", normalized)
    first = rows.groupBy(key, F.lower("normalized").alias("_n")).agg(
        F.min(F.struct("_pos", "section", "sentence", "category", "keywords", "normalized")).alias("c")
    )
    out = first.select(key, "c.section", "c.sentence", "c.category", "c.keywords", "c.normalized")
    claim_id = F.substring(F.sha1(F.concat("category", "normalized").cast("binary")), 1, 12)
    return out.withColumn("claim_id", claim_id).withColumn("confidence", confidence(F.col("sentence"), F.col("keywords")))


def apply_ignores(claims: DataFrame, entries: list[dict], as_of: str) -> DataFrame:
    """Adds ``ignored``: an entry names the claim, its category, or a pattern of its text; expired entries do not apply.

    Entries are configuration, so they become one predicate and need no join.
    """
    tests = []
    for e in entries:
        if e.get("expires") and e["expires"] < as_of:
            continue
        if e.get("claim_id"):
            tests.append(F.col("claim_id") == e["claim_id"])
        if e.get("category"):
            tests.append(F.col("category") == e["category"])
        if e.get("pattern"):
            tests.append(F.col("normalized").rlike("(?i)" + e["pattern"]))
    return claims.withColumn("ignored", tx.any_of(tests))


def route_claims(claims: DataFrame) -> DataFrame:
    """(claim_id, tool, query, weight): the plans of the claim's category and its keyword plan; two generic plans otherwise. Of several claims of one id the smallest is routed."""
    spark = claims.sparkSession
    rows = [(c, t, q, w) for c, plans in STRATEGIES.items() for t, q, w in plans]
    plans = fixed_table(spark, rows, "category string, tool string, query string, weight double")
    first = F.min(F.struct("category", "normalized", "keywords")).alias("c")
    base = claims.groupBy("claim_id").agg(first).select("claim_id", "c.category", "c.keywords", "c.normalized")
    fixed = base.join(F.broadcast(plans), "category").select("claim_id", "tool", "query", "weight")
    template = F.lit(None).cast("string")
    for c, t in KEYWORD_TEMPLATES.items():
        template = F.when(F.col("category") == c, F.lit(t)).otherwise(template)
    known = F.col("category").isin(list(STRATEGIES))
    keyed = base.filter(known & (F.size("keywords") > 0)).select(
        "claim_id", F.lit("search_hybrid").alias("tool"),
        F.replace(template, F.lit("{keywords}"), F.array_join("keywords", " ")).alias("query"), F.lit(0.5).alias("weight"),
    )
    short = F.when(F.size("keywords") > 0, F.array_join("keywords", " ")).otherwise(F.col("normalized"))
    generic = base.filter(~known).select(
        "claim_id",
        F.explode(F.array(
            F.struct(F.lit("search_hybrid").alias("tool"), F.col("normalized").alias("query")),
            F.struct(F.lit("search_code").alias("tool"), short.alias("query")),
        )).alias("p"),
    ).select("claim_id", "p.*", F.lit(1.0).alias("weight"))
    return fixed.unionByName(keyed).unionByName(generic)


def is_noise(path: Column) -> Column:
    """The path or its base name fits a noise pattern (``*`` spans folders here)."""
    name = tx.basename(path)
    return tx.any_of([path.rlike(tx.glob_regex(p)) | name.rlike(tx.glob_regex(p)) for p in NOISE_PATTERNS])


# Which engine answers a plan's tool, and what a name match is worth.
VECTOR_TOOLS = ["search_code"]
HYBRID_TOOLS = ["search_hybrid", "find_smells"]
GRAPH_TOOLS = ["kg_query", "kg_callers_at_commit", "trace_execution_flow"]
GRAPH_SCORE = 0.7


def named_files(queries: DataFrame, nodes: DataFrame, max_terms: int | None = None, per_term: int | None = None) -> DataFrame:
    """(query_id, file_path, callee): the files of ``name_evidence`` with the name of the entity that each stands for."""
    words = queries.select("query_id", F.posexplode(F.array_distinct(F.filter(tx.words(F.col("query")), lambda w: F.length(w) > 3))).alias("_nth", "word"))
    if max_terms is not None:
        words = words.filter(F.col("_nth") < max_terms)
    named = nodes.filter(F.coalesce("file_path", F.lit("")) != "")
    found = substring_pairs(named.select(F.col("id").alias("text_id"), F.col("name").alias("text")), words.select(F.col("word").alias("needle")).distinct())
    found = found.select(F.col("needle").alias("word"), F.col("text_id").alias("id")).join(named.select("id", "name", "file_path"), "id")
    if per_term is not None:
        first = Window.partitionBy("word").orderBy("id")
        found = found.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= per_term).drop("_r")
    one = words.join(found, "word").groupBy("query_id", "file_path").agg(F.min(F.struct("id", "name")).alias("e"))
    return one.select("query_id", "file_path", F.col("e.name").alias("callee"))


def call_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(callee, call_path): the distinct calls of entities of a name, as "caller -> callee"."""
    names = nodes.select("id", "name")
    calls = edges.select("src", "dst").distinct().join(names.select(F.col("id").alias("src"), F.col("name").alias("_caller")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("callee")), "dst")
    calls = calls.select("_caller", "callee").distinct()
    return calls.groupBy("callee").agg(F.array_sort(F.collect_set(F.concat_ws(" -> ", "_caller", "callee"))).alias("call_path"))


def name_evidence(queries: DataFrame, nodes: DataFrame, edges: DataFrame, max_terms: int | None = None, per_term: int | None = None) -> DataFrame:
    """(query_id, file_path, call_path): files with an entity whose name holds a word of the query (query_id, query), words of four letters or more.

    A file stands once for each query, for its smallest entity id; ``call_path`` lists the calls of entities of that name (``call_paths``). All words and entities count, or the first ``max_terms`` words and ``per_term`` entities by id.
    """
    one = named_files(queries, nodes, max_terms, per_term)
    return one.join(call_paths(nodes, edges), "callee", "left").select("query_id", "file_path", "call_path")


def evidence_hits(claims: DataFrame, index: lexical.Bm25Index | lexical.Bm25Blocks, chunks: DataFrame, limit: int = 10, vectors: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, dimension: int = 64) -> DataFrame:
    """(claim_id, tool, query, weight, file_path, start_line, end_line, score, call_path): evidence of every claim, each plan answered by its tool's engine.

    All plans of all claims run as one job a tool, equal query texts once: code search by ``vectors``, hybrid and smell search by vectors and
    postings fused, graph tools by entity names and calls (``nodes``: id, name, file_path; ``edges``). Without vectors the postings answer
    for them, without a graph its plans find nothing. ``package.json`` hits gain half for claims about third parties, noise paths leave, and
    overlapping ranges of a claim are reduced to the best, of equal ones the first tool's and query's. A file and query have one callee, whose
    calls are looked up for the rows that stay.
    """
    plans = cut_lineage(route_claims(claims).distinct().withColumn("query_id", F.md5(F.col("query").cast("binary"))))
    asked = lambda tools: plans.filter(F.col("tool").isin(tools)).select("query_id", "query").distinct()
    both = cut_lineage(asked(VECTOR_TOOLS + HYBRID_TOOLS))
    text = lexical.bm25_search(index, both, 3 * limit, "query")
    if vectors is None:
        near = text.select("query_id", "chunk_id", "similarity", "rank")
    else:
        near = cut_lineage(vector.knn_exact(vectors, vector.hash_vectors(both, "query_id", "query", dimension), 3 * limit))
    fused = fusion.hybrid_rrf(near.select("query_id", "chunk_id", "rank"), text.select("query_id", "chunk_id", "rank"))
    place = chunks.select("chunk_id", "file_path", "start_line", "end_line")
    ranged = lambda hits, tools: plans.filter(F.col("tool").isin(tools)).join(hits, "query_id").join(place, "chunk_id").select(*shown)
    shown = ["claim_id", "tool", "query", "weight", "file_path", "start_line", "end_line", "score", F.lit(None).cast("string").alias("callee")]
    rows = ranged(near.filter(F.col("rank") <= limit).select("query_id", "chunk_id", F.col("similarity").alias("score")), VECTOR_TOOLS)
    rows = rows.unionByName(ranged(fused.filter(F.col("rank") <= limit).select("query_id", "chunk_id", "score"), HYBRID_TOOLS))
    if nodes is not None and edges is not None:
        hits = named_files(asked(GRAPH_TOOLS), nodes)
        graph = plans.filter(F.col("tool").isin(GRAPH_TOOLS)).join(hits, "query_id")
        line = F.lit(0).cast(chunks.schema["start_line"].dataType)
        rows = rows.unionByName(graph.select("claim_id", "tool", "query", "weight", "file_path", line.alias("start_line"), line.alias("end_line"), F.lit(GRAPH_SCORE).alias("score"), "callee"))
    about = plans.groupBy("claim_id").agg(F.max(tx.contains_any(F.lower("query"), THIRD_PARTY_WORDS)).alias("_third"))
    rows = rows.join(about, "claim_id")
    boosted = F.when(F.col("_third") & F.endswith("file_path", F.lit("package.json")), F.least(F.col("score") * 1.5, F.lit(1.0))).otherwise(F.col("score"))
    rows = cut_lineage(rows.withColumn("score", boosted).filter(~is_noise(F.col("file_path"))).drop("_third"))
    best = joins.overlap_dedup(rows.select("claim_id", "file_path", "start_line", "end_line", "score"))
    facts = rows.groupBy("claim_id", "file_path", "start_line", "end_line", "score").agg(F.min(F.struct("tool", "query", "weight", "callee")).alias("p"))
    key = ["claim_id", "file_path", "start_line", "end_line", "score"]
    found = best.join(facts, key).select("claim_id", "p.tool", "p.query", "p.weight", "file_path", "start_line", "end_line", "score", "p.callee")
    if nodes is None or edges is None:
        return found.withColumn("call_path", F.lit(None).cast("array<string>")).drop("callee")
    return found.join(call_paths(nodes, edges), "callee", "left").drop("callee")
