"""Claim extraction: turns -> typed, scored claims, by patterns in column expressions.

Each turn becomes an array of clauses, each clause an array of findings (category, value, subject,
attribute), so the whole chain is one pass without Python; turns are shuffled once, by conversation and number,
and each pattern is matched once a clause.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from .beliefs import CUE

# The vocabulary and the patterns that decide what is found.
TECHNOLOGIES = [
    "PostgreSQL", "Postgres", "MySQL", "MariaDB", "SQLite", "MongoDB", "Redis", "Memcached", "Cassandra", "DynamoDB", "Elasticsearch", "OpenSearch",
    "FastAPI", "Flask", "Django", "Express", "NestJS", "Next.js", "Nuxt", "Remix", "Spring Boot", "Spring", "Rails", "Sinatra", "Phoenix", "Gin", "Echo",
    "React", "Vue", "Svelte", "Solid", "Angular", "Ember", "Kubernetes", "Docker", "ECS", "EKS", "GKE", "ArgoCD", "Helm",
    "GitHub Actions", "GitLab CI", "Jenkins", "CircleCI", "Buildkite", "Stripe", "Adyen", "Braintree", "Square", "PayPal", "Plaid", "Twilio",
    "Auth0", "Okta", "Clerk", "Cognito", "Firebase", "Supabase", "Honeycomb", "Datadog", "Grafana", "Prometheus", "Sentry", "New Relic", "OpenTelemetry", "Jaeger", "Zipkin",
    "Qdrant", "Pinecone", "Weaviate", "Milvus", "Chroma", "pgvector", "Kafka", "RabbitMQ", "NATS", "SQS", "PubSub", "S3", "GCS", "R2", "Azure Blob",
    "Upstash", "ElastiCache", "Lambda", "Cloud Run", "Fly.io", "Render", "Vercel", "Netlify", "Heroku", "AWS", "GCP", "Azure",
    "Go", "Rust", "Python", "TypeScript", "JavaScript", "Java", "Kotlin", "Ruby", "PHP", "C#", "C++", "Swift", "Scala", "Elixir",
    "Anthropic", "OpenAI", "Gemini", "Claude", "DeepSeek", "Qwen", "Llama", "Mistral", "Ollama", "FastEmbed", "BAAI/bge-small-en-v1.5",
    "Node.js", "Node", "Deno", "Bun", "GraphQL", "gRPC", "tRPC", "REST", "Terraform", "Ansible", "Pulumi", "Nginx", "Caddy", "Apache", "HAProxy",
    "Celery", "Sidekiq", "Temporal", "Airflow", "dbt", "Snowflake", "BigQuery", "Databricks", "Spark", "Hadoop", "Flink",
    "Tailwind", "Vite", "Webpack", "esbuild", "Turbopack", "Rollup", "Playwright", "Cypress", "Selenium", "Jest", "Vitest", "Pytest", "Mocha",
    "Prisma", "Drizzle", "SQLAlchemy", "TypeORM", "Sequelize", "Hibernate", "Hasura", "Apollo", "WebSocket", "Socket.IO",
    "Cloudflare", "Fastly", "Akamai", "DigitalOcean", "Hetzner", "Linode", "MinIO", "Backblaze", "Cohere", "HuggingFace", "LangChain", "LlamaIndex",
    "Pandas", "NumPy", "PyTorch", "TensorFlow", "scikit-learn", "JAX", "Tableau", "Looker", "Metabase", "Superset", "Plotly",
]


def _letters(terms: list[str]) -> str:
    """A pattern of the terms, case ignored, that reads common beginnings once; of terms that begin alike, longer ones first."""
    heads: dict[str, list[str]] = {}
    for t in terms:
        if t:
            heads.setdefault(t[0].lower(), []).append(t[1:])
    branches = [re.escape(a) + _letters(rest) for a, rest in sorted(heads.items())]
    if "" in terms:
        return f"(?:{'|'.join(branches)})?" if branches else ""
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


#: Behind a look at the first letter, five letters a look, so that most words are left after a few comparisons.
_FIRST = sorted({t[0].lower() for t in TECHNOLOGIES})
_QUOTED = "|".join(f"(?=[{''.join(some)}]){_letters([t for t in TECHNOLOGIES if t[0].lower() in some])}" for some in (_FIRST[i : i + 5] for i in range(0, len(_FIRST), 5)))
TECHNOLOGY = rf"(?i)\b({_QUOTED})\b"
VERSION = r"\bv?(\d+\.\d+(?:\.\d+)?)\b"
PORT = r"(?i)\bport\s+(\d{2,5})\b"
URL = r"(?i)\b((?:https?://)?[a-z0-9.-]+\.[a-z]{2,}(?:/[^\s]*)?)\b"
PERSON = r"\b([A-Z][a-z]{1,15}(?:\s+[A-Z][a-z]{1,15})?)\s+(?:is|runs|leads|owns|handles|manages|covers)\b"
PERSON_VERB = r"\b[A-Z][a-z]{1,15}(?:\s+[A-Z][a-z]{1,15})?\s+(is|runs|leads|owns|handles|manages|covers)\b"
VERB_ROLE = {"leads": "lead", "runs": "runs", "owns": "owner", "handles": "handler", "manages": "manager", "covers": "cover", "is": "role"}
IDENTITY = {
    "name": r"(?:(?i:\b(?:my name(?:'s| is)|i am|i'm|call me|this is)\s+))([A-Z][a-z]{1,15}(?:\s+[A-Z][a-z]{1,15}){0,2})\b",
    "role": r"(?i)\b(?:i'?m|i am|work as|working as)\s+(?:an?\s+)?([\w/+\- ]*?(?:engineer|developer|designer|manager|scientist|analyst|architect|lead|founder|consultant|researcher|student|teacher|writer|devops|sre|administrator|programmer|intern|cto|ceo|cfo|pm))\b",
    "employer": r"\b(?:work(?:s|ed|ing)?\s+(?:at|for)|employed\s+(?:at|by))\s+([A-Z][\w&.\-]*(?:\s+[A-Z][\w&.\-]*){0,3})\b",
    "location": r"(?:(?i:\b(?:live[sd]?|living|based|located|reside[sd]?)\s+in\s+))([A-Z][\w.\-]*(?:[ ]+[A-Z][\w.\-]*){0,2})\b",
    "email": r"\b([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})\b",
}
FACT = (
    r"(?i)\b(use|uses|using|run|runs|running|host|hosts|hosted|deploy|deployed|deploying|migrate|migrated|upgrade|upgraded|switch|switched|rolled out|set up|configured|live[s]?\s+at|is on|now (?:on|runs)|"
    r"ship|ships|shipped|shipping|build|builds|built|building|work[s]?\s+(?:at|for|on|with)|working\s+(?:at|for|on|with)|worked\s+(?:at|for|on|with)|based\s+(?:in|on|at)|located\s+(?:in|at)|live[sd]?\s+in|living\s+in|"
    r"write[s]?|wrote|written|store[ds]?|stored|cache[ds]?|adopt(?:ed|s)?|integrate[ds]?|choose|chose|standardiz|email|contact|call(?:ed)?|named|handle[ds]?|leads?|owns?|manages?|covers?|is\s+(?:in|on|at)|is\s+\w+|are\s+\w+|consists of|comprises)\b"
)
DECISION = r"(?i)\b(decided|chose|going with|will use|won't use|standardize on|prohibit(?:ed)?|not allowed|require[ds]?|must|never)\b"
ISSUE = r"(?i)\b(bug|issue|problem|incident|outage|broken|fail(?:ed|ing|ure)?|crash)\b"
PREFERENCE = r"(?i)\b(prefer(?:s|red)?|like(?:s|d)?|favorite|wants?|want(?:ed)?)\b"
#: What a text must have for a pattern to match: lower-case words, of which one is in it (case ignored). Looked for first, as that is cheap.
NEEDS = {
    IDENTITY["name"]: ["my name", "i am", "i'm", "call me", "this is"],
    IDENTITY["role"]: ["im", "i'm", "i am", "work as", "working as"],
    IDENTITY["employer"]: ["work", "employed"],
    IDENTITY["location"]: ["live", "living", "based", "located", "reside"],
    IDENTITY["email"]: ["@"],
    PORT: ["port"],
    PERSON: ["is", "runs", "leads", "owns", "handles", "manages", "covers"],
    DECISION: ["decided", "chose", "going with", "will use", "won't use", "standardize on", "prohibit", "not allowed", "require", "must", "never"],
    ISSUE: ["bug", "issue", "problem", "incident", "outage", "broken", "fail", "crash"],
    PREFERENCE: ["prefer", "like", "favorite", "want"],
}
STATEMENT_VERB = (
    r"(?i)\b(is|are|was|were|has|have|had|runs?|ran|running|uses?|used|owns?|owned|manages?|managed|equals?|costs?|takes?|targets?|set to|stays?|keeps?|kept|stores?|stored|escalates?|supersed\w+|deploys?|deployed|hosts?|hosted|"
    r"lives?|moved|migrat\w+|switch\w+|renamed|decided|expires?|rotates?|target(?:s|ing|ed)?|aim(?:s|ing|ed)?|plans?|planning)\b"
)
DEPARTED = r"(?i)(?:no longer|not anymore|moved (?:off|away from)|migrat\w+ (?:from|off)|switch\w+ (?:from|away from)|instead of|replaced|deprecat\w+|dropp\w+|used to (?:be|run|use|live on))"
DEPARTURE = DEPARTED + r"\W+(?:\w+\W+){0,3}?"
PROJECT_WORDS = ["production", "prod", "staging", "deploy", "deploys", "deployed", "auth", "billing", "payments", "orders", "gateway", "scheduler"]
HIGH_VALUE = ["port", "url", "person", "version"]
SERVICE = r"(?i)\b([a-z][a-z0-9_-]*[-_](?:svc|service|gateway|api|server|db|store|queue|worker|job))\b"
NEAR_VERSION = r"\b([A-Za-z][A-Za-z0-9.+]+)\s+(v?\d+\.\d+(?:\.\d+)?)\b"
USES = r"(?i)\b([A-Za-z][A-Za-z0-9.+_-]+)\s+(?:uses?|using|runs on|hosted on|deployed on|lives on|is on|sits on)\s+([A-Za-z][A-Za-z0-9.+_-]+)\b"
NUMBER = r"^v?\d+\.\d+"
MIGRATED = r"(?i)\bmigrat(?:ed|ing) (?:from )?([A-Za-z][A-Za-z0-9.+_-]+)\s+to\s+([A-Za-z][A-Za-z0-9.+_-]+)\b"
UPGRADED = r"(?i)\b(?:upgrade[d]?|moved)\s+([A-Za-z][A-Za-z0-9.+_-]+)\s+to\s+([A-Za-z0-9.+]+)\b"
PLACEHOLDERS = ["speaker a", "speaker b", "user", "assistant", "someone", "anyone"]
FINDING = "struct<type:string,category:string,value:string,subject:string,attribute:string>"


def normalized_turns(turns: DataFrame) -> DataFrame:
    """Lower-case roles (unknown where missing), normalized text, without empty turns."""
    role = F.coalesce(F.nullif(F.lower(F.trim("role")), F.lit("")), F.lit("unknown"))
    return turns.withColumn("role", role).withColumn("text", tx.normalize_text(F.col("text"))).filter("text <> ''")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def _may_match(low: Column, pattern: str) -> Column:
    """Whether the lower-case text has what the pattern needs."""
    return reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in NEEDS[pattern]))


def clause_type(c: Column, low: Column | None = None) -> Column:
    low = F.lower(c) if low is None else low
    has = lambda p: _may_match(low, p) & c.rlike(p)
    return F.when(has(ISSUE), "issue").when(has(DECISION), "decision").when(has(PREFERENCE), "preference").otherwise("fact")


def canonical(c: Column) -> Column:
    """A technology's spelling in the vocabulary."""
    spelled: dict[str, str] = {}
    for t in TECHNOLOGIES:
        spelled.setdefault(t.lower(), t)
    return F.coalesce(F.try_element_at(F.map_from_arrays(F.lit(list(spelled)), F.lit(list(spelled.values()))), F.lower(c)), c)


def _found(values: Column, kind: Column, category: str, attribute, subject=None) -> Column:
    none = F.lit(None).cast("string")
    return F.transform(values, lambda v: F.struct(kind.alias("type"), F.lit(category).alias("category"), F.trim(v).alias("value"), (subject(v) if subject else none).alias("subject"), (attribute(v) if callable(attribute) else F.lit(attribute)).alias("attribute")).cast(FINDING))


#: Technologies and versions in order of place.
NAMED = rf"(?i)\b(?:{_QUOTED})\b|\bv?\d+\.\d+(?:\.\d+)?\b"


def versions(named: Column) -> Column:
    """struct(version, technology before it) of a clause's technologies and versions: a fold in order of place."""
    state, none = "struct<tech:string,out:array<struct<version:string,tech:string>>>", F.array().cast("array<struct<version:string,tech:string>>")
    start = F.struct(F.lit(None).cast("string").alias("tech"), none.alias("out")).cast(state)

    def step(s: Column, t: Column) -> Column:
        more = F.array(F.struct(F.regexp_replace(t, "^v", "").alias("version"), s["tech"].alias("tech")))
        return F.when(t.rlike(NUMBER), F.struct(s["tech"].alias("tech"), F.concat(s["out"], more).alias("out")).cast(state)).otherwise(F.struct(t.alias("tech"), s["out"].alias("out")).cast(state))

    return F.when(F.exists(named, lambda t: t.rlike(NUMBER)), F.aggregate(named, start, step)["out"]).otherwise(none)


def findings(c: Column) -> Column:
    """array of FINDING of a clause: identity facts always, the others if a trigger is there."""
    return _let(F.lower(c), lambda low: _findings(c, low))


def _findings(c: Column, low: Column) -> Column:
    none = F.array().cast(f"array<{FINDING}>")
    roles = F.map_from_arrays(F.lit(list(VERB_ROLE)), F.lit(list(VERB_ROLE.values())))
    if_any = lambda pattern, found: F.when(_may_match(low, pattern), found).otherwise(none)
    identity = [if_any(p, _found(tx.find_all(c, p, 1), F.lit("fact"), k, k)) for k, p in IDENTITY.items()]

    def rest(kind: Column) -> Column:
        def of_names(named: Column) -> Column:
            numbered = F.transform(versions(named), lambda v: F.struct(kind.alias("type"), F.lit("version").alias("category"), v["version"].alias("value"), v["tech"].alias("subject"), F.lit("version").alias("attribute")).cast(FINDING))
            # no technology begins like a version
            return F.concat(_found(F.transform(F.filter(named, lambda t: ~t.rlike(r"(?i)^v?\d")), canonical), kind, "technology", "stack"), numbered)

        urls = F.filter(tx.find_all(c, URL, 1), lambda u: ~u.rlike(r"\.(js|py|md|txt|json)$") & ~u.rlike(r"^\d+\.\d+"))
        people = F.zip_with(tx.find_all(c, PERSON, 1), tx.find_all(c, PERSON_VERB, 1), lambda n, v: F.struct(kind.alias("type"), F.lit("person").alias("category"), n.alias("value"), F.lit(None).cast("string").alias("subject"), F.coalesce(F.try_element_at(roles, F.lower(v)), F.lit("role")).alias("attribute")).cast(FINDING))
        return F.concat(_let(tx.find_all(c, NAMED), of_names), if_any(PORT, _found(tx.find_all(c, PORT, 1), kind, "port", "port")), _found(urls, kind, "url", "location"), if_any(PERSON, people))

    # a decision, preference or issue is a trigger too
    return F.concat(*identity, _let(clause_type(c, low), lambda kind: F.when((kind != "fact") | c.rlike(FACT), rest(kind)).otherwise(none)))


def content_line(category: Column, value: Column, subject: Column, attribute: Column) -> Column:
    line = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    return (
        F.when((category == "version") & subject.isNotNull(), line(subject, " version is ", value, ".")).when(category == "port", line("port ", value, " is in use.")).when(category == "url", line("URL: ", value, "."))
        .when((category == "person") & attribute.isNotNull(), line(value, " (", attribute, ").")).when(category == "technology", line("Uses ", value, ".")).when(category.isin("name", "role", "email"), line("The user's ", category, " is ", value, "."))
        .when(category == "employer", line("The user works at ", value, ".")).when(category == "location", line("The user is located in ", value, ".")).when(category == "statement", value).when(category == "retraction", line("No longer uses ", value, ".")).otherwise(line(category, ": ", value))
    )


def importance(category: Column, kind: Column, span: Column) -> Column:
    score = F.lit(0.5) + F.when(category.isin(HIGH_VALUE), 0.2).otherwise(0.0) + F.when(kind == "decision", 0.2).when(kind == "issue", 0.15).when(kind == "preference", 0.1).otherwise(0.0) + F.when(tx.words_in(F.lower(span), PROJECT_WORDS), 0.1).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def confidence(category: Column, kind: Column, subject: Column, attribute: Column) -> Column:
    base = F.when(category.isin(HIGH_VALUE), 0.95).when(kind == "fact", 0.85).when(kind == "decision", 0.8).when(kind == "issue", 0.75).when(kind == "preference", 0.7).otherwise(0.6)
    return F.round(F.least(F.lit(1.0), base + F.when(subject.isNotNull() & attribute.isNotNull(), 0.05).otherwise(0.0)), 6)


UNIT = "struct<k:struct<category:string,value:string,subject:string>,clause_no:int,nth:int,role:string,ts:timestamp,span:string,type:string,category:string,value:string,subject:string,attribute:string,retracts:boolean>"


def _units(said: Column, split: Callable[[Column], Column], found: Callable[[Column], Column]) -> Column:
    """array of UNIT of what is found in the parts of a turn's texts (role, ts, text)."""

    def unit(s: Column, span: Column, i: Column, f: Column, n: Column) -> Column:
        k = F.struct(f["category"].alias("category"), F.lower(f["value"]).alias("value"), F.lower(F.coalesce(f["subject"], F.lit(""))).alias("subject"))
        return F.struct(k.alias("k"), i.alias("clause_no"), n.alias("nth"), s["role"].alias("role"), s["ts"].alias("ts"), span.alias("span"), *(f[x].alias(x) for x in ("type", "category", "value", "subject", "attribute")), F.lit(False).alias("retracts")).cast(UNIT)

    return F.flatten(F.transform(said, lambda s: F.flatten(F.transform(split(s["text"]), lambda span, i: F.transform(found(span), lambda f, n: unit(s, span, i, f, n))))))


def _first_of_equals(units: Column) -> Column:
    """Of units with one k the first by clause and number."""
    return _let(F.sort_array(units), lambda u: F.filter(u, lambda x, i: (i == 0) | ~x["k"].eqNullSafe(F.get(u, i - 1)["k"])))


def _retracting(u: Column) -> Column:
    """A unit whose technology is named in a departure is a retraction."""
    escaped = F.regexp_replace(u["value"], r"([^A-Za-z0-9_ ])", r"\\$1")
    gone = (u["category"] == "technology") & u["span"].rlike(DEPARTED) & F.regexp_like(u["span"], F.concat(F.lit(DEPARTURE), escaped))
    return F.when(gone, u.withField("category", F.lit("retraction")).withField("retracts", F.lit(True))).otherwise(u)


def _covered(units: Column) -> Column:
    """The signals and names of units; attributes are plain words, which hold no signal."""
    named = lambda *names: F.flatten(F.transform(units, lambda u: F.array_compact(F.array(*(u[n] for n in names)))))
    return F.array_distinct(F.concat(tx.signal_tokens(F.array_join(named("value", "subject"), "\n")), F.transform(named("value", "subject", "attribute"), F.lower)))


def _statement(covered: Column) -> Callable[[Column], Column]:
    """For a sentence: an array of one FINDING if it states something that isn't covered."""
    none = F.lit(None).cast("string")

    def found(span: Column) -> Column:
        one = F.array(F.struct(F.lit("fact").alias("type"), F.lit("statement").alias("category"), span.alias("value"), none.alias("subject"), none.alias("attribute")).cast(FINDING))
        says = _let(tx.signal_tokens(span), lambda signals: (F.size(signals) > 0) & ((F.length(span) >= 60) | (F.size(F.array_except(signals, covered)) > 0)))
        return F.when(F.length(span).between(25, 400) & ~span.rlike(r"\?\s*$") & span.rlike(STATEMENT_VERB) & says, one).otherwise(F.array().cast(f"array<{FINDING}>"))

    return found


def extracted(turns: DataFrame, statements: bool = True) -> DataFrame:
    """Claims of turns (conv_id, turn_no, role, text, ts): categorical findings, then statements that say more.

    Of equal findings of a turn (category, value, subject, case ignored) the first stays. A value that is
    named in a departure becomes a retraction with a supersession hint. Without ``statements`` the findings only.
    """
    # the only shuffle; rows of one conversation and number are one turn
    t = normalized_turns(turns).groupBy("conv_id", "turn_no").agg(F.collect_list(F.struct("role", "ts", "text")).alias("said"))

    def units(found: Column) -> Column:
        if not statements:
            return F.transform(found, _retracting)
        # a turn without conversation or number is no turn that a finding could cover
        covered = F.when(F.col("conv_id").isNotNull() & F.col("turn_no").isNotNull(), _covered(found)).otherwise(F.array().cast("array<string>"))
        stated = _let(covered, lambda known: F.transform(_units(F.col("said"), tx.split_sentences, _statement(known)), lambda u: u.withField("nth", F.lit(1000))))
        return F.concat(F.transform(found, _retracting), stated)

    # outer: an inner one would be preceded by a filter that works the array out once more
    rows = t.select("conv_id", "turn_no", F.explode_outer(_let(_first_of_equals(_units(F.col("said"), tx.split_clauses, findings)), units)).alias("u")).filter("u is not null").select("conv_id", "turn_no", "u.*").drop("k")
    person = (F.col("category") == "person") & ~F.col("value").isin(tx.NOT_PROPER)
    rows = rows.filter((F.col("category") != "person") | person)
    category, value, subject, attribute = (F.col(c) for c in ("category", "value", "subject", "attribute"))
    return rows.select(
        "conv_id", "turn_no", "role", "ts", "clause_no", "nth", "type", "category", "value",
        F.when(person, value).otherwise(subject).alias("entity"), F.when(person, F.lit("role")).otherwise(attribute).alias("attribute"), F.when(person, attribute).otherwise(value).alias("claim_value"),
        content_line(category, value, subject, attribute).alias("content"), importance(category, F.col("type"), F.col("span")).alias("importance"), confidence(category, F.col("type"), subject, attribute).alias("confidence"),
        (F.col("retracts") | F.col("span").rlike(CUE)).alias("supersedes_hint"), "span",
    )


def claim_rows(units: DataFrame, user: Column, first: bool = False) -> DataFrame:
    """Units as claims: deterministic id, authority from importance, the sentence and the triple as two views. Of units with one id any stays, with ``first`` the earliest (ties: the least of the others)."""
    triple = F.struct(F.coalesce("entity", F.lit("user")).alias("subject"), F.lit("has").alias("verb"), F.col("claim_value").alias("object"), F.col("supersedes_hint").alias("negated"), "confidence", "category")
    rows = units.select(tx.dedupe_id(user, F.col("content"), F.col("entity"), F.col("attribute"), F.col("claim_value"), "unit").alias("id"), user.alias("user_id"), "content", "entity", "attribute", F.col("claim_value").alias("value"), "ts", F.col("importance").alias("authority"), "supersedes_hint", triple.alias("triple"))
    if not first:
        return rows.dropDuplicates(["id"])
    order = ["ts", *(c for c in rows.columns if c not in ("id", "ts"))]
    return rows.groupBy("id").agg(F.min(F.struct(*order)).alias("r")).select("id", "r.*")


def entity_mentions(c: Column) -> Column:
    """array<struct<type, text>> of technologies, services, people and versions near a known term."""
    pair = lambda kind: lambda x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    tech, service, person = tx.find_all(c, TECHNOLOGY, 1), tx.find_all(c, SERVICE, 1), tx.find_all(c, PERSON, 1)
    known = F.transform(F.concat(tech, service, person), F.lower)
    near = F.filter(F.arrays_zip(tx.find_all(c, NEAR_VERSION, 1).alias("a"), tx.find_all(c, NEAR_VERSION, 2).alias("b")), lambda z: F.array_contains(known, F.lower(z["a"])))
    return F.concat(F.transform(F.array_distinct(tech), pair("technology")), F.transform(F.array_distinct(service), pair("service")), F.transform(F.array_distinct(person), pair("person")), F.transform(F.array_distinct(F.transform(near, lambda z: z["b"])), pair("version")))


def relationship_edges(turns: DataFrame) -> DataFrame:
    """(conv_id, turn_no, source, relation, target, confidence): the surest of each (source, relation, target) in a turn, case ignored."""
    c = F.col("text")

    def edges(pattern: str, relation: str, sure: float) -> Column:
        return F.zip_with(tx.find_all(c, pattern, 1), tx.find_all(c, pattern, 2), lambda a, b: F.struct(a.alias("source"), F.lit(relation).alias("relation"), b.alias("target"), F.lit(sure).alias("confidence")))

    tech, service = F.array_distinct(tx.find_all(c, TECHNOLOGY, 1)), F.array_distinct(tx.find_all(c, SERVICE, 1))
    together = F.flatten(F.transform(service, lambda s: F.transform(tech, lambda t: F.struct(s.alias("source"), F.lit("uses").alias("relation"), t.alias("target"), F.lit(0.5).alias("confidence")))))
    near = F.filter(edges(NEAR_VERSION, "version", 0.85), lambda e: F.array_contains(F.transform(tech, F.lower), F.lower(e["source"])))
    all_ = F.concat(edges(USES, "uses", 0.8), edges(MIGRATED, "replaced_by", 0.85), edges(UPGRADED, "upgraded_to", 0.85), together, near)
    rows = turns.select("conv_id", "turn_no", F.posexplode(all_).alias("n", "e")).select("conv_id", "turn_no", "n", "e.*")
    best = F.row_number().over(Window.partitionBy("conv_id", "turn_no", F.lower("source"), "relation", F.lower("target")).orderBy(F.desc("confidence"), "n"))
    return rows.withColumn("nth", best).filter("nth = 1").drop("nth", "n")


def chunked(claims: DataFrame, max_tokens: int) -> DataFrame:
    """Claims over the limit as chunks of whole sentences (over-long ones cut), ids ``id#chunkN`` and the parent's id; others unchanged with a null parent."""
    size = max_tokens * 4
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(s) - 1) / size).cast("int"))), lambda i: F.trim(F.substring(s, i * size + 1, F.lit(size))))
    pieces = F.filter(F.flatten(F.transform(F.split(F.trim("content"), r"(?<=[.!?])\s+"), cut)), lambda p: p != "")
    state = "struct<done:array<string>,cur:string>"

    def step(s: Column, p: Column) -> Column:
        full = (F.length(s["cur"]) + F.length(p) + 1 > size) & (s["cur"] != "")
        return F.when(full, F.struct(F.concat(s["done"], F.array(s["cur"])).alias("done"), p.alias("cur")).cast(state)).otherwise(F.struct(s["done"].alias("done"), F.when(s["cur"] == "", p).otherwise(F.concat_ws(" ", s["cur"], p)).alias("cur")).cast(state))

    folded = F.aggregate(pieces, F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur")).cast(state), step, lambda s: F.filter(F.concat(s["done"], F.array(s["cur"])), lambda x: x != ""))
    parts = F.when(F.floor(F.length("content") / 4) <= max_tokens, F.array("content")).otherwise(folded)
    rows = claims.withColumn("parts", parts).select("*", F.posexplode("parts").alias("n", "part"))
    many = F.size("parts") > 1
    return rows.withColumn("parent_id", F.when(many, F.col("id").cast("string"))).withColumn("id", F.when(many, F.concat(F.col("id").cast("string"), F.lit("#chunk"), F.col("n").cast("string"))).otherwise(F.col("id").cast("string"))).withColumn("content", F.col("part")).drop("parts", "part", "n")


def message_windows(turns: DataFrame, width: int = 3) -> DataFrame:
    """Every ``width`` consecutive messages of a conversation as one claim, ``role: text | ...``."""
    w = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(0, width - 1)
    rows = turns.select("conv_id", "turn_no", F.collect_list(F.concat_ws(": ", "role", "text")).over(w).alias("m"), F.max("turn_no").over(w).alias("last_turn"))
    return rows.filter(F.size("m") == width).select("conv_id", F.col("turn_no").alias("first_turn"), "last_turn", F.array_join("m", " | ").alias("content"), F.lit("message-window").alias("source"), F.lit(0.65).alias("authority"))


def message_claims(turns: DataFrame) -> DataFrame:
    """Each message as a claim ``role: text``, with the days it names resolved by its own time."""
    content = tx.enrich_with_dates(F.concat(F.coalesce("role", F.lit("unknown")), F.lit(": "), "text"), F.col("ts"))
    return turns.filter("text is not null").select("conv_id", "turn_no", content.alias("content"), "ts", F.lit("message").alias("source"), F.lit(0.7).alias("authority"))


def paired(turns: DataFrame) -> DataFrame:
    """Messages (0, 1), (2, 3), ... of a conversation as (conv_id, pair, first, second)."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn_no")) - 1
    rows = turns.withColumn("n", n).withColumn("pair", F.floor(F.col("n") / 2))
    side = lambda k: F.max(F.when(F.col("n") % 2 == k, F.col("text")))
    return rows.groupBy("conv_id", "pair").agg(side(0).alias("first"), side(1).alias("second"))


def cards(pairs: DataFrame) -> DataFrame:
    """One card for each pair: title and summary from the prompt, else the reply."""
    summary = F.left(F.coalesce("second", F.lit("")), F.lit(280))
    return pairs.select("conv_id", "pair", tx.card_title(F.col("first"), F.col("second")).alias("title"), summary.alias("summary"))


def ingested_answers(answers: DataFrame) -> DataFrame:
    """Model answers (qid, user_query, answer JSON with facts) as claims: denials dropped, made-up dates repaired, confidence clamped, a discount where only the assistant can have said it."""
    schema = "facts array<struct<content:string,entity:string,attribute:string,value:string,confidence:string>>"
    rows = answers.select("qid", "user_query", F.explode(F.from_json(tx.json_block(F.col("answer")), schema)["facts"]).alias("f"))
    rows = rows.select("qid", "user_query", "f.*").filter(~tx.looks_like_denial(F.col("content")))
    asked = tx.is_pure_question(F.col("user_query"))
    sure = tx.coerce_confidence(F.col("confidence"), F.lit(0.5))
    return rows.select("qid", tx.strip_made_up_dates(F.col("content"), F.col("user_query")).alias("content"), "entity", "attribute", "value", F.when(asked, sure * 0.7).otherwise(sure).alias("confidence"), F.when(asked, "assistant").otherwise("user").alias("speaker"))


def tuple_claims(records: DataFrame) -> DataFrame:
    """Records (id, tuples array<struct<s, v, o, time, negated>>, turn_summary, session_summary) as claims of authority 0.85, 0.75, 0.80; placeholder subjects and open tuples are dropped."""
    r = records.select("id", F.explode("tuples").alias("t")).select("id", "t.*").filter((F.coalesce("s", F.lit("")) != "") & (F.coalesce("v", F.lit("")) != "") & (F.coalesce("o", F.lit("")) != "") & ~F.lower(F.trim("s")).isin(PLACEHOLDERS))
    tuples = r.select("id", tx.tuple_to_content(F.col("s"), F.col("v"), F.col("o"), F.coalesce("time", F.lit("")), F.coalesce("negated", F.lit(False))).alias("content"), F.col("s").alias("entity"), F.lit(0.85).alias("authority"))
    none = F.lit(None).cast("string")
    summaries = [records.filter(f"coalesce({c}, '') <> ''").select("id", F.col(c).alias("content"), none.alias("entity"), F.lit(a).alias("authority")) for c, a in (("turn_summary", 0.75), ("session_summary", 0.80))]
    return tuples.unionByName(summaries[0]).unionByName(summaries[1])


def synthesized(claims: DataFrame, index: DataFrame, entities: int = 20, least: int = 3, most: int = 12, chars: int = 120) -> DataFrame:
    """A summary claim of each of the top entities: its newest snippets, one for each equal beginning."""
    top = index.groupBy("entity").agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), "entity").limit(entities).select("entity")
    rows = claims.select("id", "ts", "content").join(F.broadcast(top), F.contains(F.lower("content"), F.lower("entity")))  # at most ``entities`` rows
    rows = rows.withColumn("snippet", F.left(F.trim("content"), F.lit(chars))).withColumn("key", F.trim(F.lower(F.left("snippet", F.lit(40)))))
    new = F.row_number().over(Window.partitionBy("entity", "key").orderBy(F.desc("ts"), "id"))
    rows = rows.withColumn("nth", new).filter("nth = 1").withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("ts"), "id"))).filter(F.col("place") <= most)
    out = rows.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("place", "snippet"))).alias("s"), F.max("ts").alias("ts")).filter(F.size("s") >= least)
    text = F.concat(F.lit("About "), "entity", F.lit(":\n"), F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), x["snippet"])), "\n"))
    return out.select(tx.synth_id(F.col("entity")).alias("id"), "entity", text.alias("content"), "ts", F.lit("entity-synthesis").alias("source"), F.lit(0.78).alias("authority"))
