"""Column functions: paths, classes, levels, scores, fingerprints, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./+)+", "")


def namespace(path: Column) -> Column:
    """All but the last part, or ``root``."""
    return F.when(F.instr(path, "/") == 0, "root").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def module_path(path: Column) -> Column:
    """The first part of paths of up to two parts, else the first two."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.when(F.size(parts) <= 2, 1).otherwise(2)), "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower case with its dot; empty if there is none or the name begins with it."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1))


def entry_depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))) - 1


def path_status(path: Column) -> Column:
    """Why an archive entry may not be written: ABSOLUTE, TRAVERSAL, DANGEROUS or null."""
    p = F.regexp_replace(path, r"\\", "/")
    climbs = F.aggregate(
        F.split(p, "/"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda a, x: F.struct(
            (a["at"] + F.when(x == "..", -1).when((x == "") | (x == "."), 0).otherwise(1)).alias("at"),
            F.least(a["low"], a["at"] + F.when(x == "..", -1).when((x == "") | (x == "."), 0).otherwise(1)).alias("low"),
        ),
        lambda a: a["low"] < 0,
    )
    return F.when(p.rlike(r"^(/|[A-Za-z]:)"), "ABSOLUTE").when(climbs, "TRAVERSAL").when(p.rlike(r"[\x00-\x1f]|^~|%2e%2e|\$\{|`"), "DANGEROUS")


#: Languages by extension.
LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TSX", ".mts": "TypeScript", ".cts": "TypeScript", ".js": "JavaScript", ".jsx": "JSX", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".py": "Python", ".rs": "Rust", ".go": "Go", ".java": "Java", ".rb": "Ruby", ".php": "PHP", ".c": "C", ".cpp": "Cpp", ".cc": "Cpp", ".cxx": "Cpp", ".h": "C", ".hpp": "Cpp",
    ".cs": "CSharp", ".swift": "Swift", ".kt": "Kotlin", ".kts": "Kotlin", ".scala": "Scala", ".yaml": "Yaml", ".yml": "Yaml", ".json": "Json", ".json5": "Json", ".jsonc": "Json",
    ".toml": "Toml", ".md": "Markdown", ".mdx": "Markdown", ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell", ".sql": "Sql", ".asm": "Assembly", ".proto": "Protobuf",
    ".graphql": "GraphQL", ".gql": "GraphQL", ".tf": "Terraform", ".tfvars": "Terraform",
}
#: Content types by extension.
CONTENT_TYPES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".mjs": "javascript", ".cjs": "javascript", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown", ".mdx": "markdown",
    ".html": "html", ".css": "css", ".scss": "scss", ".py": "python", ".rs": "rust", ".go": "go", ".java": "java", ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp", ".h": "c-header", ".hpp": "cpp-header", ".cs": "csharp",
    ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".sql": "sql", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".proto": "protobuf", ".graphql": "graphql", ".gql": "graphql", ".tf": "terraform", ".svg": "svg", ".txt": "text",
}
#: Ordered classes of files by what their path looks like.
FILE_CLASSES = (
    ("SECRET", r"(?i)(^|/)(\.env(\..*)?|[^/]*\.(pem|key|p12|pfx|keystore)|id_rsa|id_dsa|credentials?(\.json)?|secrets?\.(json|ya?ml))$"),
    ("BINARY", r"(?i)\.(exe|dll|so|dylib|bin|class|jar|war|o|a|obj|pyc|zip|gz|tar|7z|rar|pdf|wasm)$"),
    ("ASSET", r"(?i)\.(png|jpe?g|gif|svg|ico|webp|bmp|woff2?|ttf|eot|otf|mp4|webm|avi|mov|mkv|mp3|wav|ogg|flac)$"),
    ("TEST", r"(?i)(^|/)(tests?|__tests__|specs?|e2e)/|\.(test|spec|e2e|integration)\.[a-z]+$|(^|/)test_[^/]*\.py$"),
    ("GENERATED", r"(?i)\.d\.[cm]?ts$|\.generated\.|\.pb\.|\.grpc\.|\.min\.(js|css)$|\.bundle\."),
    ("INFRASTRUCTURE", r"(?i)(^|/)(dockerfile|docker-compose[^/]*|jenkinsfile|makefile|vagrantfile)$|\.tf(vars)?$|(^|/)(\.github|\.circleci|k8s|helm|terraform|ansible)/"),
    ("CONFIG", r"(?i)(^|/)(config|configs|settings)/|\.(json5?|jsonc|ya?ml|toml|ini|cfg|conf|properties|env)$|\.config\.[cm]?[jt]s$|(^|/)\.[a-z]+rc$"),
    ("DOCUMENTATION", r"(?i)\.(mdx?|rst|adoc|txt)$|(^|/)(readme|changelog|license|contributing)[^/]*$"),
)
#: Base relevance by class.
BASE_RELEVANCE = {"SOURCE_CODE": 0.8, "TEST": 0.5, "CONFIG": 0.4, "INFRASTRUCTURE": 0.4, "DOCUMENTATION": 0.3, "GENERATED": 0.1, "ASSET": 0.05, "BINARY": 0.0, "SECRET": 0.0, "UNKNOWN": 0.2}


def lookup(table: dict[str, object], key: Column, default: object = None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(m[key], F.lit(default)) if default is not None else m[key]


def language_of(path: Column) -> Column:
    return lookup(LANGUAGES, extension(path))


def content_type(path: Column) -> Column:
    """What kind of content an extension stands for, ``unknown`` for others."""
    return lookup(CONTENT_TYPES, extension(path), "unknown")


def file_class(path: Column) -> Column:
    out = F.when(language_of(path).isNotNull(), "SOURCE_CODE").otherwise("UNKNOWN")
    for name, pattern in reversed(FILE_CLASSES):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def relevance(path: Column, kind: Column) -> Column:
    """Base by class, more under src, hardly any for generated files, a little more for deep source."""
    score = lookup(BASE_RELEVANCE, kind, 0.2)
    score = F.when(path.rlike(r"(^|/)src/"), F.least(score + 0.2, F.lit(1.0))).otherwise(score)
    score = F.when(kind.isin("GENERATED", "BINARY"), F.least(score, F.lit(0.1))).otherwise(score)
    deep = (F.size(F.split(path, "/")) > 2) & (kind == "SOURCE_CODE")
    return F.round(F.when(deep, F.least(score + 0.05, F.lit(1.0))).otherwise(score), 2)


def fan_level(total: Column) -> Column:
    return F.when(total >= 50, "CRITICAL").when(total >= 20, "HIGH").when(total >= 10, "MODERATE").otherwise("LOW")


def instability_class(x: Column) -> Column:
    return F.when(x > 0.8, "VOLATILE").when(x > 0.6, "UNSTABLE").when(x >= 0.3, "BALANCED").otherwise("STABLE")


def steps(x: Column, *bounds: tuple[float, str], other: str) -> Column:
    """The first name whose bound ``x`` reaches."""
    out = F.lit(other)
    for bound, name in reversed(bounds):
        out = F.when(x >= bound, name).otherwise(out)
    return out


def percent_change(before: Column, now: Column) -> Column:
    return F.when(before == 0, now * 100).otherwise((now - before) / F.abs(before) * 100)


def drift(dn: Column, de: Column, dd: Column, ds: Column) -> Column:
    return F.sqrt(F.pow(dn, 2) + F.pow(de, 2) + F.pow(dd * 100, 2) + F.pow(ds, 2))


def drift_class(x: Column) -> Column:
    return F.when(x > 50, "severe").when(x > 20, "significant").when(x > 5, "moderate").otherwise("minor")


def token_estimate(*texts: Column) -> Column:
    return F.ceil(sum((F.length(F.coalesce(t, F.lit(""))) for t in texts[1:]), F.length(F.coalesce(texts[0], F.lit("")))) / 4)


def terms(text: Column) -> Column:
    """Distinct lower-case words of more than two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda x: F.length(x) > 2))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(1000) * F.pow(F.lit(2), attempt), F.lit(16000)).cast("bigint")


def rolling_checksum(text: Column) -> Column:
    """A 32-bit checksum h * 31 + c over the characters, in base 36."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    wrap = F.lit(1 << 32).cast("bigint")
    h = F.aggregate(chars, F.lit(0).cast("bigint"), lambda a, c: F.pmod(a * 31 + F.ascii(c), wrap))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def redact_keys(text: Column) -> Column:
    """Values behind secret-named keys in a JSON or key=value text."""
    return F.regexp_replace(text, r'(?i)("?(?:password|secret|token|api_?key|authorization)"?\s*[:=]\s*)("[^"]*"|[^\s,}]+)', "$1[REDACTED]")


def render(template: Column, values: dict[str, Column]) -> Column:
    """``{key}`` replaced by its value, an empty text for null."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return template
