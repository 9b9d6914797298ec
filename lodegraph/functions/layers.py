"""Layers of an architecture: what paths and imported frameworks say about a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules from paths to layers: name, layer, strength, priority, pattern.
LAYER_RULES = (
    ("api-routes", "API_LAYER", "HIGH", 10, r"/routes?/|\broutes?/|\bapi\b"),
    ("controllers", "API_LAYER", "HIGH", 20, r"/controllers?/|\.controller\."),
    ("service-layer", "SERVICE_LAYER", "HIGH", 30, r"/services?/|\.service\."),
    ("data-layer", "DATA_LAYER", "HIGH", 40, r"/repositories?/|/daos?/|/databases?/|/models?/"),
    ("domain-layer", "DOMAIN_LAYER", "HIGH", 50, r"/domain/|/entities?/|/aggregates?/"),
    ("infrastructure", "INFRASTRUCTURE", "HIGH", 60, r"/infrastructure/|/adapters?/|/providers?/"),
    ("ui-components", "UI_LAYER", "HIGH", 70, r"/components?/|/pages?/|/views?/|/ui/|\.(tsx|jsx)$"),
    ("shared-utility", "SHARED_UTILITY", "MEDIUM", 80, r"/utils?/|/helpers?/|/lib/|/shared/"),
    ("configuration", "CONFIGURATION", "HIGH", 90, r"/config/|\.config\.|\.env\."),
    ("testing", "TESTING", "HIGH", 100, r"\.(test|spec|e2e|integration)\.|/__tests__/|/__mocks__/|/fixtures?/"),
    ("build-system", "BUILD_SYSTEM", "MEDIUM", 110, r"/(build|dist|scripts?)/|\.dockerfile|\bDockerfile\b"),
    ("middleware", "INFRASTRUCTURE", "HIGH", 120, r"/middleware/|\.middleware\."),
    ("security", "SECURITY", "MEDIUM", 130, r"/auth/|/guards?/|/security/"),
    ("observability", "OBSERVABILITY", "MEDIUM", 140, r"/logging/|/monitoring/|/telemetry/|/tracing/"),
    ("migrations", "DATA_LAYER", "MEDIUM", 150, r"/migrations?/"),
    ("graphql", "API_LAYER", "MEDIUM", 160, r"/graphql/|/resolvers?/|/schemas?/"),
)
#: Layers of frameworks, by the name they are imported by.
FRAMEWORKS = {
    "express": "API_LAYER", "express-session": "API_LAYER", "hono": "API_LAYER", "@nestjs/core": "API_LAYER", "@nestjs/common": "API_LAYER", "fastify": "API_LAYER", "koa": "API_LAYER",
    "react": "UI_LAYER", "react-dom": "UI_LAYER", "vue": "UI_LAYER", "next/router": "UI_LAYER", "@angular/core": "UI_LAYER",
    "typeorm": "DATA_LAYER", "typeorm/browser": "DATA_LAYER", "@prisma/client": "DATA_LAYER", "prisma": "DATA_LAYER", "sequelize": "DATA_LAYER", "mongoose": "DATA_LAYER", "knex": "DATA_LAYER", "drizzle-orm": "DATA_LAYER",
    "winston": "OBSERVABILITY", "pino": "OBSERVABILITY", "log4js": "OBSERVABILITY", "@sentry/node": "OBSERVABILITY", "opentelemetry/api": "OBSERVABILITY",
    "jest": "TESTING", "vitest": "TESTING", "mocha": "TESTING", "cypress": "TESTING", "playwright": "TESTING",
    "jsonwebtoken": "SECURITY", "bcrypt": "SECURITY", "passport": "SECURITY", "helmet": "SECURITY",
}
#: Parts of paths that speak for infrastructure and for business.
INFRA_PATHS = ("/config/", "/middleware/", "/adapters?/", "/providers?/", "/infrastructure/", "/db/", "/databases?/", "/migrations?/", "/logger/", "/logging/", "/queue/", "/workers?/", "/transport/", "/gateways?/")
BUSINESS_PATHS = ("/domain/", "/services?/", "/orchestrators?/", "/use-cases?/", "/business/", "/workflows?/", "/state-machines?/", "/entities?/", "/aggregates?/", "/value-objects?/", "/validators?/", "/rules?/", "/policies?/")
#: Importance of layers where graphs are ranked, and where contexts are.
IMPORTANCE = {"DOMAIN_LAYER": 10, "SERVICE_LAYER": 8, "API_LAYER": 7, "DATA_LAYER": 6, "SHARED_UTILITY": 5, "INFRASTRUCTURE": 4, "UI_LAYER": 3, "CONFIGURATION": 2, "SECURITY": 2, "OBSERVABILITY": 2, "TESTING": 1, "BUILD_SYSTEM": 1, "UNKNOWN": 0}
CONTEXT_IMPORTANCE = {"API_LAYER": 10, "SERVICE_LAYER": 9, "DOMAIN_LAYER": 8, "DATA_LAYER": 7, "SECURITY": 6, "OBSERVABILITY": 5, "INFRASTRUCTURE": 4, "SHARED_UTILITY": 3, "CONFIGURATION": 2, "TESTING": 1, "BUILD_SYSTEM": 1, "UNKNOWN": 0}
STRENGTH = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def _table(table: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def layer(path: Column) -> Column:
    """The layer of the first rule, by priority, that fits; UNKNOWN if none does."""
    out = F.lit("UNKNOWN")
    for _, name, _, _, pattern in sorted(LAYER_RULES, key=lambda r: r[3], reverse=True):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def strength_of(path: Column, kind: Column) -> Column:
    """The greatest strength (3 to 1) of the rules that give a path this layer; 1 if none does."""
    fits = [F.when(path.rlike(p) & (kind == name), STRENGTH[s]).otherwise(1) for _, name, s, _, p in LAYER_RULES]
    return F.greatest(*fits)


def role(path: Column) -> Column:
    """The layer of greatest strength, of equals the first by priority."""
    out = F.lit("UNKNOWN")
    for _, name, _, _, pattern in sorted(LAYER_RULES, key=lambda r: (r[2] != "HIGH", r[3]), reverse=True):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def framework(source: Column) -> Column:
    """The layer of an imported module: by its whole name, else by a framework's name before ``/`` or ``-``; null for others."""
    out = F.lit(None).cast("string")
    for name, kind in reversed(FRAMEWORKS.items()):
        out = F.when(source.startswith(name + "/") | source.startswith(name + "-"), kind).otherwise(out)
    return F.coalesce(_table(FRAMEWORKS)[source], out)


def is_infrastructure(path: Column) -> Column:
    return path.rlike("|".join(INFRA_PATHS))


def is_business(path: Column) -> Column:
    return path.rlike("|".join(BUSINESS_PATHS))


def importance(kind: Column) -> Column:
    return F.coalesce(_table(IMPORTANCE)[kind], F.lit(0))


def context_importance(kind: Column) -> Column:
    return F.coalesce(_table(CONTEXT_IMPORTANCE)[kind], F.lit(0))


def ratio_strength(matched: Column, considered: Column) -> Column:
    """HIGH from four fifths on, MEDIUM from two fifths."""
    r = F.try_divide(matched, considered)
    return F.when(r >= 0.8, "HIGH").when(r >= 0.4, "MEDIUM").otherwise("LOW")
