"""Imports, exports and top-level symbols of TypeScript and JavaScript texts, resolution of import paths, and the graph they make."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.runtime import materialize, release, ship, union_all

#: Endings tried for an import without one, and names of a folder's main file, in order.
SUPPORTED = (".ts", ".tsx", ".js", ".jsx")
INDEX_NAMES = ("index.ts", "index.tsx", "index.js", "index.jsx")
#: Kinds of nodes by kind of symbol.
NODE_TYPES = {"FUNCTION": "FUNCTION", "CLASS": "CLASS", "INTERFACE": "INTERFACE", "ENUM": "ENUM", "TYPE_ALIAS": "TYPE_ALIAS", "VARIABLE": "VARIABLE"}
#: How long a chain of re-exports is followed.
MAX_RE_EXPORTS = 5
_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[A-Za-z_$][\w$]*|\d[\w.]*|=>|\S", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_DECLARES = {"function": "FUNCTION", "class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "type": "TYPE_ALIAS"}
ITEM = "item string, name string, source string, symbol_type string, exported boolean, is_async boolean, is_default boolean, is_namespace boolean, line_no int, imported string"


def _tokens(text: str) -> list[tuple[str, int, bool]]:
    """(token, line, first on its line), comments left out."""
    out: list[tuple[str, int, bool]] = []
    i, line, last_line = 0, 1, 0
    while m := _TOKEN.search(text, i):
        line += text.count("\n", i, m.start())
        x = m.group()
        if x == "/" and (not out or out[-1][0][-1] in "(=,:;!&|?{}[+-*%<>~^" or out[-1][0] in ("return", "typeof", "case", "in", "of")) and (r := _REGEX.match(text, m.start())):
            m, x = r, r.group()
        if not x.startswith(("//", "/*")):
            out.append((x, line, line != last_line))
            last_line = line + x.count("\n")
        line += x.count("\n")
        i = m.end()
    return out


def _row(item: str, name: str | None, source: str | None, kind: str | None, line: int, exported: bool = False, is_async: bool = False, default: bool = False, namespace: bool = False, imported: str | None = None) -> tuple:
    return item, name, source, kind, exported, is_async, default, namespace, line, imported


def _literal(x: str) -> str | None:
    return x[1:-1] if x[:1] in "\"'" and len(x) >= 2 else None


def _is_name(x: str) -> bool:
    return bool(re.match(r"[A-Za-z_$]", x))


def extract(text: str | None) -> list[tuple]:
    """Rows of ITEM for a text's own imports, exports and declarations; nested ones don't count.

    ``import`` rows: one per default, namespace or named binding, one without a
    name for an import for its effects.  ``export`` rows name what others may
    import; ``* from "x"`` stands for all of x, ``(default)`` for a value without
    a name.  ``symbol`` rows are declarations.  Broken texts give what can be read.
    """
    t = _tokens(text or "")
    out, i, depth, n = [], 0, 0, len(t)

    def word(k: int) -> str:
        return t[k][0] if k < n else ""

    def names_in_braces(k: int) -> tuple[list[tuple[str, str]], int]:
        """[(own name, name given)] and the place behind the closing brace."""
        got, k = [], k + 1
        while k < n and word(k) != "}":
            x = word(k)
            if x == "type" and _is_name(word(k + 1)) and word(k + 1) != "as":
                k += 1
                x = word(k)
            if _is_name(x):
                given = word(k + 2) if word(k + 1) == "as" else x
                got.append((x, given))
                k += 2 if word(k + 1) == "as" else 0
            k += 1
        return got, k + 1

    while i < n:
        x, line, fresh = t[i]
        if x in "([{":
            depth += 1
        elif x in ")]}":
            depth = max(0, depth - 1)
        if depth or not (fresh or i == 0 or t[i - 1][0] in (";", "}")) or not _is_name(x):
            i += 1
            continue
        if x == "import" and word(i + 1) not in ("(", "."):
            k = i + 1
            if word(k) == "type" and word(k + 1) not in ("from", ","):
                k += 1
            if (s := _literal(word(k))) is not None:
                out.append(_row("import", None, s, None, line))
                i = k + 1
                continue
            found: list[tuple[str, bool, bool, str | None]] = []
            while k < n and word(k) != "from" and word(k) not in (";", "="):
                if word(k) == "{":
                    got, k = names_in_braces(k)
                    found += [(g, False, False, o) for o, g in got]
                elif word(k) == "*" and word(k + 1) == "as":
                    found.append((word(k + 2), False, True, None))
                    k += 3
                elif _is_name(word(k)):
                    found.append((word(k), True, False, "default"))
                    k += 1
                else:
                    k += 1
            s = _literal(word(k + 1)) if word(k) == "from" else None
            if s is not None:
                out += [_row("import", g, s, None, line, default=d, namespace=a, imported=o) for g, d, a, o in found]
                k += 2
            i = max(k, i + 1)
            continue
        exported = x == "export"
        k = i + 1 if exported else i
        if exported and word(k) == "type" and word(k + 1) in ("{", "*"):
            k += 1
        if exported and word(k) == "{":
            got, k = names_in_braces(k)
            s = _literal(word(k + 1)) if word(k) == "from" else None
            out += [_row("export", g, s, "VARIABLE", line, True, imported=o) for o, g in got]
            if s is not None:
                out.append(_row("export", f'* from "{s}"', s, "MODULE", line, True))
                k += 2
            i = k
            continue
        if exported and word(k) == "*":
            k += 3 if word(k + 1) == "as" else 1
            s = _literal(word(k + 1)) if word(k) == "from" else None
            if s is not None:
                out.append(_row("export", f'* from "{s}"', s, "MODULE", line, True))
            i = k
            continue
        default = exported and word(k) == "default"
        k += default
        if exported and word(k) == "=" or default and word(k) not in ("function", "class", "async", "abstract", "interface"):
            out.append(_row("export", "(default)", None, "VARIABLE", line, True, default=True))
            i = k + 1
            continue
        later = False
        while word(k) in ("declare", "abstract", "async") and _is_name(word(k + 1)):
            later = later or word(k) == "async"
            k += 1
        w = word(k)
        if w == "const" and word(k + 1) == "enum":
            k, w = k + 1, "enum"
        if w in _DECLARES:
            at = k + 2 if w == "function" and word(k + 1) == "*" else k + 1
            name = word(at)
            if _is_name(name) and name not in ("extends", "implements") and not (w == "type" and word(at + 1) not in ("=", "<")):
                out.append(_row("symbol", name, None, _DECLARES[w], line, exported, later, default))
                if exported:
                    out.append(_row("export", name, None, _DECLARES[w], line, True, default=default))
            elif default:
                out.append(_row("export", "(default)", None, _DECLARES[w], line, True, default=True))
            i = k + 1
            continue
        if w in ("const", "let", "var"):
            k += 1
            while _is_name(word(k)):
                name, at, inner = word(k), k, 0
                k += 1
                begin = None
                while k < n:
                    y, _, first = t[k]
                    if y in "([{":
                        inner += 1
                    elif y in ")]}":
                        inner -= 1
                        if inner < 0:
                            break
                    elif not inner and y == "=" and begin is None:
                        begin = k + 1
                    elif not inner and (y in (",", ";") or first and k > (begin or at) and _is_name(y) and t[k - 1][0] not in ("=>", "=", "+", "?", ":", "&", "|", ".")):
                        break
                    k += 1
                body = [z[0] for z in t[begin:k]] if begin else []
                later = body[:1] == ["async"]
                head = body[1:] if later else body
                made = head[:1] == ["function"] or head[1:2] == ["=>"] or head[:1] in (["("], ["<"]) and _arrow(head)
                kind = "FUNCTION" if made else "VARIABLE"
                out.append(_row("symbol", name, None, kind, t[at][1], exported, later))
                if exported:
                    out.append(_row("export", name, None, "VARIABLE", t[at][1], True))
                if word(k) != ",":
                    break
                k += 1
            i = max(k, i + 1)
            continue
        i += 1
    return out


def _arrow(head: list[str]) -> bool:
    """Whether an initializer is one parenthesis, maybe with type parameters and a type, and an arrow behind it."""
    depth = 0
    for k, x in enumerate(head):
        if x in "([{":
            depth += 1
        elif x in ")]}":
            depth -= 1
            if not depth and x == ")":
                rest = head[k + 1 :]
                return rest[:1] == ["=>"] or rest[:1] == [":"] and "=>" in rest
        elif not depth and x not in ("<", ">", ",", "extends") and not _is_name(x):
            return False
    return False


def extract_items(files: DataFrame, text: str = "source_text") -> DataFrame:
    """(snapshot_id, file_path, *ITEM) of every TypeScript and JavaScript file; null and empty texts give nothing."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["snapshot_id", "file_path", *[c.split()[0] for c in ITEM.split(", ")]]
        for b in batches:
            rows = [(s, p, *r) for s, p, t in zip(b["snapshot_id"], b["file_path"], b["t"]) for r in extract(t)]
            yield pd.DataFrame(rows, columns=cols)

    known = F.lower("file_path").rlike(r"\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$")
    return files.where(known & (F.col(text) != "")).select("snapshot_id", "file_path", F.col(text).alias("t")).mapInPandas(run, f"snapshot_id string, file_path string, {ITEM}")


def joined_path(folder: Column, path: Column) -> Column:
    """``path`` seen from ``folder``, with its ``.`` and ``..`` taken out; what climbs over the root stays there."""
    parts = F.filter(F.split(F.concat_ws("/", folder, path), "/"), lambda x: (x != "") & (x != "."))
    none = F.array().cast("array<string>")
    walked = F.aggregate(parts, none, lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.array_join(walked, "/")


def candidates(path: Column) -> Column:
    """Files an import may mean, best first."""
    return F.array(path, *[F.concat(path, F.lit(e)) for e in SUPPORTED], *[F.concat(path, F.lit("/" + x)) for x in INDEX_NAMES])


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: dict[str, list[str]] | None = None, base: str = ".") -> DataFrame:
    """(snapshot_id, file_path, source, resolved_path, is_external, reason): each distinct import of a file once.

    ``imports``: (snapshot_id, file_path, source); ``files``: (snapshot_id,
    file_path).  Relative paths are seen from the importing file; others that
    begin with ``/`` or ``@`` from the root, then through ``aliases`` (patterns
    with one ``*``), each target of which is tried in order; the rest is
    external.  Of several files that fit the first candidate counts, letter case
    aside where nothing else fits for the path as it is written.
    """
    want = imports.where(F.col("source").isNotNull()).select("snapshot_id", "file_path", "source").distinct()
    src = F.regexp_replace("source", r"\\", "/")
    folder = F.regexp_replace(F.when(F.instr("file_path", "/") == 0, "").otherwise(F.col("file_path")), "/[^/]*$", "")
    relative = src.startswith(".")
    rooted = src.startswith("/") | src.startswith("@")
    tries = [F.when(relative, joined_path(folder, src)).when(rooted, F.regexp_replace(src, "^/", ""))]
    for pattern, targets in (aliases or {}).items():
        rule = "^" + re.escape(pattern).replace(r"\*", "(.+)") + "$"
        for target in targets:
            at = F.regexp_replace(src, rule, re.sub(r"([$\\])", r"\\\1", target).replace("*", "$1")) if "*" in pattern else F.lit(target)
            tries.append(F.when(rooted & src.rlike(rule), joined_path(F.lit(base), at)))
    ways = F.flatten(F.transform(F.filter(F.array(*tries), lambda x: x.isNotNull()), lambda p: candidates(p)))
    spread = want.select("snapshot_id", "file_path", "source", F.posexplode(ways).alias("at", "path"))
    have = files.select("snapshot_id", F.col("file_path").alias("resolved_path"), F.lower("file_path").alias("low")).distinct()
    met = spread.withColumn("low", F.lower("path")).join(have, ["snapshot_id", "low"])
    # a file spelled as written is better than one that differs in case; only the written path itself may differ in case
    fits = met.where((F.col("path") == F.col("resolved_path")) | (F.pmod(F.col("at"), F.lit(1 + len(SUPPORTED) + len(INDEX_NAMES))) == 0))
    best = fits.groupBy("snapshot_id", "file_path", "source").agg(F.min(F.struct("at", (F.col("path") != F.col("resolved_path")).alias("other"), "resolved_path"))["resolved_path"].alias("resolved_path"))
    out = want.join(best, ["snapshot_id", "file_path", "source"], "left")
    unmet = F.col("resolved_path").isNull()
    external = unmet & ~relative & ~src.startswith("/")
    return out.select("snapshot_id", "file_path", "source", "resolved_path", external.alias("is_external"), F.when(unmet & ~external, F.concat(F.lit('Could not resolve "'), "source", F.lit('" from "'), "file_path", F.lit('"'))).alias("reason"))


def symbol_owners(imports: DataFrame, exports: DataFrame, resolved: DataFrame, max_depth: int = MAX_RE_EXPORTS) -> DataFrame:
    """(snapshot_id, file_path, name, owner, hops): the file that declares each imported name, by the name it has where it is imported.

    Named re-exports and ``export *`` are followed through ``resolved``, at most
    ``max_depth`` of them; the nearest owner counts, the smallest of equals.  A
    name that no chain leads to an owner has none.
    """
    key = ["snapshot_id", "file_path", "source"]
    paths = resolved.where(F.col("resolved_path").isNotNull()).select(*key, "resolved_path")
    own = exports.where(F.col("source").isNull()).select("snapshot_id", F.col("file_path").alias("at"), F.when(F.col("is_default"), "(default)").otherwise(F.col("name")).alias("name")).distinct()
    on = exports.where(F.col("source").isNotNull()).join(paths, key)
    every = F.col("symbol_type") == "MODULE"
    inner = F.when(F.col("imported") == "default", "(default)").otherwise(F.coalesce("imported", "name"))
    named = on.where(~every).select("snapshot_id", F.col("file_path").alias("at"), "name", F.col("resolved_path").alias("to"), inner.alias("next")).distinct()
    listed = on.where(~every).select("snapshot_id", "file_path", "source").distinct()
    # the marker beside a list of names stands for the list, not for all of the module
    star = on.where(every).join(listed, key, "left_anti").select("snapshot_id", F.col("file_path").alias("at"), F.col("resolved_path").alias("to")).distinct()
    begun = imports.where(F.col("name").isNotNull() & ~F.col("is_namespace")).join(paths, key)
    front = materialize(begun.select("snapshot_id", "file_path", F.col("name").alias("as_name"), F.when(F.col("is_default") | (F.col("imported") == "default"), "(default)").otherwise(F.coalesce("imported", "name")).alias("name"), F.col("resolved_path").alias("at"), F.lit(0).alias("hops")).distinct(), "front")
    found = []
    for hop in range(max_depth + 1):
        found.append(front.join(own, ["snapshot_id", "at", "name"], "left_semi"))
        if hop == max_depth:
            break
        left = front.join(own, ["snapshot_id", "at", "name"], "left_anti")
        cols = ["snapshot_id", "file_path", "as_name", F.col("to").alias("at"), F.lit(hop + 1).alias("hops")]
        front = materialize(left.join(named, ["snapshot_id", "at", "name"]).select(*cols, F.col("next").alias("name")).unionByName(left.join(star, ["snapshot_id", "at"]).select(*cols, "name")).distinct(), "front")
        if front.isEmpty():
            release(front)
            break
    every_way = union_all(found)
    return every_way.groupBy("snapshot_id", "file_path", F.col("as_name").alias("name")).agg(F.min(F.struct("hops", "at")).alias("m")).select("snapshot_id", "file_path", "name", F.col("m.at").alias("owner"), F.col("m.hops").alias("hops"))


def _id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 24)


def build_graph(files: DataFrame, items: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed files: FILE and symbol nodes; CONTAINS, EXPORTS, IMPORTS and DEPENDS_ON edges.

    ``files``: (snapshot_id, file_path, file_hash, language).  Ids follow from
    snapshot, path, kind and name, so a graph built twice is the same; of equal
    declarations one node stays.  IMPORTS joins files (weight 1 if the file is
    found by its path), DEPENDS_ON counts the names that come from the other file.
    """
    file_id = _id(F.col("snapshot_id"), F.lit("FILE"), F.col("file_path"))
    f = files.select("snapshot_id", "file_path", "file_hash", "language").groupBy("snapshot_id", "file_path").agg(F.max("file_hash").alias("file_hash"), F.max("language").alias("language"))
    file_nodes = f.select(file_id.alias("id"), "snapshot_id", "file_path", "file_hash", F.lit("FILE").alias("node_type"), F.lit(None).cast("string").alias("symbol_name"), "language")
    sym = items.where("item = 'symbol'").groupBy("snapshot_id", "file_path", "symbol_type", "name").agg(F.max("exported").alias("exported"))
    sym = sym.join(f, ["snapshot_id", "file_path"]).withColumn("id", _id(F.col("snapshot_id"), F.col("symbol_type"), F.col("file_path"), F.col("name")))
    sym_nodes = sym.select("id", "snapshot_id", "file_path", "file_hash", F.col("symbol_type").alias("node_type"), F.col("name").alias("symbol_name"), "language")
    own = sym.select("snapshot_id", file_id.alias("src"), F.col("id").alias("dst"), "exported")
    contains = own.select("snapshot_id", "src", "dst", F.lit("CONTAINS").alias("edge_type"), F.lit(1.0).alias("weight"))
    exports = own.where("exported").select("snapshot_id", "src", "dst", F.lit("EXPORTS").alias("edge_type"), F.lit(1.0).alias("weight"))
    to = _id(F.col("snapshot_id"), F.lit("FILE"), F.col("resolved_path"))
    met = resolved.where(F.col("resolved_path").isNotNull() & (F.col("resolved_path") != F.col("file_path")))
    imports = met.select("snapshot_id", file_id.alias("src"), to.alias("dst"), F.lit("IMPORTS").alias("edge_type"), F.lit(1.0).alias("weight")).distinct()
    names = items.where("item = 'import' AND name IS NOT NULL").join(met, ["snapshot_id", "file_path", "source"])
    depends = names.groupBy("snapshot_id", file_id.alias("src"), to.alias("dst")).agg(F.count_distinct("name").cast("double").alias("weight")).select("snapshot_id", "src", "dst", F.lit("DEPENDS_ON").alias("edge_type"), "weight")
    edges = union_all([contains, exports, imports, depends])
    edges = edges.select(_id(F.col("snapshot_id"), F.col("src"), F.col("dst"), F.col("edge_type")).alias("id"), "snapshot_id", "src", "dst", "edge_type", "weight")
    return file_nodes.unionByName(sym_nodes), edges
