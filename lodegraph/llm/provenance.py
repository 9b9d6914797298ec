"""Generated, minified, vendored and data files, by belief propagation over directory trees.

Every file has evidence of its own: remarks of generators, repeated numbered
declarations, the shape of minified text, licence banners, likeness to known
third-party files, the share of embedded data.  Directories have evidence in
their names.  Beliefs over the labels flow from files up to their directories
and on to the root, and back down, so that parents and siblings speak for a file
that says little itself.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lodegraph.runtime import hot_keys, join_unique, materialize, ship, union_all

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: Compatibility of a child's label with its parent directory's, by (child, parent); rows in the order of LABELS.
SAME = 0.80
#: Beyond so many shingles of reference files they are joined by shuffle rather than sent to every task.
MAX_REFERENCE_SHINGLES = 5_000_000
SHINGLE = 5
SIMILAR = 0.8

#: What generators write about their output, in a comment.
GENERATED_REMARK = re.compile(
    r"(?im)^\s*(?://|#|--|;|\*|/\*+|<!--|%)[^\n]*(?:@generated\b(?! by hand)|\bcode generated by\b|\b(?:auto(?:matically)?[- ]?|machine[- ])(?:generated|written|created|made)\b|\bgenerated (?:by|from|on|at|with|using|file|code,? do not)\b"
    r"|\bthis (?:file|code|module) (?:is|was|has been) (?:auto\w*[- ])?generated\b|\b(?:written|produced|created|emitted|compiled|built) by (?:the )?[\w.-]*(?:gen|compiler|generator|tool|codegen)\b|\bdo not (?:edit|modify|change|touch)\b[^\n]{0,40}(?:generat|overwrit|manual|by hand|hand)|\bgenerated\b[^\n]{0,60}\bdo not (?:edit|modify)|\bhand edits? (?:are|will be|get) (?:overwritten|lost)|\bchanges? (?:made here )?(?:are|will be) (?:overwritten|lost))"
)
#: Remarks that speak of generation but not of this file.
MAINTAINED = re.compile(r"(?i)by hand|hand-?written|maintained|output of this|this module generates|generates? the|not generated")
#: Of these, what speaks of the whole file even between lines of code.
WHOLE_FILE = re.compile(
    r"(?i)^\s*(?://+|#+|--|;+|\*|/\*+|<!--|%+)[\s!*]*(?:@generated\b(?! by hand)|code generated\b[^\n]*\bdo not (?:edit|modify)|th(?:is|e) (?:whole |entire )?(?:file|module) (?:is|was|has been) (?:auto\w*[- ]|machine[- ])?generated\b"
    r"|(?:auto(?:matically)?[- ]?|machine[- ])?generated (?:file|code)\b[^\n]*\bdo not (?:edit|modify)|(?:auto(?:matically)?[- ]?|machine[- ])generated\b[^\n]*\bdo not (?:edit|modify))"
)
PART = re.compile(r"(?i)\b(?:section|block|region|part|below|above|begin|end|function|method|class|table|list)\b")
GENERATED_PATH = re.compile(r"(?i)(?:[._-](?:pb|gen|generated|g|designer|pb2|pb2_grpc|grpc|auto|autogen|stubs?)\.[a-z]+$|_pb2(?:_grpc)?\.pyi?$|_pb\.(?:js|ts|go)$|\.d\.[mc]?ts$|(?:^|/)(?:package-lock\.json|[\w.-]*\.lock(?:\.json)?|yarn\.lock|pnpm-lock\.yaml|composer\.lock|cargo\.lock|poetry\.lock|go\.sum|npm-shrinkwrap\.json)$|/__generated__/|/generated/)")
LOCK_TEXT = re.compile(r'"lockfileVersion"|"integrity": "sha\d+-|^# yarn lockfile|^\[\[package\]\]', re.M)
MINIFIED_PATH = re.compile(r"(?i)(?:[.-]min\.[mc]?js$|[.-]bundle\.[mc]?js$|\.chunk\.js$|-[0-9a-f]{8,}\.[mc]?js$)")
BANNER = re.compile(r"(?i)\bcopyright\b[^\n]{0,80}|\(c\) the [\w -]+ authors|@licen[sc]e\b|released under the \w+|imported (?:unmodified )?from|\bvendored from\b|\bupstream\b[^\n]{0,40}\b(?:version|release|commit|source)\b|https?://[\w./-]+\s*\n[^\n]*copyright")
THIRD_PARTY = re.compile(r"(?i)\(c\) the|imported|unmodified|vendored|contributors|released under|upstream")
#: A notice that is one even between lines of code.
NOTICE = re.compile(r"(?i)\bcopyright\s+(?:\(c\)|©|\d{4})|\(c\) the [\w -]+ authors|@licen[sc]e\b|\bvendored from\b")
CONTAINER = re.compile(r"(?i)^(?:node_modules|bower_components|vendor|vendored|third[_-]?party|external|externals|_vendor|jspm_packages|site-packages|deps|pods)$")
DIGIT = re.compile(r"\d")
NUMBERED = re.compile(r"\b([A-Za-z_][A-Za-z_]*?)(\d+)([A-Za-z_]*)\b")
TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d+(?:\.\d+)?")
COMMENT = re.compile(r"/\*.*?\*/|(?<![:'\"\w])//[^\n]*|^\s*#[^\n]*|\s#\s[^\n]*", re.S | re.M)
DATA = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{80,}|(?:0x[0-9a-fA-F]{2}[,\s]+){12,}|(?<!\d)(?:-?\d+(?:\.\d+)?[,\s\[\]]+){24,}|(?:\\x[0-9a-fA-F]{2}){16,}|(?:[MLHVCSQTAZ]-?\d+(?:\.\d+)?[ ,]-?\d+(?:\.\d+)?[ ,]?){8,}")
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_SCRIPT = r"(?P<c>/\*.*?\*/|//[^\n]*)|\"\"\"(?:[^\\]|\\.)*?\"\"\"|" + _QUOTED
#: Comments, and the strings that may hold what only looks like one, by language.
SCANS = {
    "js": re.compile(_SCRIPT + r"|`(?:[^`\\]|\\.)*`|(?<=[=(,:;!&|?{}\[+\n])[ \t]*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/", re.S),
    "c": re.compile(_SCRIPT + "|`[^`]*`", re.S),
    "py": re.compile(r"(?P<c>#[^\n]*)|(?P<q>\"\"\"|\'\'\')(?:[^\\]|\\.)*?(?P=q)|" + _QUOTED, re.S),
    "": re.compile(r"(?P<c>^[ \t]*(?:/\*.*?\*/|<!--.*?-->|(?://|#|--|;|\*|%)[^\n]*))", re.S | re.M),
}
SCANNED = {**dict.fromkeys("js jsx mjs cjs ts tsx mts cts".split(), "js"), **dict.fromkeys("go java c h cc cpp hpp cs kt scala swift rs css scss less proto".split(), "c"), "py": "py", "pyi": "py"}
PREAMBLE = re.compile(r"(?i)[\s;]*(?:['\"]use (?:strict|client|server)['\"];?|package [\w.]+;?|<\?php|<\?xml[^>]*>|<!doctype[^>]*>)?[\s;]*")
ROWS = re.compile(r"\[\s*(?:\"[^\"\n]*\"|'[^'\n]*'|-?[\d.]+)(?:\s*,\s*(?:\"[^\"\n]*\"|'[^'\n]*'|-?[\d.]+))+\s*\]")


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./+)+", "")


def bare(text: str) -> str:
    """A text without its comments."""
    return COMMENT.sub(" ", text)


def shingles(text: str, stripped: str | None = None) -> np.ndarray:
    """Distinct hashes of every five words of a text without its comments and layout; of all words if there are fewer."""
    words = TOKEN.findall(bare(text) if stripped is None else stripped)
    if not words:
        return np.empty(0, np.int64)
    hashed: dict[str, int] = {}
    codes = np.fromiter((hashed.get(w) or hashed.setdefault(w, xxhash.xxh64_intdigest(w) | 1) for w in words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    h = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        h = (h ^ codes[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


#: A text of fewer shingles than this is too short to be told by its likeness.
LEAST_SHINGLES = 20


#: What runs of numbers, bytes and coordinates are made of; the shortest run of DATA is so long.
ZONE = re.compile(r"[\dA-Fa-fxXMLHVSQTZ,\s\[\]\\.-]{32,}")
LONG_WORD = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{80,}")


def _zones(text: str) -> list[tuple[int, int]]:
    """Stretches, in order and apart, outside of which there is no DATA."""
    spans = [m.span() for m in ZONE.finditer(text)]
    if max(map(len, text.split()), default=0) >= 80:
        spans = sorted(spans + [m.span() for m in LONG_WORD.finditer(text)])
    out: list[tuple[int, int]] = []
    for a, z in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def data_share(text: str) -> float:
    """Share of the text that is embedded data rather than code."""
    covered = sum(m.end() - m.start() for a, z in _zones(text) for m in DATA.finditer(text, a, z))
    rows = [m.end() - m.start() for m in ROWS.finditer(text)]
    if len(rows) >= 12:
        covered = max(covered, sum(rows))
    return min(1.0, covered / max(1, len(text)))


def repetition(stripped: str) -> float:
    """Share of lines, of a text without comments, that are the same as others but for a number in their names."""
    lines = [ln.strip() for ln in stripped.split("\n")]
    lines = [ln for ln in lines if len(ln) > 3]
    if len(lines) < 4:
        return 0.0
    shapes: dict[str, set[str]] = {}
    keys = []
    for ln in lines:
        if not DIGIT.search(ln):
            keys.append((ln, False))
            continue
        nums = [m.group(2) for m in NUMBERED.finditer(ln)]
        key = NUMBERED.sub(r"\1#\3", ln)
        keys.append((key, bool(nums)))
        if nums:
            shapes.setdefault(re.sub(r"\b\d+\b", "#", key), set()).add(",".join(nums))
    hit = sum(1 for k, n in keys if n and len(shapes.get(re.sub(r"\b\d+\b", "#", k), ())) >= 2)
    return hit / len(lines)


def dense(text: str) -> bool:
    """The look of minified text: long lines or short names, and hardly any white space."""
    body = re.sub(r"/\*.*?\*/|^//[^\n]*", "", text, flags=re.S | re.M).strip()
    if len(body) < 200:
        return False
    body = re.sub(r"'[^'\n]*'|\"[^\"\n]*\"|`[^`]*`", "S", body)
    if not body or len(body) / (body.count("\n") + 1) <= 60:
        return False
    white = 1 - sum(map(len, body.split())) / len(body)
    names = re.findall(r"[A-Za-z_$][\w$]*", body)
    short = sum(len(x) <= 4 for x in names) / max(1, len(names))
    code = sum(map(body.count, ";(){}=")) / len(body)
    return white < 0.09 and short > 0.6 and code > 0.12


def comments(path: str, text: str) -> list[tuple[bool, str]]:
    """(outer, text) of each run of comments that begin their lines; outer: ahead of all code or behind it.

    Every line of a text starts with a comment's mark; strings hold none.
    """
    scan = SCANS[SCANNED.get(path.rpartition(".")[2].lower(), "")]
    runs: list[list[int]] = []
    first, last, at = len(text), -1, 0
    for m in scan.finditer(text):
        gap = text[at : m.start()]
        if m.lastgroup != "c":
            gap = text[at : m.end()]
        if gap.strip() and not (last < 0 and PREAMBLE.fullmatch(gap)):
            first = min(first, m.start())
            last = len(runs)
        at = m.end()
        if m.lastgroup != "c" or text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
            continue
        if runs and last < len(runs) and not text[runs[-1][1] : m.start()].strip():
            runs[-1][1] = m.end()
        else:
            runs.append([m.start(), m.end()])
    if text[at:].strip():
        last = len(runs)
    out = []
    for i, (a, b) in enumerate(runs):
        lines = text[a:b].split("\n")
        out.append((a < first or i >= last, "\n".join(x if re.match(r"\s*(?://|#|--|;|\*|/\*|<!--|%)", x) else "* " + x for x in lines)))
    return out


def _locked(text: str) -> bool:
    return bool(LOCK_TEXT.search(text))


def evidence(path: str, text: str | None, likeness: float, stripped: str | None = None) -> np.ndarray:
    """Likelihood of what is seen of a file, by label; ``stripped``: the text without comments, if it is at hand."""
    e = np.array([1.0, 0.02, 0.02, 0.8, 0.02])  # third-party code looks like any other
    t = text or ""
    head = "\n".join(t[:4000].split("\n")[:12])
    said = comments(path, t) if t else []
    outer = "\n".join(c for o, c in said if o)
    remark = any(not MAINTAINED.search(m.group()) for m in GENERATED_REMARK.finditer(head + "\n" + outer))
    remark = remark or any((m := WHOLE_FILE.match(x)) and not MAINTAINED.search(m.group()) and not PART.search(x) for _, c in said for x in c.split("\n"))
    lower = path.lower()
    code = not lower.endswith((".json", ".yaml", ".yml", ".md", ".env", ".sh", ".txt"))
    rep = repetition(bare(t) if stripped is None else stripped) if t else 0.0
    if remark:
        e[1] *= 3e4
    if GENERATED_PATH.search(path) and (rep > 0.2 or remark or _locked(t) or not t):
        e[1] *= 3e4
    if t.count("integrity") >= 1 and "lockfileVersion" in t and _locked(t):
        e[1] *= 3e4
    if code and rep > 0.5 and t.count("\n") > 5:
        e[1] *= 3e4 if rep > 0.65 else 300
    if lower.endswith((".js", ".mjs", ".cjs", ".ts", ".mts", ".css")) and dense(t):
        e[2] *= 3e5
    elif MINIFIED_PATH.search(path) and t and len(t) / (t.count("\n") + 1) > 120:
        e[2] *= 3e4
    if code and t:
        share = data_share(t)
        if share > 0.6 and len(t) > 400:
            e[4] *= 3e5
        elif share > 0.4 and len(t) > 1000:
            e[4] *= 3e3
    if likeness >= SIMILAR:
        e[3] *= 1e6
    elif likeness >= 0.6:
        e[3] *= 3e3  # patched
    notices = [c for c in [head, *(c for o, c in said if o or NOTICE.search(c))] if BANNER.search(c)] if code else []
    if any(THIRD_PARTY.search(c) for c in notices):
        e[3] *= 3e4
    elif notices:
        e[3] *= 3
    return e / e.sum()


def _messages(belief: Column) -> Column:
    """What a child's belief says, as logarithms, about its parent's label; and the other way round."""
    other = (1 - SAME) / (len(LABELS) - 1)
    return F.transform(belief, lambda b: F.log(F.lit(other) * F.aggregate(belief, F.lit(0.0), lambda x, y: x + y) + F.lit(SAME - other) * b))


def _normal(logs: Column) -> Column:
    return F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _sum(column: str) -> Column:
    """Arrays of one length added place by place."""
    return F.array(*[F.sum(F.col(column)[i]) for i in range(len(LABELS))])


def directory_prior(path: Column, level: Column) -> Column:
    """Log-evidence of a directory's name: a container of third-party code near the project's root, or its library folder."""
    parts = F.split(path, "/")
    own, up = F.element_at(parts, -1), F.element_at(parts, F.greatest(level - 1, F.lit(1)))
    strong = own.rlike(CONTAINER.pattern)
    library = up.rlike(CONTAINER.pattern) & (level > 2)
    before = F.slice(parts, F.lit(3), F.greatest(level - F.when(strong, 3).otherwise(4), F.lit(0)))  # between the project and the container
    inside_source = F.exists(before, lambda x: x.isin("src", "packages", "app"))
    third = F.when((strong | library) & ~inside_source, F.lit(7.0)).when(own.rlike(r"(?i)^(node_modules|bower_components|site-packages)$"), F.lit(7.0)).otherwise(F.lit(-6.0))
    made = F.when(own.rlike(r"(?i)^(generated|__generated__|gen)$"), F.lit(0.5)).otherwise(F.lit(-1.5))
    packed = F.when(own.rlike(r"(?i)^(dist|min)$"), F.lit(0.0)).otherwise(F.lit(-1.5))
    return F.array(F.lit(0.0), made, packed, third, F.lit(-1.5))


def reference_likeness(files: DataFrame, upstream: DataFrame, key: str, text: str) -> DataFrame:
    """(key, likeness) by shuffle joins on shingles, for reference sets too large to send to every task."""

    def explode(name: str, col: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for k, t in zip(b["k"], b["t"]):
                    s = shingles(t)
                    yield pd.DataFrame({"k": [k] * len(s), "h": s, "n": [len(s)] * len(s)}).astype({"h": "int64", "n": "int64"})

        return run

    kind = dict(files.dtypes)[key]
    ship(files.sparkSession)
    a = files.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t") != "").mapInPandas(explode("a", text), f"k {kind}, h bigint, n bigint")
    b = upstream.select(F.monotonically_increasing_id().alias("k"), F.col("source_text").alias("t")).where(F.col("t") != "").mapInPandas(explode("b", text), "k bigint, h bigint, n bigint").select(F.col("k").alias("u"), "h", F.col("n").alias("m"))
    common = a.join(b, "h").groupBy("k", "u").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    best = common.where(F.col("n") >= LEAST_SHINGLES).groupBy("k").agg(F.max(F.col("c") / F.greatest("n", "m")).alias("likeness"))
    return best.withColumnRenamed("k", key)


_read: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _reference(mark: str, held: Broadcast) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes in order, their file, sizes of files) of the reference files' shingles; made once in a worker."""
    if mark not in _read:
        _read.clear()
        known = held.value
        hashes = np.concatenate([np.empty(0, np.int64), *known])
        owner = np.repeat(np.arange(len(known)), [len(x) for x in known])
        order = np.argsort(hashes, kind="stable")
        _read[mark] = hashes[order], owner[order], np.array([len(x) for x in known], np.int64)
    return _read[mark]


def _likeness(own: np.ndarray, hashes: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> float:
    """The greatest share of common shingles, relative to the larger of the two texts."""
    lo, hi = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
    n = hi - lo
    if not n.any():
        return 0.0
    at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    common = np.bincount(owner[at], minlength=len(sizes))
    return float((common / np.maximum(sizes, len(own))).max())


def file_evidence(files: DataFrame, upstream: DataFrame, key: str = "file_id", max_reference: int = MAX_REFERENCE_SHINGLES) -> DataFrame:
    """(key, tree, path, e): the likelihoods of what is seen of each file, by label."""
    spark = files.sparkSession
    ship(spark)
    kind = dict(files.dtypes)[key]
    words = upstream.agg(F.sum(F.length("source_text"))).first()[0] or 0
    rows = files.select(F.col(key).alias("k"), F.coalesce("snapshot_id", F.lit("")).alias("s"), normal_path(F.col("file_path")).alias("p"), F.col("source_text").alias("t"))
    fits = words <= max_reference * 4  # a word has four characters or more with its gap, so there are no more shingles than that
    if fits:
        known = [shingles(r[0]) for r in upstream.where(F.col("source_text").isNotNull()).select("source_text").collect()]
        held = spark.sparkContext.broadcast(known)
        rows, mark = rows.withColumn("l", F.lit(0.0)), uuid.uuid4().hex
    else:
        held, mark = None, ""
        rows = rows.join(reference_likeness(files, upstream, key, "source_text").withColumnRenamed(key, "k").withColumnRenamed("likeness", "l"), "k", "left").fillna(0.0, ["l"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, owner, sizes = _reference(mark, held) if held is not None else (None, None, None)
        for b in batches:
            out = []
            for k, tree, p, t, like in zip(b["k"], b["s"], b["p"], b["t"], b["l"]):
                stripped = bare(t) if t else ""
                if hashes is not None and t:
                    own = shingles(t, stripped)
                    like = _likeness(own, hashes, owner, sizes) if len(own) >= LEAST_SHINGLES else 0.0
                out.append((k, tree, p, evidence(p or "", t, like, stripped)))
            yield pd.DataFrame(out, columns=["k", "tree", "path", "e"])

    return rows.mapInPandas(scan, f"k {kind}, tree string, path string, e array<double>").withColumnRenamed("k", key)


def label_files(files: DataFrame, upstream: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, label, belief) for every file; ``label`` is one of LABELS.

    A tree is the directories of one snapshot.  Null paths lie in the root;
    null and empty texts have no evidence beyond their path.  Beliefs go up and
    down once, which is exact on trees, a round for each level there is.
    """
    ev = file_evidence(files, upstream, key)
    depth = F.size(F.split(F.coalesce("path", F.lit("")), "/")) - 1
    leaves = ev.withColumn("level", depth).withColumn("dir", F.concat_ws("/", F.col("tree"), F.array_join(F.slice(F.split(F.coalesce("path", F.lit("")), "/"), F.lit(1), F.col("level")), "/"))).withColumn("level", F.col("level") + 1)
    leaves = materialize(leaves.select(key, "dir", "level", "e"), "evidence")
    deepest = leaves.agg(F.max("level")).first()[0] or 0
    said = materialize(leaves.withColumn("m", _messages(F.col("e"))).groupBy("dir", "level").agg(_sum("m").alias("m")), "said")
    up = F.regexp_replace("dir", "/[^/]*$", "")
    levels: dict[int, DataFrame] = {}
    from_below: DataFrame | None = None
    for lv in range(deepest, 0, -1):  # the tree's id is level 1
        here = said.where(F.col("level") == lv).select("dir", "m")
        if from_below is not None:
            here = here.unionByName(from_below).groupBy("dir").agg(_sum("m").alias("m"))
        here = here.withColumn("l", _plus(F.col("m"), directory_prior(F.col("dir"), F.lit(lv)))).select("dir", _normal(F.col("l")).alias("b"))
        levels[lv] = materialize(here, f"up{lv}")
        from_below = levels[lv].select(up.alias("dir"), _messages(F.col("b")).alias("m")).groupBy("dir").agg(_sum("m").alias("m"))
    done: list[DataFrame] = []
    above: DataFrame | None = None
    for lv in range(1, deepest + 1):
        here = levels[lv]
        if above is not None:
            parent = above.select(F.col("dir").alias("up"), F.col("b").alias("pb"))
            here = materialize(_hear(here.withColumn("up", up).join(parent, "up"), "b").select("dir", "b"), f"down{lv}")
        above = here
        done.append(here)
    if not done:
        return leaves.select(key, F.lit(LABELS[0]).alias("label"), F.lit(1.0).alias("belief")).limit(0)
    beliefs = union_all(done).select("dir", F.col("b").alias("pb"))
    met = join_unique(leaves.select(key, "dir", F.col("e").alias("b")), beliefs, ["dir"], "inner", hot_keys(leaves, ["dir"]))
    final = _hear(met, "b")
    best = F.array_max("b")
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.array_position("b", best).cast("int"))  # a tie goes to the first
    return final.select(key, label.alias("label"), (best / F.aggregate("b", F.lit(0.0), lambda x, y: x + y)).alias("belief"))


def heard(own: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Beliefs of children (a row each) after they heard from their parents, less what they had told them."""
    other = (1 - SAME) / (len(LABELS) - 1)

    def said(b: np.ndarray) -> np.ndarray:
        return np.log(other * b.sum(1, keepdims=True) + (SAME - other) * b)

    def scaled(logs: np.ndarray) -> np.ndarray:
        return np.exp(logs - logs.max(1, keepdims=True))

    rest = scaled(np.log(parent + 1e-300) - said(own))
    return scaled(np.log(own + 1e-300) + said(rest))


@F.pandas_udf(ArrayType(DoubleType()))
def _heard(own: pd.Series, parent: pd.Series) -> pd.Series:
    return pd.Series(list(heard(np.vstack(own.to_numpy()), np.vstack(parent.to_numpy())))) if len(own) else pd.Series([], dtype=object)


def _hear(met: DataFrame, own: str) -> DataFrame:
    return met.withColumn(own, _heard(F.col(own), F.col("pb"))).drop("pb")
