"""Credentials embedded in source code: find them and redact them in place.

A keyword automaton marks the lines worth a look, issuer formats and literal
shapes select candidates on them, checksums and structure (a decodable token
header, a user:password pair, character statistics) decide.  Redaction replaces
every character by one of its own class, so lengths, quotes and columns stay.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodegraph.runtime import ship

#: Words that make a line worth a look, in lower case.
KEYWORDS = (
    "akia asia eyj ghp_ gho_ ghs_ ghu_ ghr_ github_pat_ glpat- sk- sk_live sk_test rk_live rk_test xoxb- xoxp- xoxa- xoxs- xoxr- xoxe hooks.slack "
    "aiza ya29. npm_ pypi- sg. shpat_ shpca_ shppa_ shpss_ dop_v1_ doo_v1_ dor_v1_ private key begin pgp "
    "api_key apikey api-key secret token passwd password passphrase pwd credential auth bearer basic signing "
    "access_key accesskey client_secret login conn dsn ://"
).split()
#: Names under which a value is a credential.
NAMED = re.compile(
    r"(?i)(?:api|access|signing|private|secret|auth|encryption|master|service|account|client|app|webhook|shared|storage)[_-]?key"
    r"|passw(?:or)?d|passphrase|pwd\b|pwd[_\d]|(?:^|[^a-z])pwd|[a-z]Pwd|secret|credential|token|auth(?!or)|login|bearer"
)
#: Names and remarks under which a random value is no credential.
PUBLIC = re.compile(
    r"(?i)digest|checksum|integrity|sha[-_]?(?:1|2|256|384|512)|md5|\bhash|hash\b|[a-z]Hash|commit|revision|\brev\b|uuid|guid|trace"
    r"|request_?id|correlation|fingerprint|etag|public|nonce|build_?id|span_?id|snapshot_?id|image|sourcemap|git\s"
)
#: What stands in a credential's place where there is none.
PLACEHOLDER = re.compile(
    r"(?i)^(?:your|my|the|some|an?|insert|enter|put|set)[-_ .]|^<.*>$|^\[.*\]$|change[-_ ]?(?:me|it)|replace[-_ ]?(?:me|with|this)?$|replace_me|placeholder|dummy|redacted"
    r"|^example|[-_]example$|-here$|_here$|^(?:x+|\*+|\.+|-+|_+|0+|1234567890?|abc123)$|^(?:none|null|nil|undefined|true|false|todo|tbd|test|secret|password|token|changeit)$|\*{4,}|x{6,}"
    r"|^ENC\[|^vault:|^\$ANSIBLE|^arn:|^kms:|^ssm:|^secretsmanager:|^op://|^env:|^file:|\$\{|\{\{|\$\(|%\(|<%|process\.env|os\.environ|getenv|^\$[A-Za-z_]|^%[A-Z_]+%$|^AQICAH|^-----BEGIN PUBLIC"
)
#: Names that end in these say that the value is a password, which may be short or a phrase.
PASSWORD_NAME = re.compile(r"(?i)(?:passw(?:or)?d|pass_?phrase|pwd|(?:^|[_.-])pass)[_\d]*$")
#: Words of labels, hints and messages about passwords.
MESSAGE = re.compile(
    r"(?i)\b(?:pass\s?(?:words?|phrases?|codes?|e)|passwort|kennwort|contraseña|senha|enter|type|your|please|must|should|can(?:not)?|invalid|wrong|incorrect|missing|empty|forgot(?:ten)?|reset|at least|at most|characters?|required|optional|change|confirm|repeat|again"
    r"|is|are|was|be|not|no|to|for|of|with|and|or|the|this|that|if|when|in|from|by|field|value|text|input|secret|key|code|login|user(?:name)?|email|account|label|sign)\b|%[sdv]|\$[\w{]"
)
TYPE_NAME = re.compile(r"(?i)^(?:u?int|float|utf|varchar|char|u|i|f|bit|arg|param|str|v|p|step|tab|page|input|field|test|pass|pwd|md|sha|base|ascii|latin)_?\d+$")
#: How the base64 of pictures, fonts, archives, programs and markup begins.
FILE_DATA = re.compile(r"iVBOR|/9j/|R0lGOD|d09G|AGFzbQ|H4sI|UEsD|JVBER|AAEAAA|PHN2Z|PD94b|PCFET|UklGR|SUQz|T1RUTw|Qk0|Qlpo|f0VMR|AAABAA")
UUID = re.compile(r"(?i)^\{?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\}?$")
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{16,}"
    r"|AIza[A-Za-z0-9_-]{35}"
    r"|[a-z][a-z0-9]{1,7}(?:[_-](?!sha)[a-z0-9]{2,10}){0,2}[_-](?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*[a-z])[A-Za-z0-9]{18,}(?![A-Za-z0-9+/=]))"
)
#: Whole formats of the issuers among the keywords; the groups name what proves a body.
FORMATS = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:"
    r"(?:(?:gh[pousr]|npm)_(?P<summed>[A-Za-z0-9]{36})"
    r"|github_pat_(?P<pat>[A-Za-z0-9]{22}_[A-Za-z0-9]{59})"
    r"|(?:shp(?:at|ca|pa|ss)_(?P<hex32>[0-9a-fA-F]{32})|do[opr]_v1_(?P<hex64>[0-9a-f]{64}))"
    r"|[sr]k_(?:live|test)_(?P<pay>[A-Za-z0-9]{16,})"
    r"|(?:AKIA|ASIA)(?P<aws>[A-Z0-9]{16}))(?![A-Za-z0-9_])"
    r"|(?:glpat-(?P<lab>[A-Za-z0-9_-]{20,}(?:\.[0-9a-z]{2}\.[0-9a-z]{9}|\.[0-9a-z]{9})?)"
    r"|sk-(?:(?:proj|svcacct|admin|ant|or|live|test)-)?(?P<sk>[A-Za-z0-9_-]{20,})"
    r"|xox(?:[abeoprs]|e\.xox[bp])-(?P<slack>(?:[0-9]+-)*[A-Za-z0-9-]{10,})"
    r"|AIza(?P<aiza>[A-Za-z0-9_-]{35})"
    r"|ya29\.(?P<ya>[A-Za-z0-9_-]{20,}(?:\.[A-Za-z0-9_-]+)*)"
    r"|pypi-(?P<pypi>AgE[A-Za-z0-9_-]{16,})"
    r"|SG\.(?P<grid>[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43})"
    r"|(?P<jwt>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]{16,}(?:\.[A-Za-z0-9_-]+){0,2}))(?![A-Za-z0-9_-])"
    r")|\bhooks\.slack\.com/(?:services|workflows|triggers)/(?P<hook>[TEBA][A-Z0-9]{6,}/[A-Za-z0-9]+/(?:[0-9]+/)?[A-Za-z0-9]{20,})(?![A-Za-z0-9])"
)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
PEM = re.compile(r"-----BEGIN (?!ENCRYPTED )(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: A line of a key's body: its base64, its headers or nothing, within quotes or behind a comment's mark.
PEM_LINE = re.compile(r"[\s\"'`+#*/;,\\-]*(?:[A-Za-z0-9+/=]{8,}|[A-Za-z-]+: [\w,. -]+)?(?:\\[nr])*[\s\"'`+,;)\\]*")
USERINFO = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]*://([^\s:/@'\"`<>]*):([^\s@/'\"`<>]+)@[\w\[\].-]+")
BASIC = re.compile(r"\b[Bb]asic\s+([A-Za-z0-9+/_-]{8,}={0,2})")
BEARER = re.compile(r"\b[Bb]earer\s+([^\s'\"`,;)]{8,})")
QUERY = re.compile(r"(?i)[?&](?:[a-z_]*token|[a-z_]*key|[a-z_]*secret|passw(?:or)?d|pwd|sig|auth)=([^&\s'\"`<>]+)")
FLAG = re.compile(r"(?i)(?<!\S)--?(?:[a-z-]*(?:password|passwd|token|secret|passphrase|api-?key|access-?key)|pass|pwd)[= ]+(['\"]?)([^\s'\"]+)\1")
USER_FLAG = re.compile(r"(?<!\S)(?:-u|--user)[= ]+(['\"]?)([^\s:'\"]+):([^\s'\"]+)\1")
PARTS = re.compile(r"(['\"`])([^'\"`\\\n]{3,})\1(?:\s*\+\s*(['\"`])([^'\"`\\\n]{2,})\3)+")
PIECE = re.compile(r"(['\"`])([^'\"`\\\n]*)\1")
LITERAL = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
NAME = re.compile(r"[A-Za-z_][\w.-]*")
BARE = re.compile(r"^\s*(?:(?://|#|--|;|\*|/\*|<!--)\s*)?(?:[\w ,']*[,:]\s+)?(?:export\s+|set\s+|-\s+)?[\"']?([A-Za-z_][\w.-]*)[\"']?\s*[:=]\s*([^\s'\"`,;{}()\[\]<>][^\s'\"`,;<>]*)\s*(?:[;,]|$|#|//|\*/|-->)")
REMARK = re.compile(r"(?://|#|/\*|\*|--)\s*(?:.*?[\s,:])?([A-Za-z_][\w.-]*)\s*(?:[:=]|\bis\b)?\s+(\S+)\s*(?:\*/|-->)?\s*$")
PASSWORD_SHAPE = re.compile(r"^(?=.{10,40}$)[A-Z][a-z]{2,}[-_!#$%&*+.@~^]?[A-Za-z][a-z]{2,}[-_!#$%&*+.@~^]?(?:\d{3,6}[-_!?#$%&*+.@~^]{0,2}|\d{1,2}[-_!?#$%&*+.@~^]{1,2})$")


def classes(v: str) -> int:
    return sum((any(c.islower() for c in v), any(c.isupper() for c in v), any(c.isdigit() for c in v), any(not c.isalnum() for c in v)))


def entropy(v: str) -> float:
    n = len(v)
    return -sum(k / n * math.log2(k / n) for k in Counter(v).values()) if n else 0.0


def random_looking(v: str) -> bool:
    """Characters that change class as often as chance has it; words, paths and identifiers don't."""
    if len(v) < 20 or not re.fullmatch(r"[A-Za-z0-9+/_.~-]+={0,2}", v):
        return False
    if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", v):
        return len(set(v)) >= 8 and not v.isdigit()
    if not (any(c.islower() for c in v) and any(c.isupper() for c in v)):
        return False
    return turns(v) >= (0.3 if any(c.isdigit() for c in v) else 0.38) and entropy(v) >= 3.5


def turns(v: str) -> float:
    """Share of neighbouring characters of different class: about a half by chance, a fifth in identifiers."""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in v.rstrip("=")]
    return sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, len(kinds) - 1)


def placeholder(v: str) -> bool:
    return not v or len(set(v)) <= 2 or not {c for c in v if c.isalnum()} - set("xX0") or bool(PLACEHOLDER.search(v)) or bool(UUID.match(v))


def token_header(v: str) -> bool:
    """A signed token's first part is base64 of a JSON object that names an algorithm."""
    head = v.split(".", 1)[0]
    try:
        said = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(said, dict) and "alg" in said


def basic_pair(v: str) -> bool:
    try:
        said = base64.b64decode(v + "=" * (-len(v) % 4), altchars=b"-_" if re.search(r"[-_]", v) else None).decode("utf-8")
    except (ValueError, binascii.Error, UnicodeDecodeError):
        return False
    user, colon, word = said.partition(":")
    return bool(colon and word) and said.isprintable() and not placeholder(word)


def issued(v: str) -> bool:
    if v.startswith("eyJ"):
        return token_header(v)
    body = re.split(r"[_-]", v)[-1]
    return not placeholder(v) and (v[:4] in ("AKIA", "ASIA", "AIza") or entropy(v) >= 3.5 and turns(body) >= (0.3 if any(c.isdigit() for c in body) else 0.38))


def checksum(body: str) -> str:
    """The last six characters of a token whose first thirty are ``body``: their CRC-32 in base 62."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out


def formatted(m: re.Match[str]) -> bool:
    """Whether the body of an issuer's format is real: its checksum or header says so, or else its characters."""
    kind, body = m.lastgroup or "", m.group(m.lastgroup or 0)
    if kind == "jwt":
        return token_header(body)
    if kind == "summed" and body[30:] == checksum(body[:30]):
        return True
    if placeholder(m.group()) or placeholder(body):
        return False
    if kind in ("hex32", "hex64"):
        return len(set(body.lower())) >= 8
    if kind in ("aws", "aiza"):
        return True
    if kind == "slack":
        return any(c.isdigit() for c in body) and entropy(body) >= 2.5
    mixed = any(c.islower() for c in body) and any(c.isupper() for c in body)
    return mixed and entropy(body) >= 3.2 and turns(body) >= 0.3


def usable(name: str, v: str, remark: str = "") -> bool:
    """Whether a literal ``v`` under ``name`` is a credential."""
    if placeholder(v) or any(c.isspace() for c in v) or len(v) < 8:
        return False
    m = FORMATS.match(v)
    if m and m.end() == len(v) and formatted(m):
        return True
    m = ISSUED.match(v)
    if m and m.end() == len(v):
        return issued(v)
    if re.match(r"(?i)(?:sha\d+|md5)[-:]", v):
        return False
    public = bool(PUBLIC.search(name) or PUBLIC.search(remark))
    named = bool(NAMED.search(name)) and not public
    if random_looking(v):
        return not public and (named or not FILE_DATA.match(v))
    if PASSWORD_SHAPE.match(v):
        return not public
    if not named or re.search(r"[()\[\]{}<>]|::|->|=>", v) or re.match(r"(?i)(?:https?|file|\.{0,2}/|@)", v):
        return False
    if re.fullmatch(r"[A-Za-z_$][\w$]*(?:[.:/-][A-Za-z_$][\w$]*)*", v) and not re.search(r"\d{3,}", v):
        return False  # an identifier, a path or words
    if re.fullmatch(r"[a-z]+(?:[-_.][a-z]+)*[-_.]?\d*|[A-Z]+(?:[-_.][A-Z]+)*[-_.]?\d*|[\d.,:/-]+", v):
        return False
    return classes(v) >= 3 or (len(v) >= 16 and classes(v) >= 2 and entropy(v) >= 3.2)


def spoken(name: str, v: str) -> bool:
    """Whether ``v``, short or with spaces, is a password: its name says so and it is no placeholder, word or message."""
    if not PASSWORD_NAME.search(name) or PUBLIC.search(name) or placeholder(v) or re.search(r"[()\[\]{}<>]|::|->|=>|://", v):
        return False
    words = v.split()
    if len(words) > 1:
        return not MESSAGE.search(v) and any(c.isalpha() for c in v)
    return v == v.strip() and 4 <= len(v) < 8 and any(c.isalpha() for c in v) and (bool(re.search(r"\d", v)) or classes(v) >= 3) and not TYPE_NAME.match(v)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in KEYWORDS:
        a.add_word(w, w)
    a.make_automaton()
    return a


_words: ahocorasick.Automaton | None = None


def _line_spans(line: str, keyed: bool) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the credential values on one line."""
    for m in ISSUED.finditer(line):
        if issued(m.group()):
            before = line[: m.start()].rstrip("'\"` =:(")
            name = (NAME.findall(before) or [""])[-1]
            if not (PUBLIC.search(name) and not NAMED.search(name)):
                yield m.start(), m.end(), "API_KEY"
    if keyed:
        for m in FORMATS.finditer(line):
            if formatted(m):
                a, b = m.span("hook") if m.lastgroup == "hook" else m.span()
                yield a, b, "API_KEY"
        for m in USERINFO.finditer(line):
            if not placeholder(m.group(2)) and "$" not in m.group(1)[:1] and not m.group(2).startswith(("$", "{", "%")):
                yield m.start(2), m.end(2), "PASSWORD"
        for m in BASIC.finditer(line):
            if basic_pair(m.group(1)):
                yield m.start(1), m.end(1), "TOKEN"
        for m in BEARER.finditer(line):
            v = m.group(1)
            if not placeholder(v) and (random_looking(v) or PASSWORD_SHAPE.match(v) or usable("token", v)):
                yield m.start(1), m.end(1), "TOKEN"
        for m in QUERY.finditer(line):
            if not placeholder(m.group(1)) and usable("token", m.group(1)):
                yield m.start(1), m.end(1), "TOKEN"
        for m in FLAG.finditer(line):
            if usable("password", m.group(2)) or re.match(r"(?i)-+[a-z-]*(?:pass|pwd)", m.group()) and spoken("password", m.group(2)):
                yield m.start(2), m.end(2), "PASSWORD"
    for m in USER_FLAG.finditer(line):
        if not placeholder(m.group(3)) and classes(m.group(3)) >= 2 and len(m.group(3)) >= 6:
            yield m.start(3), m.end(3), "PASSWORD"
    joined: list[tuple[int, int]] = []
    for m in PARTS.finditer(line):
        whole = "".join(p.group(2) for p in PIECE.finditer(m.group()))
        name = (NAME.findall(line[: m.start()]) or [""])[-1]
        if usable(name, whole, line[m.end() :]):
            joined.append(m.span())
            for p in PIECE.finditer(m.group()):
                yield m.start() + p.start(2), m.start() + p.end(2), "API_KEY"
    for m in LITERAL.finditer(line):
        if any(a <= m.start() < b for a, b in joined):
            continue
        k = m.lastindex or 1
        v, rest = m.group(k), line[m.end() :]
        if len(v) < 4 or "://" in v:
            continue
        before = line[: m.start()]
        if rest[:2].lstrip().startswith(":") and not before.rstrip().endswith((":", "=", ",", "(")) and rest.lstrip().startswith(":"):
            continue  # a key, not a value
        names = NAME.findall(re.sub(r"['\"`][^'\"`]*['\"`](?!\s*[\])]?\s*[:=])", " ", before))
        name = names[-1] if names else ""
        if m.group(3) is not None and (w := re.match(r"\s+as\s+([A-Za-z_]\w*)", rest)):
            name = w.group(1)
        if len(names) > 1 and not NAMED.search(name) and re.search(r"(?:environ|getenv|env)\b", before):
            name = next((n for n in reversed(names) if NAMED.search(n)), name)
        said = re.search(r"(?://|#|/\*)(.*)$", rest)
        if usable(name, v, said.group(1) if said else ""):
            yield m.start(k), m.end(k), "PASSWORD" if PASSWORD_SHAPE.match(v) else "GENERIC"
        elif spoken(name, v) and re.search(r"(?:[:=]|\|\||\?\?)\s*$", before) or spoken((NAME.findall(before) or [""])[-1], v) and re.search(r"(?:environ|getenv|env)\b.*,\s*$", before):
            yield m.start(k), m.end(k), "PASSWORD"
    m = BARE.match(line)
    if m and len(m.group(2)) < 8 and spoken(m.group(1), m.group(2)) and re.fullmatch(r"\s*(?:(?:export\s+)?\w+=\S+|[\"']?[\w.-]+[\"']?: +[^\s,;]+)\s*(?:#.*)?", line):
        yield m.start(2), m.end(2), "PASSWORD"
    if m and usable(m.group(1), m.group(2), line[m.end(2) :]):
        yield m.start(2), m.end(2), "PASSWORD" if PASSWORD_SHAPE.match(m.group(2)) else "GENERIC"
    if any(c in line for c in "/#-*"):
        m = REMARK.search(line)
        if m and (keyed and NAMED.search(m.group(1)) or re.match(r"\s*(?://|#|--)\s*\w+\s+\S+$", line)):
            v = m.group(2)
            if usable(m.group(1), v) and (random_looking(v) or PASSWORD_SHAPE.match(v)):
                yield m.start(2), m.end(2), "GENERIC"


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """(line_no, start, end, kind) of each credential value, offsets into ``text``; none for null or empty text."""
    if not text:
        return []
    global _words
    if _words is None:
        _words = _automaton()
    lines, at = text.split("\n"), 0
    starts = []
    for ln in lines:
        starts.append(at)
        at += len(ln) + 1
    keyed = set()
    low = text.lower()
    if len(low) == len(text):
        pos = sorted(e for e, _ in _words.iter(low))
        i = 0
        for n, s in enumerate(starts):
            end = s + len(lines[n])
            while i < len(pos) and pos[i] <= end:
                if pos[i] >= s:
                    keyed.add(n)
                i += 1
    else:  # a letter whose lower case is longer: look line by line
        keyed = {n for n, ln in enumerate(lines) if next(_words.iter(ln.lower()), None)}
    out, n = [], 0
    while n < len(lines):
        ln = lines[n]
        key = PEM.search(ln) if n in keyed else None
        if key:
            begin = starts[n] + key.end()
            stop, other = PEM_END.search(text, begin), PEM.search(text, begin)
            if stop and not (other and other.start() < stop.start()):
                end = stop.start()
            else:  # cut off: as far as its lines go
                end = starts[n] + len(ln)
                for k in range(n + 1, len(lines)):
                    if not PEM_LINE.fullmatch(lines[k]) or other and starts[k] + len(lines[k]) > other.start():
                        break
                    end = starts[k] + len(lines[k])
            body = re.sub(r"\\n|[\s'\"+,`\\]", "", text[begin:end])
            if len(body) >= 40 and len(set(body)) > 8 and not re.search(r"(?i)your|\.\.\.|<|replace", body[:80]):
                out.append((n + 1, begin, end, "PRIVATE_KEY"))
                n = max(n + 1, text.count("\n", 0, end))
                continue
        if len(ln) >= 12 and any(c.isdigit() for c in ln) or n in keyed:
            spans = sorted(set(_line_spans(ln, n in keyed)))
            last = -1
            for a, b, kind in spans:
                if a >= last:
                    out.append((n + 1, starts[n] + a, starts[n] + b, kind))
                elif b > last:  # spans that overlap are one
                    out[-1] = (*out[-1][:2], starts[n] + b, out[-1][3])
                last = max(last, b)
        n += 1
    return out


def mask(value: str) -> str:
    """Same length, same alphabet: every letter and digit becomes the first of its class; hex stays hex."""
    hexa = re.fullmatch(r"[0-9a-fA-F]+", value) is not None
    small, large = ("a", "A") if hexa else ("x", "X")
    out, i = [], 0
    while i < len(value):
        c = value[i]
        if c == "\\" and i + 1 < len(value):  # an escape such as a line end in a literal stays whole
            out.append(value[i : i + 2])
            i += 2
            continue
        out.append("0" if c.isdigit() else small if c.islower() else large if c.isupper() else c)
        i += 1
    return "".join(out)


def redact(text: str | None) -> str | None:
    """``text`` with every credential masked; null stays null."""
    if not text:
        return text
    out, last = [], 0
    for _, a, b, _ in sorted(find(text), key=lambda x: x[1]):
        if a >= last:
            out += [text[last:a], mask(text[a:b])]
            last = b
    return "".join([*out, text[last:]])


def find_credentials(files: DataFrame, key: str = "file_id", text: str = "source_text") -> DataFrame:
    """(key, line_no, secret_type) for every line on which a credential starts, each line once.

    Null and empty texts have none; repeated keys give repeated rows only if
    they differ.  Texts of any length are read whole, one at a time.
    """
    kind = dict(files.dtypes)[key]
    ship(files.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, s) for k, t in zip(b["k"], b["t"]) for n, s in {n: s for n, _, _, s in reversed(find(t))}.items()]
            yield pd.DataFrame(rows, columns=["k", "line_no", "secret_type"]).astype({"line_no": "int64"})

    return files.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t") != "").mapInPandas(scan, f"k {kind}, line_no bigint, secret_type string").withColumnRenamed("k", key)


@F.pandas_udf(StringType())
def redacted(texts: pd.Series) -> pd.Series:
    return texts.map(redact, na_action="ignore")


def redact_credentials(files: DataFrame, text: str = "source_text", to: str = "redacted_text") -> DataFrame:
    """``files`` with the redacted text in ``to``."""
    ship(files.sparkSession)
    return files.withColumn(to, redacted(F.col(text)))


def report_coverage(found: DataFrame, files: DataFrame, results: DataFrame) -> DataFrame:
    """Per project the credentials found, those an earlier report already had, and reported lines without one."""
    path = F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), r"^(\./+)+", "")
    where = files.select("file_id", "snapshot_id", path.alias("file"))
    ours = found.join(where, "file_id").select("snapshot_id", "file", "line_no").distinct().withColumn("ours", F.lit(True))
    said = results.select("snapshot_id", "project_id", F.explode("detected_secrets").alias("d")).select("snapshot_id", F.regexp_replace(F.regexp_replace("d.file", r"\\", "/"), r"^(\./+)+", "").alias("file"), F.col("d.line").alias("line_no")).distinct().withColumn("said", F.lit(True))
    projects = results.groupBy("snapshot_id").agg(F.max("project_id").alias("project_id"))
    both = ours.join(said, ["snapshot_id", "file", "line_no"], "full_outer").join(projects, "snapshot_id", "left")
    return both.groupBy("project_id").agg(F.count_if("ours").alias("found_count"), F.count_if(F.col("ours") & F.col("said")).alias("reported_count"), F.count_if(F.col("said") & F.col("ours").isNull()).alias("unfounded_count"))
