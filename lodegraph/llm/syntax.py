"""Source files that do not parse, found by language-specific lexers with a pushdown stack.

Each lexer splits a whole file into tokens.  It reports literals and comments
that never end and characters no token begins with; the stack reports brackets
that don't match and files that end inside one; rules on neighbouring tokens
report operands without an operator between them, operators without an operand,
declarations without a name and a language's top level broken.  Conflict
markers count where they stand outside of literals and comments.  JSON's
grammar is small enough for the stack to decide it all.  Python's lexer keeps a
second stack, of the columns of open blocks; an exact check follows, the standard
library's parser, which confirms what the lexer found and adds what takes the
full grammar.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import ship

#: The extensions and the languages they stand for.
EXTENSIONS = {"ts": "ts", "tsx": "tsx", "mts": "ts", "js": "js", "mjs": "js", "cjs": "js", "py": "python", "json": "json", "go": "go", "java": "java"}
PAIRS = {")": "(", "]": "[", "}": "{"}

#: Reserved words by language.
RESERVED = {
    "js": set("break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false".split()),
    "go": set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
    "java": set("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()),
}
#: Words that may stand beside a name without being reserved.
CONTEXTUAL_JS = set("async await of let static get set yield from as".split())
CONTEXTUAL_TS = CONTEXTUAL_JS | set("type interface namespace module declare abstract readonly public private protected override is keyof infer satisfies asserts unique global implements accessor out require enum".split())
CONTEXTUAL_JAVA = set("record sealed permits var yield module requires exports opens to with provides uses when non".split())
OPERAND_WORDS = {"this", "super", "null", "true", "false"}
PRIMITIVES = {"boolean", "byte", "char", "double", "float", "int", "long", "short"}

PUNCT = {
    "js": re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~<>=?:;,.(){}\[\]@#]"),
    "go": re.compile(r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^!~<>=:;,.(){}\[\]]"),
    "java": re.compile(r">>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]@]"),
}
WORD = re.compile(r"[^\W\d][\w$]*|\$[\w$]*", re.UNICODE)
NUMBER = {
    "js": re.compile(r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?"),
    "go": re.compile(r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[oO]?[0-7_]+(?![\d.])i?|0[bB][01_]+i?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?"),
    "java": re.compile(r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?"),
}
BLANK = " \t\r\f\v\n\u00a0\ufeff\u2028\u2029"
SPACE = re.compile(r"[ \t\r\f\v\u00a0\ufeff\u2028\u2029]+")
CONFLICT = re.compile(r"(?:<{7}|>{7}|\|{7})(?: |$)|={7}$")


class Fault(Exception):
    """Why a text is no program; ``args``: reason, line."""


@dataclass(slots=True)
class Token:
    kind: str  # word, name, number, string, regex, punct
    text: str
    line: int
    fresh: bool  # first on its line
    gap: bool  # white space before it


#: The rest of a string behind its opening quote; an escape may stand before a line's end.
QUOTED = {q: re.compile(rf"[^{q}\\\n\r]*(?:\\(?:\r\n|[\s\S])[^{q}\\\n\r]*)*{q}") for q in "'\""}


def _string_end(s: str, i: int, quote: str, line: int) -> int:
    m = QUOTED[quote].match(s, i + 1)
    if m:
        return m.end()
    raise Fault("unterminated string", line)


def _regex_end(s: str, i: int, line: int) -> int:
    j, n, in_class = i + 1, len(s), False
    while j < n:
        c = s[j]
        if c == "\\":
            j += 2
            continue
        if c == "\n":
            break
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif c == "/" and not in_class:
            j += 1
            while j < n and (s[j].isalnum() or s[j] in "$_"):
                j += 1
            return j
        j += 1
    raise Fault("unterminated regular expression", line)


def _ends_operand(t: Token | None) -> bool:
    return t is not None and (t.kind in ("name", "number", "string", "regex") or t.text in OPERAND_WORDS or t.text in (")", "]", "}", "++", "--"))


class Lexer:
    """Tokens of JavaScript, TypeScript, Go or Java, with the bracket stack kept along the way."""

    def __init__(self, text: str, language: str):
        self.s, self.language = text, language
        self.base = "js" if language in ("ts", "tsx") else language
        self.tokens: list[Token] = []
        self.stack: list[tuple[str, int, Token | None]] = []
        self.end, self.in_block = 0, False

    def run(self, i: int = 0, line: int = 1, inner: bool = False) -> list[Token]:
        """All tokens; of an ``inner`` expression those from ``i`` to the brace that closes it, behind which ``end`` is."""
        s, n = self.s, len(self.s)
        fresh, gap = True, False
        reserved, base, tokens = RESERVED[self.base], self.base, self.tokens
        punct, number = PUNCT[base], NUMBER[base]
        if base == "js" and not inner and s.startswith("#!"):
            i = s.find("\n") if "\n" in s else n
        while i < n:
            c = s[i]
            if c == "\n":
                line, fresh, gap, i = line + 1, True, True, i + 1
                continue
            if c == " " and i + 1 < n and s[i + 1] not in BLANK:
                gap, i = True, i + 1
                continue
            if c == " " or c in "\t\r\f\v\u00a0\ufeff\u2028\u2029" or c.isspace():
                m = SPACE.match(s, i)
                gap, i = True, m.end() if m else i + 1
                continue
            if fresh and (i == 0 or s[i - 1] == "\n") and c in "<>|=":
                end = s.find("\n", i)
                if CONFLICT.match(s[i : end if end >= 0 else n].rstrip("\r")):
                    raise Fault("conflict marker", line)
            if c == "/" and s.startswith("//", i):
                end = s.find("\n", i)
                i = n if end < 0 else end
                continue
            if c == "/" and s.startswith("/*", i):
                end = s.find("*/", i + 2)
                if end < 0:
                    raise Fault("unterminated comment", line)
                if "\n" in s[i:end]:
                    fresh = True
                line, i, gap = line + s.count("\n", i, end), end + 2, True
                continue
            start, prev = line, tokens[-1] if tokens else None
            if c in "([{;,":  # most signs are one of these, and nothing longer begins so
                if c not in ";,":
                    self.stack.append((c, line, prev))
                    self._closed_template = False
                tokens.append(Token("punct", c, line, fresh, gap))
                fresh, gap, i = False, False, i + 1
                continue
            if (c.isalpha() or c == "_") and (m := WORD.match(s, i)):
                j = m.end()
                kind = "word" if m.group() in reserved and not (prev and prev.text in (".", "?.") and base != "go") else "name"
                tokens.append(Token(kind, m.group()[:200], line, fresh, gap))
                fresh, gap, i = False, False, j
                continue
            if c == '"' and base == "java" and s.startswith('"""', i):
                end = i + 3
                while True:
                    end = s.find('"""', end)
                    if end < 0:
                        raise Fault("unterminated text block", line)
                    if s[end - 1] != "\\":
                        break
                    end += 1
                line, j, kind = line + s.count("\n", i, end), end + 3, "string"
            elif c == '"' or (c == "'" and base != "go" and base != "java"):
                j, kind = _string_end(s, i, c, line), "string"
                line += s.count("\n", i, j)
            elif c == "'":
                m = re.compile(r"'(?:[^'\\\n]|\\(?:[abfnrtv0s\\'\"]|u+[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|U[0-9a-fA-F]{8}|[0-7]{1,3}))'").match(s, i)
                if not m:
                    raise Fault("bad character literal", line)
                j, kind = m.end(), "string"
            elif c == "`":
                if base == "go":
                    end = s.find("`", i + 1)
                    if end < 0:
                        raise Fault("unterminated raw string", line)
                    line, j, kind = line + s.count("\n", i, end), end + 1, "string"
                elif base == "js":
                    j = self._template(i + 1, line)
                    line += s.count("\n", i, j)
                    kind = "string"
                    if s[j - 1] == "{":
                        self.tokens.append(Token("punct", "`{", start, fresh, gap))
                        self.stack.append(("`{", start, prev))
                        fresh, gap, i = False, False, j
                        continue
                else:
                    raise Fault("stray character", line)
            elif c.isdigit() or (c == "." and i + 1 < n and s[i + 1].isdigit()):
                m = number.match(s, i)
                j, kind = m.end(), "number"
                if j < n and (s[j].isalnum() or s[j] in "_$"):
                    raise Fault("letters right after a number", line)
            elif m := WORD.match(s, i):
                j = m.end()
                kind = "word" if m.group() in reserved and not (prev and prev.text in (".", "?.") and base != "go") else "name"
            elif c == "\\" and base == "js" and s.startswith("\\u", i):
                m = re.compile(r"(?:\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})|[\w$])+").match(s, i)
                if not m:
                    raise Fault("stray character", line)
                j, kind = m.end(), "name"
            elif c == "#" and base == "js" and (m := WORD.match(s, i + 1)):
                j, kind = m.end(), "name"
                if not (self.in_block or any(b == "{" for b, *_ in self.stack)):
                    raise Fault("stray character", line)
            elif c == "/" and base == "js" and not self._division(prev):
                j, kind = _regex_end(s, i, line), "regex"
            elif (m := punct.match(s, i)) and m.group() != "#":
                j, kind = m.end(), "punct"
                if inner and m.group() == "}" and not self.stack:
                    self.end = j
                    return self.tokens
                self._bracket(m.group(), line, prev)
                if m.group() == "}" and self.tokens and self._closed_template:
                    k = self._template(j, line)
                    line += s.count("\n", j, k)
                    if s[k - 1] == "{":
                        self.tokens.append(Token("punct", "}{", start, False, False))
                        self.stack.append(("`{", start, prev))
                        fresh, gap, i = False, False, k
                        continue
                    self.tokens.append(Token("string", "`", start, False, False))
                    fresh, gap, i = False, False, k
                    continue
            else:
                raise Fault("stray character", line)
            if self.language == "tsx" and kind == "punct" and s[i:j] == "<" and not _ends_operand(prev) and (m := re.compile(r"<(?:>|[A-Za-z][\w.-]*(?=[\s/>]))").match(s, i)):
                end = self._markup(i, line)
                if end:
                    line += s.count("\n", i, end)
                    j, kind = end, "string"
            self.tokens.append(Token(kind, s[i:j] if j - i < 200 else s[i : i + 200], start, fresh, gap))
            fresh, gap, i = False, False, j
        if inner and not self.stack:
            raise Fault("ends inside {", line)
        if self.stack:
            raise Fault("ends inside " + self.stack[-1][0].strip("`"), self.stack[-1][1])
        return self.tokens

    _closed_template = False

    def _bracket(self, p: str, line: int, prev: Token | None) -> None:
        self._closed_template = False
        if p in "([{":
            self.stack.append((p, line, prev))
        elif p in PAIRS:
            if not self.stack:
                raise Fault("closes what was never opened", line)
            top = self.stack.pop()[0]
            if p == "}" and top == "`{":
                self._closed_template = True
            elif top != PAIRS[p]:
                raise Fault("brackets don't match", line)

    def _division(self, prev: Token | None) -> bool:
        if prev is None:
            return False
        if prev.text == "}":
            return False
        return _ends_operand(prev)

    def _template(self, i: int, line: int) -> int:
        s, n = self.s, len(self.s)
        while i < n:
            c = s[i]
            if c == "\\":
                i += 2
            elif c == "`":
                return i + 1
            elif c == "$" and s.startswith("${", i):
                return i + 2
            else:
                i += 1
        raise Fault("unterminated template", line)

    def _markup(self, i: int, line: int) -> int:
        """End of the element that starts at ``i``; 0 if it is no element after all."""
        s, n, j = self.s, len(self.s), i
        opened: list[str] = []
        while j < n:
            m = TAG.match(s, j)
            if m and m.group(1) is not None:
                name = re.sub(r"\s", "", m.group(1))
                if not opened or opened.pop() != name:
                    raise Fault("tags don't match", self._line(i, j, line))
                j = m.end()
                if not opened:
                    return j
            elif m:
                first, name, j = not opened, m.group(2) or "", m.end()
                if first and (re.compile(r"\s+extends\b").match(s, j) or s.startswith(">(", j) and not re.compile(r"</\s*" + re.escape(name) + r"\s*>").search(s, j)):
                    return 0  # type parameters
                if m.group(2) is None:
                    opened.append("")
                    continue
                j, alone = self._attributes(j, i, line, first)
                if not j:
                    return 0
                if not alone:
                    opened.append(name)
                elif first:
                    return j
            elif s[j] == "{":
                j = self._braced(j, self._line(i, j, line), True)
            elif s[j] in "<>}":
                self._conflict(j, i, line)
                raise Fault("stray character", self._line(i, j, line))
            else:
                self._conflict(j, i, line)
                j += 1
        raise Fault("ends inside an element", line) if "</" in s[i:] else Fault("element never closed", line)

    def _line(self, i: int, j: int, line: int) -> int:
        return line + self.s.count("\n", i, j)

    def _conflict(self, j: int, i: int, line: int) -> None:
        s = self.s
        if s[j] in "<>|=" and s[j - 1] == "\n":
            end = s.find("\n", j)
            if CONFLICT.match(s[j : end if end >= 0 else len(s)]):
                raise Fault("conflict marker", self._line(i, j, line))

    def _attributes(self, j: int, i: int, line: int, first: bool) -> tuple[int, bool]:
        """(end of the tag, whether it closes itself) from behind its name on; end 0 where the ``first`` is no tag."""
        s, n = self.s, len(self.s)
        named = valued = False  # whether a name, a name and its sign stand before
        if s.startswith("<", j):  # type arguments
            depth = 0
            while j < n:
                depth += (s[j] == "<") - (s[j] == ">" and s[j - 1] != "=")
                j += 1
                if not depth:
                    break
        while j < n:
            c = s[j]
            if c.isspace():
                j += 1
            elif s.startswith("//", j):
                end = s.find("\n", j)
                j = n if end < 0 else end
            elif s.startswith("/*", j):
                end = s.find("*/", j + 2)
                j = n if end < 0 else end + 2
            elif c == ">" and not valued:
                return j + 1, False
            elif s.startswith("/>", j) and not valued:
                return j + 2, True
            elif c in "\"'" and valued:
                end = s.find(c, j + 1)
                if end < 0:
                    break
                j, named, valued = end + 1, False, False
            elif c == "{":
                j = self._braced(j, self._line(i, j, line), False)
                named = valued = False
            elif c == "<" and valued and TAG.match(s, j):
                end = self._markup(j, self._line(i, j, line))
                if not end:
                    break
                j, named, valued = end, False, False
            elif c == "=" and named and not valued:
                j, valued = j + 1, True
            elif not valued and (m := ATTRIBUTE.match(s, j)):
                j, named = m.end(), True
            else:
                self._conflict(j, i, line)
                break
        if first:
            return 0, False
        raise Fault("stray character in a tag", self._line(i, min(j, n), line))

    def _braced(self, i: int, line: int, empty: bool) -> int:
        """End of the expression in braces at ``i``, which the normal rules hold for; only a child may be ``empty``."""
        sub = Lexer(self.s, self.language)
        sub.in_block = self.in_block or any(b == "{" for b, *_ in self.stack)
        tokens = sub.run(i + 1, line, True)
        if tokens:
            _neighbours([Token("punct", "(", line, False, False), *tokens, Token("punct", ")", line, False, False)], self.language)
        elif not empty:
            raise Fault("braces without a value", line)
        return sub.end


TAG = re.compile(r"</\s*([\w.:$-]*)\s*>|<(?:>|([A-Za-z_$][\w.:$-]*))")
ATTRIBUTE = re.compile(r"[A-Za-z_$][\w$.:-]*")


#: Operators that need an operand on their right, and those that need one on their left.
NEEDS_RIGHT = set("= == === != !== <= >= += -= *= /= %= && || ?? => + - / % ** << := . ?. & | ^ ~ ! ->".split())
NEEDS_LEFT = set("= == === != !== <= >= += -= *= /= %= && || ?? => % ** . ?. ^ :=".split())
CLOSERS = {")", "]", "}", ";", ","}


def _neighbours(tokens: list[Token], language: str) -> None:
    """Rules on neighbouring tokens; raises at the first that is broken."""
    base = "js" if language in ("ts", "tsx") else language
    typed = language in ("ts", "tsx")
    soft = CONTEXTUAL_TS if typed else CONTEXTUAL_JS if base == "js" else CONTEXTUAL_JAVA if base == "java" else set()
    opened: list[tuple[str, Token | None, int]] = []  # bracket, the token before it, angles open in it
    angles = [0]
    choices = [0]  # conditionals and cases whose colon is still to come, by bracket
    closed_owner: Token | None = None
    names = 0
    n = len(tokens)
    for i, t in enumerate(tokens):
        prev = tokens[i - 1] if i else None
        nxt = tokens[i + 1] if i + 1 < n else None
        x = t.text
        p = prev.text if prev else ""
        # operands side by side
        kind = t.kind
        starts = kind in ("name", "number", "string") or (kind == "word" and x in OPERAND_WORDS)
        if prev and starts and prev.kind in ("name", "number", "string", "regex") and not (prev.kind == "string" and p in ("`{", "}{")):
            same_line = not t.fresh
            both_names = t.kind == "name" and prev.kind == "name"
            if base == "js" and same_line and x not in soft and p not in soft and not (t.kind == "string" and (x.startswith("`") or prev.kind == "name" and p == "from")):
                raise Fault("operands without an operator", t.line)
            if base == "js" and same_line and prev.kind in ("number", "string") and t.kind in ("number", "string") and not x.startswith("`"):
                raise Fault("operands without an operator", t.line)
            if base == "java" and not both_names and not (prev.kind == "name" and p in soft):
                raise Fault("operands without an operator", t.line)
            if base == "go" and same_line and prev.kind in ("number", "string") and not (prev.kind == "string" and False):
                raise Fault("operands without an operator", t.line)
            if base == "go" and same_line and t.kind == "number":
                raise Fault("operands without an operator", t.line)
            if both_names and base in ("java", "go") and (same_line or base == "java"):
                names += 1
                if names >= 2 and p not in soft:
                    raise Fault("too many names in a row", t.line)
            else:
                names = 0
        else:
            names = 0
        if prev and p in (")", "]") and t.kind in ("number", "string") and not x.startswith("`") and not t.fresh and base == "js" and not (p == ")" and closed_owner and closed_owner.text in ("if", "for", "while", "with")):
            raise Fault("operands without an operator", t.line)
        if base == "js" and prev and p in (")", "]") and t.kind == "name" and not t.fresh and x not in soft and not (p == ")" and (closed_owner is None or closed_owner.text in ("if", "for", "while", "with", "await", "@") or closed_owner.kind == "name" and opened_decorator(tokens, i))):
            raise Fault("operands without an operator", t.line)
        if base == "java" and p == ")" and closed_owner is not None and closed_owner.kind == "name" and (t.kind in ("name", "number", "string") or t.kind == "word" and x not in ("throws", "instanceof", "default", "final", "public", "private", "protected", "static", "class", "interface", "enum", "abstract", "void", "int", "long", "double", "float", "boolean", "byte", "char", "short", "synchronized", "native", "transient", "volatile", "strictfp")) and not opened_decorator(tokens, i):
            raise Fault("statement without an end", t.line)
        if base == "java" and prev and prev.kind in ("number", "string") and t.kind == "word" and x != "instanceof":
            raise Fault("statement without an end", t.line)
        # angles
        if x == "<" and prev and (prev.kind == "name" or p in ("extends", "new", "function", "class") or base == "java" and p in (".", "public", "static", "final", "private", "protected")) and (not t.gap or base == "java"):
            angles[-1] += 1
        generic = False
        if x in (">", ">>", ">>>") and angles[-1]:
            generic = True
            angles[-1] = max(0, angles[-1] - len(x))
        if x in ("&&", "||", ";", "{") and angles[-1] and base != "java" and x != "{":
            angles[-1] = 0
        # an operator and what follows it
        if t.kind == "punct" and not generic and (x in NEEDS_RIGHT or x in (">", ">>", "<", "*") and base != "go" and not (x == "*" and p in ("function", "yield", "import", "export", "{", ",", ";", "}", "async", "get", "static", ""))):
            skip = x == "!" and typed and _ends_operand(prev)
            skip = skip or x in (">", ">>") and any(angles)
            skip = skip or x == "*" and base == "js" and nxt is not None and nxt.text == "as"
            skip = skip or base == "go" and x in ("&", "|", "~", ".")
            if nxt is None:
                if not skip:
                    raise Fault("ends after an operator", t.line)
            elif not skip and nxt.text in CLOSERS and nxt.kind == "punct":
                raise Fault("operator without an operand", t.line)
            elif nxt.kind == "punct" and nxt.text in NEEDS_LEFT and x in NEEDS_LEFT and not (x == "=" and nxt.text == "=>"):
                raise Fault("operator without an operand", t.line)
        if t.kind == "punct" and x in NEEDS_LEFT and x != ".":
            if prev is None or p in ("(", "[", ",", ";") and prev.kind == "punct" and not (x == "=" and p in ("[", ",")):
                raise Fault("operator without an operand", t.line)
        if x == "," and t.kind == "punct" and (p in ("(", ";", ".") or p == "," and not (base == "js" and opened and opened[-1][0] == "[") or p == "{" and prev.kind == "punct"):
            raise Fault("comma without an operand", t.line)
        # words that need a certain follower
        if t.kind == "word" and p not in (".", "?.") and not (nxt and nxt.text in (":", "(", ",", "?") and opened and opened[-1][0] == "{" and x not in ("if", "for", "while", "switch", "catch")):
            _follower(t, nxt, tokens, i, language, base)
        if typed and x == "let" and t.kind == "name" and nxt and nxt.kind == "name" and i + 2 < n and tokens[i + 2].text == ":" and p not in (".", "?."):
            _annotation(tokens, i + 3, lambda why, line=t.line: Fault(why, line))
        if base == "js" and not typed:
            if x == ":" and p == ")" and not choices[-1] and not (opened and opened[-1][0] == "{"):
                raise Fault("type annotation", t.line)
            if x == ":" and prev and prev.kind == "name" and opened and opened[-1][0] == "(" and not choices[-1]:
                raise Fault("type annotation", t.line)
            if t.kind == "name" and x in ("interface", "namespace", "declare", "abstract", "private", "public", "protected", "readonly", "implements") and nxt and nxt.kind == "name" and not nxt.fresh:
                raise Fault("type declaration", t.line)
            if x == "type" and nxt and nxt.kind == "name" and not nxt.fresh and i + 2 < n and tokens[i + 2].text in ("=", "<"):
                raise Fault("type declaration", t.line)
        # brackets
        if t.kind == "word" and (x == "case" or x == "default" and nxt and nxt.text == ":"):
            choices[-1] += 1
        if t.kind == "punct":
            if x == "?":
                choices[-1] += 1
            elif x == ":":
                choices[-1] = max(0, choices[-1] - 1)
            elif x == ";":
                choices[-1] = 0
            if x in ("(", "[", "{", "`{"):
                opened.append((x, prev, i))
                angles.append(0)
                choices.append(0)
            elif x == "}{":
                pass
            elif x in PAIRS and opened:
                b, owner, _ = opened.pop()
                angles.pop()
                choices.pop()
                closed_owner = owner
                if x == ")" and base == "js" and owner and owner.text in ("if", "while", "switch") and p == "(":
                    raise Fault("empty condition", t.line)
        elif t.kind == "string" and x == "`" and opened and opened[-1][0] == "`{":
            opened.pop()
            angles.pop()
            choices.pop()


def opened_decorator(tokens: list[Token], i: int) -> bool:
    """Whether the parenthesis that closes before token ``i`` belongs to a decorator or a cast."""
    depth, j = 0, i - 1
    while j >= 0:
        x = tokens[j].text
        if x == ")":
            depth += 1
        elif x == "(":
            depth -= 1
            if not depth:
                break
        j -= 1
    k = j - 1
    while k >= 0 and (tokens[k].kind == "name" or tokens[k].text == "."):
        k -= 1
    return k >= 0 and tokens[k].text == "@"


#: Words that begin statements and no value.
STATEMENTS = set("return break continue if else for while do switch case default try catch finally throw const var".split())


def _annotation(tokens: list[Token], i: int, no: Callable[[str], Fault]) -> None:
    """A declared type from token ``i`` on: there is one, and its angles close before the value."""
    depth = angles = 0
    for j in range(i, len(tokens)):
        x = tokens[j].text
        if tokens[j].kind == "punct":
            if j == i and x in ("=", ";", ",", ")", "]", "}"):
                raise no("type missing")
            if x in ("(", "[", "{", "`{"):
                depth += 1
            elif x in (")", "]", "}"):
                depth -= 1
                if depth < 0:
                    return
            elif not depth and x == "<":
                angles += 1
            elif not depth and x in (">", ">>", ">>>"):
                angles -= len(x)
            elif not depth and (x == ";" or x == "="):
                if angles > 0:
                    raise no("angle never closed")
                return
            elif not depth and not angles and x == ",":
                return
        elif tokens[j].kind == "word" and not depth and not angles and j > i and tokens[j].fresh:
            return


#: The signs and words that heads and blocks are told by.
HEADS = set("( ) [ ] { } `{ ; : in of switch select interface enum for".split())


def _headers(tokens: list[Token], language: str, base: str) -> None:
    """Heads of loops, blocks of try and switch, names of interfaces and enums, values of keys: by the brackets they stand in."""
    n = len(tokens)
    stack: list[list] = []  # bracket, word before it, semicolons, other marks inside, token number
    closed: list | None = None
    waits = ""  # switch or select: the next brace at this depth opens its cases
    level = 0
    for i, t in enumerate(tokens):
        x = t.text
        if x not in HEADS:
            continue
        prev = tokens[i - 1] if i else None
        nxt = tokens[i + 1] if i + 1 < n else None
        member = prev is not None and prev.text in (".", "?.")
        key = nxt is not None and nxt.text in (":", "?", "=", ",") or prev is not None and prev.text in (".", "?.", "::")
        if t.kind == "punct":
            if x in ("(", "[", "{", "`{"):
                word = prev.text if prev is not None and prev.kind == "word" else ""
                if x == "(" and prev is not None and prev.text == "await" and i > 1 and tokens[i - 2].text == "for":
                    word = "for"
                if x == "{" and base != "go" and prev is not None and prev.text == ")" and closed is not None and closed[1] == "switch":
                    word = "switch"
                if x == "{" and waits and level == len(stack):
                    word, waits = "switch", ""
                stack.append([x, word, 0, False, i])
                if x == "{" and word == "switch" and nxt is not None and nxt.text not in ("case", "default", "}", "@"):
                    raise Fault("statement before the first case", nxt.line)
            elif x in PAIRS and stack:
                closed = stack.pop()
                if closed[0] == "(" and closed[1] == "for" and base != "go" and not (closed[2] == 2 or not closed[2] and closed[3]):
                    raise Fault("loop's head is no head", t.line)
                if x == "}" and base in ("js", "java") and closed[1] == "try" and not (nxt is not None and nxt.text in ("catch", "finally")):
                    raise Fault("try without catch", t.line)
                if base in ("js", "java") and prev is not None and prev.text == ":" and prev.kind == "punct" and not (i > 1 and _label(tokens, i - 1)):
                    raise Fault("colon without an operand", t.line)
            elif x == ";" and stack:
                stack[-1][2] += 1
            elif x == ":" and stack and base == "java":
                stack[-1][3] = True
        elif x in ("in", "of") and stack and base == "js":
            stack[-1][3] = True
        elif base == "go" and x in ("switch", "select") and t.kind == "word":
            waits, level = x, len(stack)
        elif language in ("ts", "tsx") and t.kind in ("name", "word") and x in ("interface", "enum") and nxt is not None and nxt.text == "{" and not member and (prev is None or t.fresh or prev.text in ("export", "declare", "const", ";", "}", "{")) and not key:
            if x == "enum" or prev is None or prev.text in ("export", "declare", ";", "}"):
                raise Fault("type without a name", t.line)
        if base == "go" and x == "for" and t.kind == "word":
            _go_loop(tokens, i)


def _label(tokens: list[Token], colon: int) -> bool:
    """Whether a colon ends a case or a default."""
    depth, j = 0, colon - 1
    while j >= 0:
        x = tokens[j].text
        if tokens[j].kind == "punct" or x == "`":
            if x in (")", "]", "}"):
                depth += 1
            elif x in ("(", "[", "{"):
                depth -= 1
                if depth < 0:
                    return False
            elif x == ";" and not depth:
                return False
        elif tokens[j].kind == "word" and x in ("case", "default") and not depth:
            return True
        j -= 1
    return False


def _go_loop(tokens: list[Token], i: int) -> None:
    """A loop's head has no semicolon or two."""
    depth = semis = 0
    for j in range(i + 1, len(tokens)):
        x = tokens[j].text
        if tokens[j].kind != "punct":
            if depth == 0 and tokens[j].kind == "word" and x in ("struct", "func", "interface", "map"):
                return  # a literal's type: its braces aren't the loop's
            continue
        if x == "{" and depth == 0:
            if semis == 1:
                raise Fault("loop's head is no head", tokens[i].line)
            return
        if x in ("(", "[", "{"):
            depth += 1
        elif x in (")", "]", "}"):
            depth -= 1
            if depth < 0:
                return
        elif x == ";" and depth == 0:
            semis += 1


#: Operators of Java that make a value and do nothing.
JAVA_VALUES = set("+ - * / % == != && || & | ^".split())


def _java_statements(tokens: list[Token]) -> None:
    """A statement that only computes a value is none in Java."""
    stack: list[str] = []
    begin: int | None = None
    for i, t in enumerate(tokens):
        if t.kind != "punct" or t.text not in ("(", "[", "{", ")", "]", "}", ";"):
            continue
        x = t.text
        if x in ("(", "[", "{"):
            prev = tokens[i - 1] if i else None
            plain = x == "{" and prev is not None and (prev.text in (")", "else", "do", "try", "finally", "->", ";", "{", "}"))
            stack.append("block" if plain else x)
            if x == "{":
                begin = i + 1 if plain else None
            continue
        if x == ";" and stack and stack[-1] == "block":
            if begin is not None and begin < i:
                _java_value(tokens, begin, i)
            begin = i + 1
            continue
        if x in (")", "]", "}") and stack:
            stack.pop()
            if x == "}":
                begin = i + 1 if stack and stack[-1] == "block" else None


def _java_value(tokens: list[Token], a: int, z: int) -> None:
    head = tokens[a]
    if not (head.kind in ("name", "number") or head.text == "this"):
        return
    depth, found = 0, False
    for j in range(a, z):
        t = tokens[j]
        if t.kind == "word" and t.text not in ("this", "super", "null", "true", "false"):
            return
        if t.kind != "punct":
            if t.kind == "name" and j > a and tokens[j - 1].kind == "name":
                return  # a declaration or a contextual word
            continue
        x = t.text
        if x in ("(", "["):
            depth += 1
        elif x in (")", "]"):
            depth -= 1
        elif depth == 0:
            if x in ("{", "}", "?", ":", "->", "::", "<", ">", "@", ",", "++", "--") or x.endswith("=") and x not in ("==", "!="):
                return
            found = found or x in JAVA_VALUES
    if found:
        raise Fault("statement without an effect", head.line)


def _follower(t: Token, nxt: Token | None, tokens: list[Token], i: int, language: str, base: str) -> None:
    x, y = t.text, nxt.text if nxt else ""
    n = len(tokens)

    def no(why: str) -> Fault:
        return Fault(why, t.line)

    if base == "js":
        if x in ("const", "var") or x == "let":
            if nxt is None or not (nxt.kind == "name" or y in ("{", "[", "enum")):
                raise no("declaration without a name")
            after = tokens[i + 2] if i + 2 < n else None
            if nxt.kind == "name" and y != "enum":
                if x == "const" and (after is None or after.text == ";" and not (i and tokens[i - 1].text in ("declare", "export") and language != "js")):
                    raise no("constant without a value")
                if after is not None and after.text == ":" and language != "js":
                    _annotation(tokens, i + 3, no)
                if after is not None and not after.fresh and after.text not in ("=", ",", ";", "of", "in", ":", "!", ")", "}"):
                    raise no("declaration without a value")
                if after is not None and after.text == ":" and language == "js":
                    raise no("type annotation")
        elif x in ("if", "while", "switch", "with") and y != "(":
            raise no("condition without parentheses")
        elif x == "for" and y not in ("(", "await"):
            raise no("loop without parentheses")
        elif x == "catch" and y not in ("(", "{"):
            raise no("catch without a block")
        elif x == "try" and y != "{":
            raise no("try without a block")
        elif x in ("return", "throw", "break", "continue") and nxt is not None and nxt.kind == "word" and not nxt.fresh and y in STATEMENTS:
            raise no("statement where a value should be")
        elif x == "function" and not (nxt and nxt.kind == "name" or y in ("(", "*")):
            raise no("function without a name")
        elif x == "class" and not (nxt and nxt.kind == "name" or y in ("{", "extends")):
            raise no("class without a name")
        elif x == "class" and nxt and nxt.kind == "name" and i + 2 < n and tokens[i + 2].text not in ("{", "extends", "implements", "<"):
            raise no("class without a body")
        elif x == "export" and not (y in ("default", "const", "var", "let", "function", "class", "async", "{", "*", "@", "import", "enum") or language != "js" and y in ("interface", "type", "declare", "abstract", "namespace", "module", "=", "as", "global")):
            raise no("nothing exported")
        elif x == "import" and y not in ("(", "."):
            if nxt is None or not (nxt.kind in ("name", "string") or y in ("{", "*")):
                raise no("import of nothing")
            if nxt.kind == "name" and (i + 2 >= n or not (tokens[i + 2].text in ("from", ",", "=", "{", "*") or nxt.text in ("type", "defer", "source") and tokens[i + 2].kind == "name")):
                raise no("import without a source")
            if nxt.kind != "string":
                inside = False  # the braces of the clause
                for j in range(i + 1, n):
                    if tokens[j].kind == "punct" and tokens[j].text in ("{", "}"):
                        inside = tokens[j].text == "{"
                    if tokens[j].text == "from" and j + 1 < n and tokens[j + 1].kind == "string":
                        break
                    if tokens[j].text in (";", "=") or not inside and tokens[j].kind == "word" and tokens[j].text not in ("default", "this") and j > i + 1 and tokens[j].fresh:
                        if tokens[j].text == "=":
                            break
                        raise no("import without a source")
                else:
                    raise no("import without a source")
        elif x in ("new", "typeof", "throw", "delete", "instanceof", "extends", "case") and (nxt is None or nxt.kind == "punct" and y in CLOSERS | {"=", "."}):
            raise no("word without an operand")
        elif x == "else" and i and tokens[i - 1].text not in ("}", ";") and not t.fresh:
            raise no("else without an if")
    elif base == "go":
        if x in ("const", "var", "type") and not (nxt and nxt.kind == "name" or y == "(" or x == "type" and i and tokens[i - 1].text == "("):
            raise no("declaration without a name")
        if x == "func" and not (nxt and nxt.kind == "name" or y in ("(", "[")):
            raise no("function without a name")
        if x == "package" and not (nxt and nxt.kind == "name"):
            raise no("package without a name")
        if x == "import" and not (nxt and nxt.kind in ("string", "name") or y in ("(", ".")):
            raise no("import of nothing")
        if x in ("if", "switch", "for") and nxt is None:
            raise no("ends after a word")
        if x == "if" and y in ("{", ")"):
            raise no("condition missing")
        if x in ("map", "chan") and x == "map" and y != "[":
            raise no("map without a key")
    elif base == "java":
        if x in ("class", "interface", "enum") and tokens[i - 1].text != "." and not (nxt and nxt.kind == "name"):
            raise no("type without a name")
        if x in ("if", "while", "switch") and y != "(" or x == "for" and y != "(" or x == "catch" and y != "(":
            raise no("condition without parentheses")
        if x in ("package", "import") and not (nxt and (nxt.kind == "name" or y == "static")):
            raise no("name missing")
        if x in PRIMITIVES and not (nxt and nxt.kind == "name" or y in ("[", ".", ")", ">", "...", "::", ",", "&", "@")):
            raise no("declaration without a name")
        if x in ("new", "throw", "instanceof", "case", "extends", "implements", "throws") and (nxt is None or nxt.kind == "punct" and y in CLOSERS | {"=", "."}):
            raise no("word without an operand")


def _top_level(tokens: list[Token], language: str) -> None:
    depth = 0
    if language == "go":
        if tokens and tokens[0].text != "package":
            raise Fault("no package clause", tokens[0].line)
        if not tokens:
            return
        seen_other = False
        for k, t in enumerate(tokens):
            if depth == 0 and t.fresh and not (k and tokens[k - 1].kind == "punct" and tokens[k - 1].text in (",", "=", "+", "-", "*", "/", "(", "[", "|", "&", ".", "&&", "||")):
                if t.text not in ("package", "import", "func", "var", "const", "type", "}", ")", ";"):
                    raise Fault("statement outside of a function", t.line)
                if t.text == "import" and seen_other:
                    raise Fault("import after declarations", t.line)
                if t.text in ("func", "var", "const", "type"):
                    seen_other = True
            if t.text == ":=" and depth == 0:
                raise Fault("statement outside of a function", t.line)
            if t.kind == "punct":
                depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
    elif language == "java":
        start, opened = True, 0
        body = False
        for t in tokens:
            if depth == 0 and start:
                if t.text not in ("package", "import", "public", "final", "abstract", "class", "interface", "enum", "@", "strictfp", ";", "sealed", "non", "record", "module", "open", "private", "protected", "static"):
                    raise Fault("statement outside of a class", t.line)
                start = False
            if t.kind == "punct":
                if t.text == "{" and depth == 0:
                    body = True
                depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
                if depth == 0 and (t.text == ";" or t.text == "}" and body):
                    start, body = True, False
        if tokens and not start:
            raise Fault("ends inside a declaration", tokens[-1].line)
        del opened
        for a, b in zip(tokens, tokens[1:]):
            if b.text == "}" and b.kind == "punct" and a.kind in ("name", "number", "string") and not _java_list(tokens, b):
                raise Fault("statement without an end", b.line)
    elif tokens and tokens[0].text == "{" and len(tokens) > 2 and tokens[1].kind == "string" and tokens[2].text == ":":
        raise Fault("an object where a statement should be", tokens[0].line)


def _java_list(tokens: list[Token], close: Token) -> bool:
    """Whether a brace closes an array initializer, an annotation's list or an enum's constants."""
    j = next(k for k, t in enumerate(tokens) if t is close)
    depth = 0
    for k in range(j, -1, -1):
        x = tokens[k].text
        if tokens[k].kind == "punct":
            depth += (x == "}") - (x == "{")
            if x == "{" and depth == 0:
                before = tokens[k - 1].text if k else ""
                if before in ("=", "]", "(", ",", "{"):
                    return True
                back = [t.text for t in tokens[max(0, k - 8) : k]]
                return "enum" in back
    return False


def _markup_start(text: str) -> bool:
    return bool(re.match(r"\s*<(?:!doctype|html|\?xml)", text, re.I))


def fault(text: str | None, language: str) -> tuple[str, int] | None:
    """(reason, line) why ``text`` breaks the grammar of ``language``; None if it doesn't.

    Null has no fault; an empty text has one in JSON only; a leading byte-order
    mark is none.
    """
    if text is None:
        return None
    if text.startswith("\ufeff"):
        text = text[1:]
    if language == "json":
        return _json_fault(text)
    if not text.strip():
        return None if "\0" not in text else ("stray character", 1)
    if "\0" in text:
        return ("stray character", text.count("\n", 0, text.index("\0")) + 1)
    if language == "python":
        return _python_fault(text)
    try:
        if _markup_start(text):
            raise Fault("markup", 1)
        tokens = Lexer(text.replace("\r\n", "\n").replace("\r", "\n"), language).run()
        _neighbours(tokens, language)
        _headers(tokens, language, "js" if language in ("ts", "tsx") else language)
        if language == "java":
            _java_statements(tokens)
        _top_level(tokens, language)
    except Fault as f:
        return f.args[0], f.args[1]
    except RecursionError:  # elements nested deeper than the worker's stack
        return "nested too deep", 1
    return None


JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-])|true\b|false\b|null\b)|([\[\]{}:,]))')


def _json_fault(text: str) -> tuple[str, int] | None:
    """The grammar of JSON by its tokens, a stack of open brackets and what may come next."""
    stack: list[str] = []
    # value: a value; first: a value or the end of a list; key: a key; name: a key or the end of an object; colon; after: a comma or an end
    want, i, n = "value", 0, len(text)

    def at(j: int) -> int:
        return text.count("\n", 0, j) + 1

    while True:
        m = JSON_TOKEN.match(text, i)
        if not m:
            rest = text[i:].lstrip(" \t\n\r")
            place = at(n - len(rest))
            if not rest:
                if stack:
                    return "ends inside " + stack[-1], place
                return None if want == "after" else ("no value", place)
            if rest[0] == '"':
                return "unterminated string", place
            if re.match(r"(?:<{7}|>{7}|={7})", rest):
                return "conflict marker", place
            return "stray character", place
        i = m.end()
        string, scalar, sign = m.groups()
        if string is not None and want in ("key", "name"):
            want = "colon"
        elif (string is not None or scalar is not None) and want in ("value", "first"):
            want = "after"
        elif sign in ("[", "{") and want in ("value", "first"):
            stack.append(sign)
            want = "first" if sign == "[" else "name"
        elif sign == ":" and want == "colon":
            want = "value"
        elif sign == "," and want == "after" and stack:
            want = "value" if stack[-1] == "[" else "key"
        elif sign == "]" and want in ("first", "after") and stack and stack[-1] == "[" or sign == "}" and want in ("name", "after") and stack and stack[-1] == "{":
            stack.pop()
            want = "after"
        elif sign in ("]", "}") and (not stack or stack[-1] != PAIRS[sign]):
            return "brackets don't match", at(i)
        else:
            return ("text after the value" if want == "after" and not stack else "operands without an operator" if want == "after" else "operator without an operand"), at(i)


PY_TOKEN = re.compile(r"(?P<space>[ \t\f]+)|(?P<line>\n)|(?P<comment>#[^\n]*)|(?P<joined>\\\n)|(?P<quote>(?i:[rbfut]|rb|br|fr|rf|tr|rt)?(?:\"\"\"|'''|\"|'))|(?P<number>(?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?))|(?P<name>[^\W\d]\w*)|(?P<conflict>(?:<{7}|>{7}|={7})(?= |\n|$))|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|>>|<<|<=|>=|==|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>()\[\]{},:;.=!])")
#: Python's reserved words, those that begin a block, and operators that need an operand on their right.
PY_WORDS = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
PY_BLOCKS = set("class def elif else except finally for if try while with".split())
PY_RIGHT = set("+ - * / // % @ ** & | ^ ~ << >> = == != <= >= < > += -= *= /= //= %= @= &= |= ^= >>= <<= **= -> := .".split())
PY_SIGNS = set("+ - * / // % @ & | ^ << >> = == != <= >= < > += -= -> := . **".split())


def _python_lexed(text: str) -> tuple[str, int] | None:
    """What the lexer, its stack of brackets and blocks and the places of words say of a Python text."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    stack: list[str] = []
    blocks = [0]  # columns of open blocks
    row: list[tuple[str, str]] = []  # the logical line: kind, text
    line, i, n = 1, 0, len(text)
    begun, opens = 1, False  # whether the line before opened a block
    column: int | None = None

    def closed() -> tuple[str, int] | None:
        nonlocal opens
        if not row:
            return None
        why = _python_line(row)
        if why:
            return why, begun
        opens = row[-1] == ("op", ":")
        return None

    while i < n:
        m = PY_TOKEN.match(text, i)
        if not m:
            return "stray character", line
        kind, x = m.lastgroup or "", m.group()
        at_start = i == 0 or text[i - 1] == "\n"
        i = m.end()
        if kind == "conflict":
            if at_start:
                return "conflict marker", line
            return "operator without an operand", line
        if kind == "space":
            if at_start and not stack and not row:
                column = 0
                for c in x:
                    column = column // 8 * 8 + 8 if c == "\t" else column + 1
            continue
        if kind == "comment":
            continue
        if kind == "joined":
            line += 1
            continue
        if kind == "line":
            line += 1
            if not stack:
                if why := closed():
                    return why
                row, column = [], 0
            continue
        if not stack and not row:  # the first token of a logical line
            col = column or 0
            begun = line
            if opens and col <= blocks[-1]:
                return "block without a body", line
            if col > blocks[-1]:
                if not opens:
                    return "unexpected indent", line
                blocks.append(col)
            else:
                while blocks[-1] > col:
                    blocks.pop()
                if blocks[-1] != col:
                    return "indent matches no block", line
            opens = False
        if kind == "quote":
            q = x.lstrip("rRbBfFuUtT")
            j = i
            while True:
                j = text.find(q[0], j) if len(q) == 1 else text.find(q, j)
                end = n if j < 0 else j
                if len(q) == 1:
                    k = text.find("\n", i, end)
                    while k >= 0 and (len(text[i:k]) - len(text[i:k].rstrip("\\"))) % 2:
                        k = text.find("\n", k + 1, end)
                    if k >= 0:
                        return "unterminated string", line
                if j < 0:
                    return "unterminated string", line
                back = j
                while back > i and text[back - 1] == "\\":
                    back -= 1
                if (j - back) % 2:
                    j += 1
                    continue
                break
            line += text.count("\n", i, j)
            i = j + len(q)
            row.append(("string", q))
            continue
        if x in ("(", "[", "{"):
            stack.append(x)
        elif x in PAIRS and (not stack or stack.pop() != PAIRS[x]):
            return "brackets don't match", line
        if kind == "number" and i < n and (text[i].isalpha() and not re.match(r"(?:if|in|is|or|and|else|for|not)\b", text[i:]) or text[i].isdigit()):
            return "letters right after a number", line
        row.append((kind, x))
    if stack:
        return "ends inside " + stack[-1], line
    if why := closed():
        return why
    if opens:
        return "block without a body", line
    return None


def _python_line(row: list[tuple[str, str]]) -> str | None:
    """Why a logical line is no statement, as far as neighbours tell."""
    first = row[0][1]
    if first == "async" and len(row) > 1:
        first = row[1][1]
    depth, colon = 0, False
    before: tuple[str, str] | None = None
    soft = row[0][0] == "name" and row[0][1] in ("match", "case", "type", "print", "exec") and first not in PY_WORDS
    lambdas = 0
    for kind, x in [*row, ("end", "")]:
        p = before[1] if before else ""
        ends = before is not None and (before[0] in ("number", "string") or before[0] == "name" and (p not in PY_WORDS or p in ("True", "False", "None")) or p in (")", "]", "}", "..."))
        starts = kind in ("number", "string") or kind == "name" and (x not in PY_WORDS or x in ("True", "False", "None", "lambda", "not"))
        if ends and starts and not (before and before[0] == "string" and kind == "string") and not (x == "not") and not (soft and before == row[0] and row[0][1] in ("match", "case", "type")):
            return "operands without an operator"
        if before is not None and before[0] == "op" and p in PY_RIGHT and (x in (")", "]", "}", ",", ";", "") and not (p == "*" and x in (",", ")", "")) or x == ":" and p not in ("*",)) and not (p in ("/",) and x in (",", ")", ":")):
            return "operator without an operand"
        if kind == "op" and x in PY_SIGNS and not ends and x not in ("+", "-", "*", "**", "@", "->") and not (x == "." and p in ("from", ".", "...", "import")) and not (x == "=" and p == ",") and not (x == "/" and p in (",", "(")):
            return "operator without an operand"
        if x in ("return", "raise", "del", "pass", "break", "continue", "global", "nonlocal", "import", "while", "def", "class", "try", "finally", "assert") and kind == "name" and before is not None and p not in (":", ";") and not (x == "import" and row[0][1] == "from") and not (x in ("def", "with", "for") and p == "async") and not depth:
            return "statement where a value should be"
        if x == "," and (before is None or p in (",", "(", "[", "{") or before[0] == "op" and p in PY_RIGHT and p not in ("*", "/")):
            return "comma without an operand"
        if x == "lambda" and not depth:
            lambdas += 1
        if x == ":" and depth == 0:
            if lambdas:
                lambdas -= 1
            else:
                colon = True
        if x in ("(", "[", "{"):
            depth += 1
        elif x in (")", "]", "}"):
            depth -= 1
        before = (kind, x)
    if first in PY_BLOCKS and not colon:
        return "block without a colon"
    if first in ("def", "class") and not (len(row) > 1 and any(k == "name" and x not in PY_WORDS for k, x in row[1:3])):
        return "declaration without a name"
    if first in ("if", "while", "elif", "with", "for") and row[1 if row[0][1] != "async" else 2 :][:1] == [("op", ":")]:
        return "condition missing"
    return None


def _python_fault(text: str) -> tuple[str, int] | None:
    why = _python_lexed(text)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (RecursionError, MemoryError):
        return why
    except (SyntaxError, ValueError) as e:
        return why or (str(getattr(e, "msg", e)), getattr(e, "lineno", 1) or 1)
    return None


def language_of(path: str | None) -> str | None:
    """The language a path's extension stands for; letter case of the extension doesn't matter."""
    return EXTENSIONS.get((path or "").replace("\\", "/").rsplit("/", 1)[-1].rpartition(".")[2].lower()) if path else None


def find_unparsable(files: DataFrame, key: str = "file_id", path: str = "file_path", text: str = "source_text") -> DataFrame:
    """(key, parse_language, reason, line_no) for every file that breaks its language's grammar.

    Files of other extensions, and null paths or texts, have no fault.  Texts of
    any length are read whole, one at a time.
    """
    kind = dict(files.dtypes)[key]
    ship(files.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, p, t in zip(b["k"], b["p"], b["t"]):
                lang = language_of(p)
                why = fault(t, lang) if lang else None
                if why:
                    rows.append((k, lang, why[0][:200], why[1]))
            yield pd.DataFrame(rows, columns=["k", "parse_language", "reason", "line_no"]).astype({"line_no": "int64"})

    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    known = files.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(text).alias("t")).where(F.col("t").isNotNull() & ext.isin(*EXTENSIONS))
    return known.mapInPandas(scan, f"k {kind}, parse_language string, reason string, line_no bigint").withColumnRenamed("k", key)


def parse_rates(faults: DataFrame, files: DataFrame, results: DataFrame, key: str = "file_id", path: str = "file_path") -> DataFrame:
    """Per project and language: files, files that don't parse and their share."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    lang = F.create_map(*[F.lit(x) for e, v in EXTENSIONS.items() for x in (e, "typescript" if v in ("ts", "tsx") else "javascript" if v == "js" else v)])
    projects = results.groupBy("snapshot_id").agg(F.max("project_id").alias("project_id"))
    known = files.select(key, "snapshot_id", lang[ext].alias("language")).where(F.col("language").isNotNull())
    bad = faults.select(key).distinct().withColumn("bad", F.lit(1))
    met = known.join(bad, key, "left").join(projects, "snapshot_id", "left")
    return met.groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("file_count"), F.count("bad").alias("failed_count")).withColumn("failed_rate", F.round(F.col("failed_count") / F.col("file_count"), 6))
