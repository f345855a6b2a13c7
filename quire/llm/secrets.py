"""Secret scans by assignment-aware lexing.

A lexer cuts source and configuration text into strings, comments, operators,
brackets, line ends and runs of anything else.  Assignments (``=``, ``:=``,
``?=``, ``=>``, ``:`` and elements of markup, but not comparisons) become
name-literal pairs: a target is a word, a quoted word, an owner with
subscripts, or a name before its type.  Constants are propagated to the names
they are assigned to, and literals are scored by the sensitivity of those
names.  What a comment or a string holds is parsed as well, on its own: its
names are no constants of the code around it.  Three base patterns always
count too.

Defined results: a null text counts as empty; an empty text has no spans;
repeated rows each give their row; an empty table gives an empty table; of a
literal that several names hold (a tie) there is one span with the best score.
Each step is linear in the length of the text, so very long texts, names and
lines are read whole.  Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from quire.llm._common import map_text, sha256_hex

BASE_KINDS = ("assign", "access", "hex")
KINDS = BASE_KINDS + ("literal",)
#: a literal is kept from this score on
THRESHOLD = 0.6


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
# what no quote, comment, operator, bracket or line end begins is one run
_TOKEN = re.compile(
    r"""(?P<line>\r?\n)|(?P<text>\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3}|"(?:[^"\\\n]|\\.)*+(?:"|$)|`(?:[^`\\\n]|\\.)*+(?:`|$)|(?:(?<![A-Za-z0-9])|(?<=(?<![A-Za-z0-9])[rbfuRBFU]))'(?:[^'\\\n]|\\.)*+(?:'|$))"""
    r"""|(?P<note>(?<![^\s;{}])\#|(?<![:/])//|/\*)|(?P<over>\*/)|(?P<other>&'[A-Za-z_]++(?!')|[=!]==?|=~|[<>+*/%^&|-]=|::|->)|(?P<sets>:=|=>|\?\?=|\|\|=|\?=|=|:)|(?P<mark>[\[\](){};,])|(?P<run>(?:[^\r\n"'`\#/*=!<>+%^&|:?\[\](){};,-]|(?<=[A-Za-z0-9])[-'/](?=[A-Za-z0-9]))++)|(?P<sign>.)""",
    re.S | re.M,
)
# these read reversed text, so that a name of any length takes one pass
_NAME = re.compile(r"[ \t]*+([A-Za-z0-9_.$-]*+)")
_TYPE = re.compile(r"""[ \t]*+[A-Za-z_&*"'\[][A-Za-z0-9_.:\[\]<>|,&*?"' \t]*+""")
_OPEN = re.compile(r"[ \t]*+(?:\([ \t\r\n]*+)*+")
_NEXT = re.compile(r"[ \t]*+(?:(?:\\?\r?\n|\()[ \t]*+)*+(?=[rbfuRBFU]{0,2}[\"'`])")
_QUOTED = re.compile(r"""[rbfuRBFU]{0,2}(?:"{3}((?:[^\\]|\\.)*?)"{3}|'{3}((?:[^\\]|\\.)*?)'{3}|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\\n]|\\.)*+)`)""", re.S)
_BARE = re.compile(r"""([A-Za-z0-9+/_.$-]++={0,2}+)(?!["'])""")
_IDENT = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*\Z")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)>[ \t]*+([^<>\s]++)[ \t]*+</\1>")
#: every name that has a score holds one of these
_HINT = re.compile("pass|pwd|secret|token|key|credential|auth|signature|cookie|session", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_STRONG = {"password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "credential", "credentials"}
_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("auth", "key"), ("encryption", "key"), ("signing", "key"), ("client", "secret")}
_WEAK = {"auth", "key", "pass", "signature", "cookie", "session"}


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    if any(p in _STRONG for p in parts) or any(p in _PAIRS for p in zip(parts, parts[1:])):
        return 1.0
    return 0.5 if any(p in _WEAK for p in parts) else 0.0


def literal_score(value: str) -> float:
    """0 to 1 from length, character classes and entropy; words and placeholders stay low."""
    if len(value) < 8 or " " in value or value.startswith(("$", "<", "{")):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 4) * (1.0 if classes > 1 else 0.4)


def _last_word(text: str) -> str:
    """The word that ends the text but for blanks; '' if it does not begin as a name does."""
    word = _NAME.match(text[::-1])[1][::-1].lstrip("-.")
    return word if word and not word[0].isdigit() else ""


def _inside(token: str) -> str:
    """What a string token holds; its prefix is not part of the token."""
    n = 3 if len(token) >= 6 and token[:3] == token[0] * 3 else 1
    return token[n : -n if token.endswith(token[0] * n) and len(token) >= 2 * n else None]


class _Statement:
    """The tokens of a statement so far, as far as a target can need them."""

    def __init__(self):
        self.tokens: list[tuple[str, str]] = []  # kind, text

    def target(self) -> str:
        """The name that the tokens end with: a word, a quoted word, or an owner and its subscripts joined by dots."""
        tokens, at, keys = self.tokens, len(self.tokens) - 1, []
        while at >= 0 and tokens[at][0] == "run" and not tokens[at][1].strip():
            at -= 1
        while at >= 2 and tokens[at][1] == "]" and tokens[at - 2][1] == "[":
            kind, text = tokens[at - 1]
            keys.append(_inside(text) if kind == "text" else text.strip())
            at -= 3
        if at < 0:
            return ".".join(reversed(keys))
        kind, text = tokens[at]
        if kind == "text" and not keys:
            word = _inside(text)
            return word if "\n" not in word else ""
        owner = _last_word(text) if kind == "run" else ""
        return ".".join([*([owner] if owner else []), *reversed(keys)])


def _literal(text: str, at: int, sign: str) -> tuple[int, int, bool] | None:
    """(start, end, quoted) of the literal that stands at a place after an assignment's sign."""
    m = _NEXT.match(text, at) if sign != ":" else None
    quoted = _QUOTED.match(text, m.end() if m else _OPEN.match(text, at).end())
    if quoted:
        return (*quoted.span(quoted.lastindex), True)
    bare = _BARE.match(text, _OPEN.match(text, at).end())
    return bare and (*bare.span(1), False)


def _scan(text: str, offset: int, out: list, within: list | None) -> None:
    """Adds (name, literal, start, end) of a text to ``out``, and the strings whose inside is still to be read to ``within``."""
    code: dict[str, tuple[str, int, int]] = {}
    constants, statement, typed, depth = code, _Statement(), None, 0
    noted = ""  # the sign of the comment that is being read
    at, size = 0, len(text)
    while at < size:
        m = _TOKEN.match(text, at)
        kind, token, at = m.lastgroup, m[0], m.end()
        if kind == "line":
            if noted in ("#", "//"):
                constants, noted = code, ""
            if not depth:
                statement, typed = _Statement(), None
        elif kind == "over":
            if noted == "/*":
                constants, noted = code, ""
        elif kind == "note":
            if not noted:
                constants, noted = {}, token  # a comment's names are its own
                statement, typed = _Statement(), None
        elif kind == "mark":
            if token in "(":
                depth += 1
            elif token in ")" and depth:
                depth -= 1
            if token in "{};":
                statement, typed, depth = _Statement(), None, 0
            else:
                statement.tokens.append((kind, token))
        elif kind == "sets":
            name = statement.target()
            names = [name] if name else []
            if token == ":":
                typed = name and (name, at)
            else:
                if typed and token == "=" and _TYPE.fullmatch(text, typed[1], m.start()):
                    names.append(typed[0])
                typed = None
            statement = _Statement()
            value = names and _literal(text, at, token)
            if not value:
                continue
            start, end, quoted = value
            literal = text[start:end]
            found = (literal, offset + start, offset + end)
            if not quoted:
                at = end
                if literal in constants:
                    found = constants[literal]
                elif _IDENT.match(literal) and not any(map(str.isdigit, literal)):
                    statement.tokens.append(("run", literal))
                    continue  # a name that stands for nothing known, or a type
                statement.tokens.append(("run", literal))
            for name in names:
                constants[name] = found
                out.append((name, *found))
        else:
            if kind == "text" and within is not None:
                within.append((m.start(), at))
            if kind != "run" or token.strip():
                statement.tokens.append((kind, token))


def pairs(text: str) -> list[tuple[str, str, int, int]]:
    """(target name, literal, start, end): constants are followed to the names that are set to them.

    In ``a: b = literal`` both names are targets, as b may be a's type.
    """
    out: list[tuple[str, str, int, int]] = []
    within: list[tuple[int, int]] = []
    _scan(text, 0, out, within)
    for start, end in within:  # strings within strings are literals only
        inside = text[start + 1 : end]
        if "=" in inside or ":" in inside:
            _scan(inside, start + 1, out, None)
    if "</" in text:
        out += [(m[1], m[2], *m.span(2)) for m in _ELEMENT.finditer(text)]
    return out


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans with scores, by start and then by kind as listed."""
    out = [("assign", m.start(), m.end(), 1.0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), 1.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end(), 1.0) for m in _HEX.finditer(text)]
    best: dict[tuple[int, int], float] = {}
    if ("=" in text or ":" in text or "</" in text) and _HINT.search(text):
        for name, literal, start, end in pairs(text):
            if (weight := name_score(name)) and (score := weight * literal_score(literal)) >= THRESHOLD:
                best[start, end] = max(score, best.get((start, end), 0.0))
    out += [("literal", s, e, x) for (s, e), x in best.items()]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, secrets array<struct<kind,start,end,score>> over every whole text, in code points."""

    def one(t: str) -> tuple:
        return ([{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in find(t)],)

    return map_text(docs, key, text, one, [("secrets", "array<struct<kind:string,start:int,end:int,score:double>>")])


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans."""

    def one(t: str) -> tuple:
        spans = find(t)
        base = [s for s in spans if s[0] in BASE_KINDS]
        line = lambda some: ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in some)
        return (*(sum(s[0] == k for s in base) for k in BASE_KINDS), sha256_hex(line(base).encode()), line(spans))

    return map_text(docs, key, text, one, [("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string")])
