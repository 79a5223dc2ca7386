"""Secrets in texts: fixed patterns, and literals that a lexer of assignments finds to flow into sensitive names."""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, let

#: The kinds of spans, in the order in which those that start together are listed.
KINDS = ["assign", "access", "hex", "literal"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
# a run of these characters is one match, so the least length can stand in the pattern
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

# Names start once in a run of characters and are taken whole, so no pattern goes over a text again and again.
_NAME = r"[A-Za-z_$][\w$]*+(?:(?:\.|->|::|-)[\w$]++)*+"
_NAME_START = r"(?<![\w$])(?<![\w$][.-])(?<!->)(?<!::)"
_QUOTED = r""""(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`"""
#: name = , "name": , m['name'] = , name := , name => , name: Type =
HEAD = re.compile(rf"""{_NAME_START}({_NAME})["'`]?\]?[\x20\t]*+(?::[\x20\t]*+[A-Za-z_][\w.]*+(?:\[[\w.]*+\])?[\x20\t]*+(?==[^=>])=|:=|=>|=(?![=~>])|:(?![:=]))[\x20\t]*+""", re.ASCII)
OPERATOR = re.compile("[=:]")
#: What an expression begins with or goes on with: a quoted literal, or a name, perhaps one that is called.
TERM = re.compile(rf"""[\s(\[]*+(?:[bBrRuUfF]{{0,2}}(?P<quoted>{_QUOTED})|(?:\$\{{|\$\(|\{{\{{\s*+|%)?(?P<name>{_NAME})(?:\s*+\}}\}}|[}})%])?(?P<call>\()?)""", re.ASCII)
JOIN, ARGUMENT, NEXT_STRING = re.compile(r"\s*+(?:\+|\.\.?|&)(?=[\s\"'`\w$(])"), re.compile(r"\s*+,"), re.compile(r"""\s*+(?=[bBrRuUfF]{0,2}["'`])""")
#: A whole value in a line of a configuration, without quotes.
BARE = re.compile(r"[^\s\"'`#;,(){}\[\]<>]++(?=[\x20\t]*+(?:[#;,][^\n]*+)?(?:\n|\r|\Z))")
BEFORE_NAMES = ("export", "set", "env", "-")
#: Further forms of a pair, each with what a text that has it holds in lower case: the groups name (if none: it is called password) and value.
FORMS = [
    ("://", re.compile(r"://[^\s/:@\"']*+:(?P<value>[^\s/@\"']++)@")),
    ("</", re.compile(r"<(?P<name>[A-Za-z_][\w.-]*+)>[\x20\t]*+(?P<value>[^<>\s]++)[\x20\t]*+</")),
    ("value", re.compile(r"""\b(?:key|name)[\x20\t]*+=[\x20\t]*+["'](?P<name>[\w.:-]++)["']\s++value[\x20\t]*+=[\x20\t]*+["'](?P<value>[^"'\n]++)["']""", re.IGNORECASE)),
    ("-", re.compile(r"""-(?<!\S-)-?(?P<name>[A-Za-z][\w-]*+)[\x20=]["']?(?P<value>[^\s"']++)""")),
    ("authorization", re.compile(r"""\b(?P<name>authorization)["']?[\x20\t]*+[:=][\x20\t]*+["']?(?:bearer|basic|token)\x20++(?P<value>[\w+/=.~-]++)""", re.IGNORECASE)),
]

#: Words of names: secrets by themselves, secrets with "key" after them, lesser ones, and last words that say it is something about a secret.
SECRET_WORDS = {"password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "credential", "credentials", "passcode", "privatekey", "secretkey", "accesskey"}
KEY_WORDS = {"api", "access", "private", "secret", "encryption", "signing", "auth", "client", "master", "shared", "account", "storage", "service", "deploy", "webhook"}
LESSER_WORDS = {"auth", "authorization", "bearer", "pass", "salt", "dsn", "signature", "cookie", "session"}
ABOUT_WORDS = {"count", "length", "len", "size", "name", "id", "path", "file", "dir", "url", "uri", "endpoint", "type", "format", "policy", "hint", "label", "field", "header", "prefix", "suffix", "expiry", "expires", "ttl", "max", "min", "limit", "regex", "pattern", "hash", "digest", "index", "version", "scope", "column", "algorithm", "alg", "issuer"}
#: One of these stands, in lower case, in each text with a sensitive name or with a password in a URL.
HINTS = sorted(x for x in {*SECRET_WORDS, *LESSER_WORDS, "key", "://"} if not any(y in x for y in {*SECRET_WORDS, *LESSER_WORDS, "key"} - {x}))
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_OWNER = re.compile(r"^(?:(?:self|this|\$this|process\.env|os\.environ|env|ENV)(?:\.|->|::))?\$?")

#: Values that stand for a secret.
PLACEHOLDER = r"(?i)^(x+|\*+|\.+|-+|_+|0+|none|null|nil|true|false|undefined|todo|string|(change|replace|insert)[-_ ]?(me|this|here)?.*|example.*|your[-_ ].*|my[-_ ].*|<.*>|.*\$\{.*|.*\{\{.*|%[^%]*%|test|dummy|sample.*|placeholder.*|redacted.*)$"
#: Scores from which a literal is reported.
LEAST = 4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """The spans (start, kind, end) of the fixed patterns, in order."""
    low = text.lower()
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if any(w in low for w in ASSIGN_WORDS) else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def sensitivity(name: str) -> int:
    """3 for names of secrets, 2 for those that may be, 0 for others and for what is about a secret."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[-1] in ABOUT_WORDS or words[0] in ("max", "min", "num"):
        return 0
    pairs = set(zip(words, words[1:]))
    if SECRET_WORDS.intersection(words) or any((w, "key") in pairs for w in KEY_WORDS):
        return 3
    return 2 if LESSER_WORDS.intersection(words) else 0


def _own(name: str) -> str:
    return _OWNER.sub("", name)


def heads(text: str) -> Iterator[re.Match]:
    """The matches of HEAD, sought only in lines that have an operator."""
    at = 0
    while (op := OPERATOR.search(text, at)) is not None:
        begin, end = text.rfind("\n", at, op.start()) + 1 or at, text.find("\n", op.end())
        at = len(text) if end < 0 else end
        yield from HEAD.finditer(text, begin, at)


def _begins_line(text: str, at: int) -> bool:
    """Whether a line has nothing but white space, and a word such as export, before a place."""

    def back(k: int) -> int:
        while k and text[k - 1] in " \t":
            k -= 1
        return k

    begin = back(at)
    if begin < at:
        begin = next((back(begin - len(w)) for w in BEFORE_NAMES if text.endswith(w, 0, begin)), begin)
    return not begin or text[begin - 1] in "\r\n"


def pairs_of(text: str) -> Iterator[tuple[str, list[tuple[int, int]], list[str], tuple[int, int] | None]]:
    """The assignments of a text: the name, its literals' spans, the names it is made of, and a value without quotes that may be either."""
    for head in heads(text):
        at, spans, names, bare = head.end(), [], [], None
        if _begins_line(text, head.start()) and (value := BARE.match(text, at)):
            bare = value.span()
        called = False
        while (term := TERM.match(text, at)) is not None:
            at = term.end()
            if term["quoted"]:
                spans.append((term.start("quoted") + 1, term.end("quoted") - 1))
                onward = NEXT_STRING.match(text, at) or JOIN.match(text, at) or (called and ARGUMENT.match(text, at))
            else:
                if not term["call"]:
                    names.append(_own(term["name"]))
                onward = NEXT_STRING.match(text, at) if term["call"] else JOIN.match(text, at) or (called and ARGUMENT.match(text, at))
                called |= bool(term["call"])
            if not onward:
                break
            at = onward.end()
        if spans or names or bare:
            yield _own(head[1]), spans, names, bare
    low = text.lower()
    for form in [p for part, p in FORMS if part in low]:
        for m in form.finditer(text):
            yield m.groupdict().get("name") or "password", [m.span("value")], [], None


def flows(text: str) -> dict[tuple[int, int], tuple[str, int]]:
    """Each literal's span that flows into a sensitive name, with the most sensitive such name and its weight.

    A name that others are made of passes what it holds on to them, wherever in the text they
    are assigned and over any number of steps; each name is walked once.
    """
    low = text.lower()
    if not any(x in low for x in HINTS):
        return {}
    made_of, holds, unsure = defaultdict(list), defaultdict(list), []
    for name, spans, names, bare in pairs_of(text):
        holds[name] += spans
        made_of[name] += names
        if bare:
            unsure.append((name, bare))
    for name, (begin, end) in unsure:  # a value that is no known name is a literal
        if _own(text[begin:end]) not in holds:
            holds[name].append((begin, end))
    reached: dict[str, tuple[str, int]] = {}
    for name in sorted((n for n in holds if sensitivity(n)), key=lambda n: (-sensitivity(n), n)):
        walk = [name]
        while walk:
            if (at := walk.pop()) not in reached:
                reached[at] = (name, sensitivity(name))
                walk += [x for x in made_of.get(at, ()) if x in holds and x not in reached]
    found: dict[tuple[int, int], tuple[str, int]] = {}
    for name, target in reached.items():
        for span in holds[name]:
            if span not in found or target[1] > found[span][1]:
                found[span] = target
    return found


SPANS = "struct<base: array<struct<start: int, kind: int, end: int>>, literals: array<struct<start: int, end: int, value: string, target: string, weight: int>>>"
_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_LITERALS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("target", pa.string()), ("weight", pa.int32())]))


def lexed(text: Column) -> Column:
    """The base spans of a text (not null) and the literals that flow into sensitive names and lie outside of them."""

    @F.arrow_udf(SPANS)
    @lean
    def run(texts: pa.Array) -> pa.Array:
        bases, literals = [], []
        for t in texts:
            whole = t.as_py()
            base = base_spans(whole)
            starts, upto = [b[0] for b in base], []
            for b in base:
                upto.append(max(b[2], upto[-1] if upto else 0))
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            own = []
            for (begin, end), (target, weight) in sorted(flows(whole).items()):
                k = bisect.bisect_left(starts, end)
                if end > begin and not (k and upto[k - 1] > begin):
                    own.append({"start": begin, "end": end, "value": whole[begin:end], "target": target, "weight": weight})
            literals.append(own)
        return pa.StructArray.from_arrays([pa.array(bases, _BASE), pa.array(literals, _LITERALS)], names=["base", "literals"])

    return run(text)


def score(value: Column, weight: Column) -> Column:
    """How much a literal looks like the secret that its target's name promises."""
    classes = sum(F.when(value.rlike(p), 1).otherwise(0) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    kinds = F.size(F.array_distinct(F.split(value, "")))
    points = weight + F.when(F.length(value) >= 12, 1).otherwise(0) + F.when(F.length(value) >= 20, 1).otherwise(0) + F.when(classes >= 2, 1).otherwise(0) + F.when(kinds >= 8, 1).otherwise(0)
    points -= F.when(~value.rlike("[0-9]"), 2).otherwise(0) + F.when(value.rlike(r"^(https?:|[./~]|[A-Za-z]:\\)|\$\w"), 3).otherwise(0)
    no = value.rlike(PLACEHOLDER) | (F.length(value) < 6) | (value.rlike(r"\s") & ~value.rlike("^-----BEGIN [A-Z ]*PRIVATE KEY"))
    return F.when(no, 0).otherwise(points)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """A row (id, base, spans) for each row of docs; offsets are code points, ends exclusive.

    base: array of (start, kind, end, target, score) for the fixed patterns, kind an index into KINDS, with no target and
    no score; spans: the same and the literals that assignments of the text lead into a sensitive name, with that
    name, and that score `least` or more. Literals that a fixed pattern overlaps aren't added. A null
    text counts as ''; texts are looked at whole, a text being one task's work, in about linear time; repeated rows and null ids are returned
    each; an empty table gives no rows; other columns are ignored.
    """
    known = F.lit(None).cast("string").alias("target"), F.lit(None).cast("int").alias("score")
    scored = lambda p: F.struct(p["start"].alias("start"), F.lit(3).alias("kind"), p["end"].alias("end"), p["target"].alias("target"), score(p["value"], p["weight"]).alias("score"))
    rows = docs.select(F.col(id_col).alias(id_col), lexed(F.coalesce(F.col(text_col), F.lit(""))).alias("_s"))
    base = F.transform("_s.base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), *known))
    added = F.filter(F.transform("_s.literals", scored), lambda p: p["score"] >= least)
    return rows.select(id_col, base.alias("base"), let(added, lambda a: F.array_sort(F.concat(base, a))).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
