"""Secret scans: assignment-aware lexing.

Three base patterns are always kept. Beyond them the text is read as source or configuration, each target with the
literal that it is assigned: `name op literal` with = : := =>, typed declarations (`token: str =`, `var token string =`,
`char token[] =`), subscripts, `set("token", ...)`, `#define`, XML elements, and `name`/`value` pairs as in environment
lists. A literal is quoted (with escapes, also escaped itself), triple quoted, a YAML block, bare, or several strings
joined by an operator or by standing side by side; each is of any length, and each line or part of it becomes a span. Names
bound once to a literal are constants; where a name is assigned another name, the constant's literal
is propagated to it. A literal is then scored by its target names (how sensitive their words are) and
its form, and reported as kind `literal` at 1.0 or more. Quoted text with blanks is no secret; it is read for pairs inside.

Defined cases: null text is empty and has no span; positions are code points, end exclusive; rows are
scanned one by one, so ties, repeats and ids play no part; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .textkit import trimmed

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN = 12

#: Words of a target name and how sensitive each is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.8,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.5, "bearer": 0.7, "private": 0.5,
    "access": 0.4, "key": 0.5, "signing": 0.4, "encryption": 0.4, "session": 0.3, "salt": 0.4, "pin": 0.4,
}
#: Where a literal may follow: a target in its syntax, up to the operator. No part of a run is given back and runs of
#: neighbouring targets don't overlap, so reading is linear without bounds.
TARGET = re.compile(
    r"""
    (?<![A-Za-z0-9_.\-])[0-9.\-]*+
    (?:(?:var|const)[\x20\t]++(?P<decl>[A-Za-z_][A-Za-z0-9_]*+)[\x20\t]++(?=[A-Za-z_]))?+      # var token string =
    (?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)
    (?:\\?["'`])?+\]?+(?:\[[^\[\]\n"']*+\])?+\??+[\x20\t]*+                                     # "token": x["token"] token[] =
    (?: :[\x20\t]*+(?:[&*](?:'[a-z]++\x20)?+)?+(?P<type>[A-Za-z_](?:[A-Za-z0-9_.]|::)*+)        # token: &'static str =
        (?:[<\[][A-Za-z0-9_.,\x20<>\[\]|]*+)?+\??[\x20\t]*+=(?![=>])
      | :=|=>|=(?!=)|: )
    | (?:define|putenv|setenv|getenv|setdefault|setProperty|put|set)\(\s*+["'](?P<arg>[A-Za-z_][A-Za-z0-9_.\-]*+)["']\s*+,  # set("token", x)
    | \#[\x20\t]*+define[\x20\t]++(?P<macro>[A-Za-z_][A-Za-z0-9_]*+)[\x20\t]
    | <(?P<tag>[A-Za-z_][A-Za-z0-9_.:\-]*+)(?:\s[^<>]*+)?+>(?P<inner>[^<>]*+)(?=</)            # <token>x</token>
    """,
    re.ASCII | re.VERBOSE,
)
GAP = re.compile(r"[\x20\t]*+(?:/\*[^*\n]*+\*/[\x20\t]*+)?+(?:\\?\r?\n[\x20\t]*+(?=[\"'`(]))?+(?P<paren>\(\s*+)?+", re.ASCII)
STRING = re.compile(
    r"""(?:[rbfuRBFUL@$]{1,2}(?=["'`]))?+(?:
        \"{3}(?P<t2>(?s:.*?))\"{3} | '{3}(?P<t1>(?s:.*?))'{3}
      | "(?P<dq>(?:[^"\\\n]++|\\.)*+)" | '(?P<sq>(?:[^'\\\n]++|\\.)*+)' | `(?P<bq>[^`]*+)`
      | \\"(?P<e2>[^"\\\n]*+)\\?" | \\'(?P<e1>[^'\\\n]*+)\\?' )""",
    re.ASCII | re.VERBOSE,
)
JOINER = re.compile(r"\s*+(?:\+|\.\.?|&|\|\|)\s*+|[\x20\t]*+\\\r?\n[\x20\t]*+|[\x20\t]++(?=[\"'`])", re.ASCII)
BARE = re.compile(r"[A-Za-z0-9+/_.=$\-@!#%^*~?]++", re.ASCII)
BLOCK = re.compile(r"[|>][+\-0-9]*+[\x20\t]*+\r?\n", re.ASCII)
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z", re.ASCII)
SYMBOL = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+", re.ASCII)
SPACE = re.compile(r"\s+")
LINE = re.compile(r"[^\s\\](?:[^\n]*[^\s\\])?")
#: Targets whose value names the next pair's literal, and the targets of that literal.
NAMING, NAMED = {"name", "key", "id"}, {"value", "val", "content", "default"}
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.ASCII)


def name_score(name: str) -> float:
    """0 to 1.5: the two most sensitive words of a name, written in snake, kebab, dot or camel case."""
    best = sorted((SENSITIVE.get(w.lower(), 0.0) for w in WORD.findall(name)), reverse=True)
    return min(1.5, sum(best[:2]))


def literal_score(text: str) -> float:
    """0 to 1: length, number of character classes and entropy; 0 for what is surely no secret."""
    if len(text) < 8 or any(c.isspace() for c in text) or text.startswith(("http:", "https:", "${", "<", "{{")):
        return 0.0
    n = len(text)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    if entropy < 2.5:
        return 0.0
    classes = sum(bool(re.search(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.2 * classes + 0.1 * max(0.0, entropy - 2.5) + 0.01 * min(n, 40))


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, where the value starts) of the base patterns."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def _block(text: str, line: int, at: int) -> int:
    """Where the lines end that follow `at` and are indented more than the line that begins at `line`, or blank."""
    indent = re.compile(r"[\x20\t]*+(?:-[\x20\t]++)?+").match(text, line).end() - line
    row, end = re.compile(rf"(?:[\x20\t]{{{indent + 1}}}[^\n]*+|[\x20\t\r]*+)(?:\n|\Z)"), at
    while at < len(text) and (m := row.match(text, at)) and m.end() > at:
        at = m.end()
        end = at if m[0].strip() else end
    return end


def _pieces(text: str, a: int, b: int, block: bool = False) -> list[tuple[int, int]]:
    """The lines of a literal, without what indents and continues them and without the marks of a PEM block."""
    if not block and "\n" not in text[a:b]:
        return [(a, b)]
    return [m.span() for m in LINE.finditer(text, a, b) if not m[0].startswith("-----")]


def pairs(text: str):
    """(names, pieces of the literal, names it is assigned from) of each pair, in order."""
    at, naming = 0, None
    while m := TARGET.search(text, at):
        names = {m[k] for k in ("decl", "name", "type", "arg", "macro", "tag") if m[k]}
        parts: list[tuple[int, int]] = []
        sources: list[str] = []
        at = m.end()
        if m["tag"]:
            value = m["inner"].strip()
            start = m.start("inner") + m["inner"].find(value)
            parts = _pieces(text, start, start + len(value))
            resume = at if not any(map(str.isspace, value)) else m.start("inner")
        else:
            gap = GAP.match(text, at)
            start = resume = gap.end()
            inside = gap["paren"] is not None
            if text[at - 1] == ":" and (block := BLOCK.match(text, start)):
                end = _block(text, text.rfind("\n", 0, m.start()) + 1, block.end())
                parts = _pieces(text, block.end(), end, True)
                resume = end if not any(c.isspace() for p in parts for c in text[slice(*p)]) else block.end()
            elif string := STRING.match(text, start):
                while string:
                    a, b = string.span(string.lastgroup)
                    prose = string.lastgroup not in ("t1", "t2") and any(map(str.isspace, text[a:b]))
                    if prose and parts:
                        break
                    parts += _pieces(text, a, b)
                    resume = a if prose else string.end()
                    join = None if prose else JOINER.match(text, resume) or (inside and SPACE.match(text, resume)) or None
                    string = join and STRING.match(text, join.end())
                    if join and not string and join[0].strip() and (s := SYMBOL.match(text, join.end())):
                        sources.append(s[0])
            elif bare := BARE.match(text, start):
                parts, resume = [bare.span()], bare.end()
                if text[bare.end() : bare.end() + 1] == "(":
                    parts = []  # a call
                elif IDENTIFIER.match(bare[0]):
                    sources.append(bare[0])
                    join = JOINER.match(text, bare.end())
                    if join and join[0].strip() and (string := STRING.match(text, join.end())) and not any(map(str.isspace, string[string.lastgroup])):
                        parts, resume = _pieces(text, *string.span(string.lastgroup)), string.end()
        if parts:
            word = min(names).lower() if len(names) == 1 else ""
            if naming and word in NAMED:
                names.add(naming)
            naming = text[slice(*parts[0])] if word in NAMING and len(parts) == 1 else None
            yield names, tuple(parts), sources
        at = resume if m["tag"] else max(resume, at)


def literal_spans(text: str) -> list[tuple[int, int, int, int]]:
    """Scored literals of the name-literal pairs, constants propagated."""
    if not any(c in text for c in "=:<,#"):
        return []
    literals: dict[tuple, set[str]] = {}
    bound: dict[str, tuple | None] = {}
    alias: list[tuple[str, str]] = []
    hop: dict[tuple, str] = {}  # literals that are names themselves
    for names, at, sources in pairs(text):
        alias += [(name, source) for name in names for source in sources]
        if len(at) == 1 and sources == [text[slice(*at[0])]]:
            hop[at] = sources[0]
        literals.setdefault(at, set()).update(names)
        for name in names:
            bound[name] = None if name in bound and bound[name] != at else at
    final: dict[str, tuple[int, int] | None] = {}

    def literal_of(name):
        """Where the literal stands that a name's chain of constants ends at; none for circles."""
        path = set()
        while name not in final:
            at = bound.get(name)
            if name in path:
                final[name] = None
            elif at is None or bound.get(hop.get(at)) is None:
                final[name] = at
            else:
                path.add(name)
                name = hop[at]
        final.update(dict.fromkeys(path, final[name]))
        return final[name]

    for target, source in alias:
        if source != target and (at := literal_of(source)) is not None:
            literals[at].add(target)
    out = []
    for at, names in literals.items():
        if "." in hop.get(at, "") and not re.search("[0-9]", hop[at]):
            continue  # a.b.c refers to something
        named = max(map(name_score, names))
        value = "".join(text[a:b] for a, b in at)
        if named >= 0.5 and named * 0.6 + (s := literal_score(value)) >= 1.0 and s >= 0.4:
            out += [(a, 3, b, a) for a, b in at if a < b]
    return sorted(set(out))


def scan(text: str) -> tuple[list, list]:
    """(base, all) spans, each sorted by start, then kind."""
    base = base_spans(text)
    seen = {(v, e) for _, _, e, v in base} | {(s, e) for s, _, e, _ in base}
    return base, sorted(base + [x for x in literal_spans(text) if (x[0], x[2]) not in seen])


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def redact(text: str, spans, mark: str = "[secret]") -> str:
    """The values of all spans replaced; overlapping ones by one mark."""
    out, at = [], 0
    for v, e in sorted((v, e) for _, _, e, v in spans):
        if v >= at:
            out += [text[at:v], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _scan_batches(it):
    for batch in it:
        n = [[], [], []]
        sha, joined, cleaned = [], [], []
        for text in batch.column("text").to_pylist():
            base, every = scan(text or "")
            count = Counter(k for _, k, _, _ in base)
            for k in range(3):
                n[k].append(count[k])
            sha.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            joined.append(_joined(every))
            cleaned.append(redact(text, every) if every else text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(joined, pa.string()), pa.array(cleaned, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, redacted (null where text is)."""
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(_scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")


def _redact_batches(it):
    for batch in it:
        at = batch.schema.get_field_index("text")
        texts = batch.column(at).to_pylist()
        cleaned = [redact(t, spans) if t and (spans := scan(t)[1]) else t for t in texts]
        batch = batch.set_column(at, batch.schema.field(at), pa.array(cleaned, pa.string()))
        size = batch.schema.get_field_index("n_chars")
        if size >= 0:
            n = [c if a == b else len(b) for a, b, c in zip(texts, cleaned, batch.column(size).to_pylist(), strict=True)]
            batch = batch.set_column(size, batch.schema.field(size), pa.array(n, batch.schema.field(size).type))
        yield batch


def redacted(docs: DataFrame) -> DataFrame:
    """docs, same columns, with the values of all spans replaced (and n_chars, if there, to match)."""
    return docs.mapInArrow(trimmed(_redact_batches), docs.schema)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("redacted")
