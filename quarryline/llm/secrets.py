"""Secret scans: fixed patterns, and literals that reach a sensitive name.

Three patterns give the base spans. Beyond them, source and configuration text is lexed as a whole into names, operators,
brackets and literals; each ``name operator value`` becomes a pair, names that stand for constants are followed to the
literals they were given, and a literal is scored by the names it ends up in and by its own look.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType

# The base patterns, least lengths, and the order of kinds at one start.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run of 16 or more; shorter runs hold no longer one
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "literal")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How much a part of a name says that its value is secret, and names that speak of something else.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 2, "apikey": 3, "api_key": 3,
    "access_key": 3, "private_key": 3, "auth_key": 3, "credential": 3, "credentials": 3, "signing_key": 3,
}
HARMLESS = {"file", "path", "url", "uri", "type", "name", "length", "len", "count", "field", "label", "hint", "policy", "ttl"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|<.*>|\.+|your[-_ ]?.*|change[-_ ]?me|none|null|true|false|example.*|placeholder)$")
#: Score from which a literal counts: three points for the name and two for the literal's look, say.
THRESHOLD = 4

#: Words that a sentence has and a passphrase seldom.
SENTENCE = set("a an and are at be for from in is it least must not of on or should that the this to use will with you your".split())
#: Functions whose first argument is the name of a setting and whose further ones stand for it.
GETTERS = {"config", "env", "fetch", "get", "get_env", "get_property", "getenv", "getproperty", "lookup", "setting"}

_LEXEME = re.compile(
    r'''(?P<triple>"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|\x27\x27\x27(?:[^\x27\\]|\\[\s\S]|\x27(?!\x27\x27))*\x27\x27\x27)'''
    r"""|(?P<string>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'|`[^`\n]*`)"""
    r"""|\$\{(?P<braced>[A-Za-z_][\w.-]*)\}|\$(?P<dollar>[A-Za-z_]\w*)"""
    r"""|(?P<carried>\\\r?\n)|(?P<block>[|>][+-]?\d?[ \t]*\n)"""
    r"""|(?P<op>:=|=>|==|!=|<=|>=|[=:+])"""
    r"""|(?P<word>[A-Za-z0-9_][A-Za-z0-9_./+-]*)"""
    r"""|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<line>\n[ \t\r]*(?P<blank>\n)?)|(?P<end>[;,]|//|\#)"""
)
_NAME = re.compile(r"[A-Za-z_][\w.-]*\Z")
_INDENT = re.compile(r"[ \t]*")


@dataclass(frozen=True)
class _Value:
    """A literal with its place, or the name of a constant."""

    text: str
    start: int
    end: int
    name: bool
    quoted: bool


class _Frame:
    """What stands between two brackets, or outside all: the name that waits for its value, what it has been given, and where
    values go that no name of their own is given: to the name in front of the bracket, if there is one."""

    def __init__(self, into: list[_Value] | None = None, getter: bool = False):
        self.into, self.skips = into, getter
        self.target: str | None = None
        self.values: list[_Value] = []
        self.wants = False
        self.last: _Value | None = None


def _lines_of(text: str, start: int, end: int) -> list[_Value]:
    """The lines of a literal that spans several, each without blanks around it."""
    out, at = [], start
    for line in text[start:end].split("\n"):
        body = line.strip()
        if body:
            first = at + line.index(body[0])
            out.append(_Value(body, first, first + len(body), False, True))
        at += len(line) + 1
    return out


def _block_end(text: str, key: int, start: int) -> int:
    """Where the lines end that stand deeper than the line ``key`` is in."""
    depth = len(_INDENT.match(text, text.rfind("\n", 0, key) + 1).group())
    end = at = start
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        if text[at:stop].strip():
            if len(_INDENT.match(text, at, stop).group()) <= depth:
                break
            end = stop
        at = stop + 1
    return end


def _pairs(text: str) -> list[tuple[str, list[_Value]]]:
    """Names with the operands of what they are given, from a whole text.

    A value may stand on the next line, be put together by ``+`` or side by side, be an argument of a call or a member of a
    list, or a block of deeper lines. Names inside brackets have values of their own. A blank line ends whatever is open, so
    that a bracket nobody closes does not reach further.
    """
    out: list[tuple[str, list[_Value]]] = []
    stack: list[_Frame] = []
    frame, at = _Frame(), 0

    def close(f: _Frame) -> None:
        if f.target is not None and f.values:
            out.append((f.target, f.values))
        f.target, f.values, f.wants = None, [], False

    def take(values: list[_Value]) -> None:
        if frame.target is not None and not frame.wants:
            beside = stack and values[0].quoted and frame.values and frame.values[-1].quoted
            if not beside:  # the value is over; this may be the next target
                close(frame)
        if frame.target is not None:
            frame.values += values
            frame.wants = False
        elif frame.into is not None and not frame.skips:
            frame.into += values
        frame.last = values[-1]

    while m := _LEXEME.search(text, at):
        kind, at = m.lastgroup if m.lastgroup != "blank" else "line", m.end()
        if kind == "triple":
            if lines := _lines_of(text, m.start() + 3, m.end() - 3):
                take(lines)
        elif kind in ("string", "word", "braced", "dollar"):
            quoted = kind == "string"
            a, b = (m.start() + 1, m.end() - 1) if quoted else m.span(kind)
            body = text[a:b]
            take([_Value(body, a, b, kind in ("braced", "dollar") or (not quoted and bool(_NAME.match(body))), quoted)])
        elif kind == "block":
            if frame.wants and m.group()[0] in "|>":
                at = _block_end(text, m.start(), m.end())
                if lines := _lines_of(text, m.end(), at):
                    take(lines)
                at = max(at, m.end())
        elif kind == "op" and m.group() in ("=", ":", ":=", "=>"):
            last = frame.last
            if frame.target is not None and len(frame.values) == 1 and frame.values[-1] is last:
                out.append((frame.target, frame.values))  # a = b = "…": the value is itself a target
                frame.target, frame.values = None, []
            if last is not None and (last.quoted or _NAME.match(last.text)):
                if frame.into and frame.into[-1] is last:
                    frame.into.pop()  # the name of an argument
                close(frame)
                frame.target, frame.wants = last.text, True
        elif kind == "op" and m.group() == "+":
            frame.wants = frame.target is not None and bool(frame.values)
        elif kind == "open":
            last = frame.last
            called = last is not None and not last.quoted and text[last.end : m.start()] == ""
            held = frame.values if frame.target is not None else frame.into
            if called and held and held[-1] is last:
                held.pop()  # a function, or what an index looks into
            open_to = held if m.group() == "(" or (m.group() == "[" and not called) else None
            name = _plain(last.text).split("_") if called else [""]
            getter = name[-1] in GETTERS or "_".join(name[-2:]) in GETTERS
            if frame.target is not None:
                frame.wants = False
            frame.last = None
            stack.append(frame)
            frame = _Frame(open_to, getter and m.group() == "(")
        elif kind == "close":
            close(frame)
            if stack:
                frame = stack.pop()
                if m.group() == "}":
                    close(frame)
            frame.last = None
        elif kind == "line":
            if m.group("blank"):
                for f in (frame, *reversed(stack)):
                    close(f)
                frame, stack, at = _Frame(), [], m.end() - 1
            elif not stack and not frame.wants:
                close(frame)
                frame.last = None
        elif kind != "carried":
            if kind != "end" or m.group() == "," or not stack:
                close(frame)
                frame.last = None
            if m.group() == ",":
                frame.skips = False
    for f in (frame, *reversed(stack)):
        close(f)
    return out


def _plain(name: str) -> str:
    """camelCase, dots and dashes as lower_snake."""
    return re.sub(r"[\W]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)).lower().strip("_")


def name_score(name: str) -> int:
    plain = _plain(name)
    parts = plain.split("_")
    if parts[-1] in HARMLESS:
        return 0
    joined = {*parts, *("_".join(parts[i : i + 2]) for i in range(len(parts) - 1))}
    joined |= {p[:-1] for p in joined if p.endswith("s")}  # passwords
    return max((SENSITIVE[p] for p in joined if p in SENSITIVE), default=0)


def literal_score(text: str, quoted: bool) -> int:
    """0 to 3 for length, mixed kinds of characters and entropy; bare words need a digit to count at all. A text of several
    words counts 2 when it is quoted, has a digit and is no sentence: three to eight words, none of them of ``SENTENCE``."""
    if len(text) < 6 or PLACEHOLDER.match(text):
        return 0
    if " " in text:
        words = text.lower().split()
        passphrase = quoted and 3 <= len(words) <= 8 and any(c.isdigit() for c in text) and not SENTENCE.intersection(words)
        return 2 if passphrase else 0
    digit = any(c.isdigit() for c in text)
    if not quoted and not (digit and any(c.isalpha() for c in text)):
        return 0
    entropy = -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())
    return (len(text) >= 8) + (digit and any(c.isalpha() for c in text)) + (entropy >= 3)


def literals(text: str) -> list[tuple[int, int]]:
    """Places of literals that reach a sensitive name, by themselves or through constants."""
    pairs = _pairs(text)
    given: dict[str, list[_Value]] = {}
    for name, values in pairs:
        given.setdefault(_plain(name), []).extend(values)
    if not any(name_score(name) for name in given):
        return []
    found = set()
    for name in given:
        weight = name_score(name)
        if not weight:
            continue
        todo, seen = list(given[name]), {name}
        while todo:  # constants are followed once each, so cycles end
            value = todo.pop()
            known = _plain(value.text)
            if value.name and known in given:
                if known not in seen:
                    seen.add(known)
                    todo += given[known]
            elif weight + literal_score(value.text, value.quoted) >= THRESHOLD and literal_score(value.text, value.quoted):
                found.add((value.start, value.end))
    return sorted(found)


def scan(text: str) -> list[tuple[int, str, int, int]]:
    """``start, kind, end, start of what is secret`` by start, then kind. Literals inside base spans are not repeated."""
    low = text.lower()
    spans = []
    if any(word in low for word in _ASSIGN_WORDS):
        spans += [(m.start(), "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    if ("=" in text or ":" in text) and any(part.split("_")[-1] in low for part in SENSITIVE):
        base = [(a, b) for a, _, b, _ in spans]
        spans += [
            (a, "literal", b, a) for a, b in literals(text) if not any(c <= a and b <= d for c, d in base)
        ]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def redact(text: str, spans: list[tuple[int, str, int, int]], mask: str = "[SECRET]") -> str:
    """The text with each secret value replaced; names stay. Overlapping values become one mask."""
    out, at = [], 0
    for start, end in sorted((s[3], s[2]) for s in spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def _text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end, _ in spans)


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, joined = ([], [], []), [], []
        for value in batch.column(1).cast(pa.binary()).to_pylist():
            spans = scan(_text(value))
            base = [s for s in spans if s[1] != "literal"]
            for column, kind in zip(counts, KINDS):
                column.append(sum(s[1] == kind for s in base))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            joined.append(_joined(spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secret_scan(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (columns ``doc_id`` and ``text``; others are ignored): ``doc_id, n_assign, n_access,
    n_hex, base_sha256, spans``.

    Spans count code points, end exclusive. A null text is an empty one and has no spans; a null ``doc_id`` is carried
    along; repeated rows are scanned one by one; an empty table gives an empty table. Rows are looked at where they are.
    """
    return documents.select("doc_id", "text").mapInArrow(
        _scan_rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact_secrets(documents: DataFrame) -> DataFrame:
    """``documents`` with every secret value masked in ``text``, and ``n_chars`` (where it is a long) counted again.
    Nulls stay null, and texts without secrets stay as they are."""
    at = documents.columns.index("text")
    chars = documents.columns.index("n_chars") if "n_chars" in documents.columns else -1
    if chars >= 0 and documents.schema[chars].dataType != LongType():
        chars = -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at).cast(pa.binary()).to_pylist()
            lengths = batch.column(chars).to_pylist() if chars >= 0 else []
            for i, value in enumerate(values):
                text = _text(value)
                if spans := scan(text):
                    clean = redact(text, spans)
                    values[i] = clean.encode()
                    if lengths:
                        lengths[i] = len(clean)
            columns = list(batch.columns)
            columns[at] = pa.array(values, pa.binary()).cast(batch.column(at).type)
            if lengths:
                columns[chars] = pa.array(lengths, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return documents.mapInArrow(run, documents.schema)
