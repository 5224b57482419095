"""Secret scans through a trigram index.

Each rule is a regular expression.  Its parse tree gives a Boolean query over
trigrams that every match must contain (conjunctions for sequences,
disjunctions for alternatives).  The texts of a chunk are indexed once:
postings map each trigram that some rule asks for to the documents holding it.
A rule's candidates come from intersecting and uniting postings, and the
expression itself then verifies whole candidate texts.  A rule that has no
mandatory trigram (a bare character class, say) scans every text.

The index folds A-Z to lower case, so one index serves rules in either case.
Texts are never cut, however long; null is an empty text and has no span.  The
operator is a map over rows: an empty table gives no rows, repeated rows are
scanned alike, extra columns play no part (``redact`` keeps them, whatever
their names).
"""

from __future__ import annotations

import hashlib
import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ridgeline.llm.words import LOWER, chunks, rows, worker_state

#: Exact strings that are followed through a sequence before a query is made of them.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A match counts if this group has at least so many characters.
    group: int = 0
    least: int = 1
    base: bool = False


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else re.escape(c) for c in word)


# The three kinds of the contract, in its order.
_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])
BASE_RULES = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
)
#: Public formats of credentials, beyond the contract's kinds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (no restriction), a trigram (bytes), or ("and" | "or", parts).
Query = bool | bytes | tuple


def _all(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """Holds for each text that has one of the strings."""
    out = []
    for s in sorted(strings):
        b = LOWER[np.frombuffer(s.encode(), np.uint8)].tobytes()
        out.append(_all([b[i : i + 3] for i in range(len(b) - 2)]))
    return _any(out)


def _charset(items: list) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value))
        elif op is sre.RANGE and value[1] - value[0] < MAX_STRINGS:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    folded = {c.lower() if c.isascii() else c for c in found}
    return folded if len(folded) <= 8 else None


def _walk(node) -> tuple[set[str] | None, Query]:
    """The strings that a node matches if they are few, and else what any match must contain."""
    exact: set[str] | None = {""}
    must: list[Query] = []
    for op, value in node:
        part: set[str] | None = None
        query: Query = True
        if op is sre.LITERAL:
            part = {chr(value).lower() if value < 128 else chr(value)}
        elif op is sre.IN:
            part = _charset(value)
        elif op is sre.SUBPATTERN:
            part, query = _walk(value[3])
        elif op is sre.BRANCH:
            branches = [_walk(b) for b in value[1]]
            if all(s is not None for s, _ in branches):
                part = set().union(*(s for s, _ in branches))
            query = _any([_of_strings(s) if s is not None else q for s, q in branches])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, body = value
            inner, inner_query = _walk(body)
            if inner is not None and (least, most) == (0, 1):
                part = inner | {""}
            elif least:
                query = _of_strings(inner) if inner is not None else inner_query
        elif op is sre.AT:
            part = {""}
        if part is not None and exact is not None and len(joined := {a + b for a in exact for b in part}) <= MAX_STRINGS:
            exact = joined
            continue
        # The run of known strings ends here; what it must contain is kept.
        must += [_of_strings(exact) if exact else True, query]
        if part is not None:
            exact = part
        else:
            exact = {""}
            must.append(None)  # marks that the whole is no longer exact
    if None in must or must:
        return None, _all([m for m in must if m is not None] + [_of_strings(exact or {""})])
    return exact, _of_strings(exact or {""})


def trigram_query(pattern: str) -> Query:
    """Boolean trigram query that holds for every text with a match; True if there is no such restriction."""
    strings, query = _walk(sre_parse.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def _trigrams(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set() if query is True else set().union(*map(_trigrams, query[1]))


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


class Index:
    """Postings, over the texts of one chunk, of the trigrams that are asked for."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray, asked: np.ndarray):
        """asked: the codes of the trigrams, ascending; wanted: a mask of them over all codes."""
        self.n, self.asked = len(texts), asked
        buf = LOWER[np.frombuffer(b"\0\0".join(texts) + b"\0\0", np.uint8)]
        at = np.zeros(self.n + 1, np.int64)
        np.cumsum(np.fromiter((len(t) + 2 for t in texts), np.int64, self.n), out=at[1:])
        wide = buf.astype(np.uint32)
        codes = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
        hits = np.flatnonzero(wanted[codes])
        docs = np.searchsorted(at, hits, "right") - 1
        pairs = np.unique(np.searchsorted(asked, codes[hits]) * self.n + docs)
        self.postings = {int(k): pairs[pairs // self.n == k] % self.n for k in np.unique(pairs // max(self.n, 1))} if len(pairs) else {}

    def find(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings.get(int(np.searchsorted(self.asked, _code(query))), np.zeros(0, np.int64))
        op, parts = query
        found = self.find(parts[0])
        for part in parts[1:]:
            if op == "and" and not len(found):
                break
            found = (np.intersect1d if op == "and" else np.union1d)(found, self.find(part))
        return found


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.patterns = [re.compile(r.pattern) for r in rules]
        self.wanted = np.zeros(1 << 24, bool)
        self.asked = np.array(sorted(map(_code, set().union(*map(_trigrams, self.queries)))), np.int64)
        self.wanted[self.asked] = True

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per text its spans (start, rule, end) in code points, in order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not texts:
            return out
        index = Index(texts, self.wanted, self.asked)
        decoded: dict[int, str] = {}
        for k, (rule, query, pattern) in enumerate(zip(self.rules, self.queries, self.patterns, strict=True)):
            for i in index.find(query).tolist():
                if (text := decoded.get(i)) is None:
                    text = decoded[i] = texts[i].decode("utf-8", "replace")
                for m in pattern.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return worker_state(("scanner", rules), lambda: Scanner(rules))


SCAN_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{r.kind}", pa.int64()) for r in BASE_RULES), ("base_sha256", pa.string()), ("spans", pa.string())])


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: counts of each base kind, a digest of base spans, and all spans.

    A span is ``kind:start:end`` in code points, end exclusive; spans are
    ordered by start and then by the order of the rules.  No span: the digest
    of, and the list as, the empty string.  A null doc_id stays null.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for part, texts in chunks(batches):
            found = scanner.scan(texts)
            name = lambda s: f"{rules[s[1]].kind}:{s[0]}:{s[2]}"
            base = [[s for s in spans if rules[s[1]].base] for spans in found]
            counts = [[sum(rules[s[1]].kind == r.kind for s in spans) for spans in base] for r in BASE_RULES]
            digests = [hashlib.sha256(",".join(map(name, spans)).encode()).hexdigest() for spans in base]
            yield rows(SCAN_SCHEMA, part.column(0), *counts, digests, [",".join(map(name, spans)) for spans in found])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return documents.select("doc_id", "text").mapInArrow(scan, schema)


def redact(documents: DataFrame, mask: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """documents with every span (overlapping ones united) replaced by mask, and n_chars to match.

    All columns stay, in their order; texts without a secret stay as they are.
    """
    names = documents.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for start, _, end in spans:
            if start >= at:
                out += [text[at:start], mask]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for part, texts in chunks(batches):
            found = scanner.scan(texts)
            if not any(found):
                yield part
                continue
            columns = list(part.columns)
            new = columns[text_at].to_pylist()
            chars = columns[chars_at].to_pylist() if chars_at is not None else None
            for i, spans in enumerate(found):
                if spans:
                    new[i] = clean(new[i], spans)
                    if chars is not None:
                        chars[i] = len(new[i])
            columns[text_at] = pa.array(new, part.schema.field(text_at).type)
            if chars_at is not None:
                columns[chars_at] = pa.array(chars, part.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return documents.mapInArrow(work, documents.schema)


def explain_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Query]:
    return {r.kind: trigram_query(r.pattern) for r in rules}


__all__ = ["BASE_RULES", "RULES", "Rule", "Scanner", "explain_rules", "find_secrets", "redact", "trigram_query"]
