"""Secrets in texts, found by one automaton for all rules in one pass over the bytes.

The automaton of all rules together reads a text from its end and marks every byte at which a
match of some rule starts.  From a mark, in the order of the text, the rule's own automaton runs
to the longest end; marks inside a match of the same rule are passed over.  This gives the
leftmost, longest, non-overlapping matches of every rule, in time linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.automata import Automaton, compiled
from goldseam.llm.common import text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``head`` then ``body``, whose match needs ``least`` characters of body."""

    kind: str
    head: str
    body: str
    least: int = 0


# The base rules, and public formats of further secrets.
BASE = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
        r"[A-Za-z0-9+/_.=-]+",
        6,
    ),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 16),
    # A run too short holds no other match, so the length can be part of the pattern.
    Rule("hex", r"", r"[0-9a-f]{24,}"),
)
FURTHER = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r""),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]+", 10),
    Rule("github", r"gh[opsu]_", r"[A-Za-z0-9]+", 36),
    Rule("google", r"AIza", r"[A-Za-z0-9_-]+", 35),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]+", 10),
    Rule("stripe", r"[rs]k_(live|test)_", r"[A-Za-z0-9]+", 16),
)
RULES = BASE + FURTHER

SPANS = "array<struct<kind: string, start: long, end: long>>"


class Scanner:
    """The compiled rules; small, and the same for any input."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        whole = [rule.head + rule.body for rule in rules]
        self.rules = rules
        self.starts: Automaton = compiled(whole, reverse=True, anywhere=True)
        self.wholes = [compiled([pattern]) for pattern in whole]
        self.heads = [compiled([rule.head]) for rule in rules]

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """All (start, number of the rule, end) in bytes, sorted."""
        table, state = self.starts.table, self.starts.start
        accepting, accepts = self.starts.accepting, self.starts.accepts
        marks = []
        for back, kind in enumerate(data.translate(self.starts.kinds)[::-1]):
            state = table[state + kind]
            if state >= accepting:
                marks.append((back, state))
        last, found = [0] * len(self.rules), []
        for back, state in reversed(marks):
            start = len(data) - 1 - back
            for number in accepts[state]:
                if start < last[number]:
                    continue
                end = last[number] = self.wholes[number].longest(data, start)
                if end - self.heads[number].longest(data, start) >= self.rules[number].least:
                    found.append((start, number, end))
        return sorted(found)

    def spans(self, text: str) -> list[dict]:
        """All spans in code points, by start and then in the order of the rules."""
        data = text.encode("utf-8", "surrogatepass")
        found = self.byte_spans(data)
        if found and len(data) != len(text):
            ends = sorted({x for start, _, end in found for x in (start, end)})
            points, at, seen = {}, 0, 0
            for x in ends:
                seen += len(data[at:x].decode("utf-8", "surrogatepass"))
                points[x], at = seen, x
            found = [(points[start], number, points[end]) for start, number, end in found]
        return [
            {"kind": self.rules[number].kind, "start": start, "end": end}
            for start, number, end in found
        ]


def secret_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per row of the input: doc_id and ``spans``, an array of (kind, start, end).

    Places count code points, the end exclusive.  Null and empty texts have no spans; texts are
    read whole, however long; repeated rows give repeated rows, an empty table none.  Other
    columns are not read.
    """
    scanner = Scanner(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner.spans(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"]
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    base = [rule.kind for rule in BASE]

    def joined(spans):
        said = F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        )
        return F.array_join(said, ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
