"""URL filters by a bit-parallel wildcard automaton.

Every glob rule becomes a run of bits in a multiword Shift-And state; one pass over the characters of a
canonical URL advances all rules at once, and numpy advances all URLs of a batch in step. In a glob, `*`
stands for any characters but `/`, `**` for any characters, `?` for one character that isn't `/`.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, and the default
verdict; repeated rows are judged alike, each on its own; an empty table gives an empty result; columns other
than the id and the url are ignored. Where several rules fit, the longest wins, then the one that comes first
in code point order, a block before an allow.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tideweave.llm.common import table

LOWER = {c: c + 32 for c in range(65, 91)}
PARTS = re.compile(r"://([^/?#]*)([^?#]*)")


@dataclass(frozen=True)
class Rule:
    """text is host and path, as in `example.org/es/`; it holds for the host and its subdomains."""

    action: str
    text: str

    def globs(self) -> list[str]:
        return [f"{self.text}**", f"*.{self.text}**"]


#: The rules of the registered query.
RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    found = PARTS.search(url) if url else None
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


class GlobAutomaton:
    """Simulates any number of globs over a batch of strings.

    A glob of m literal characters takes m + 1 bits: an initial state that nothing shifts into, then one state
    for each character. A wildcard is a self-loop on the state before it, so no empty transitions are needed.
    """

    def __init__(self, globs: Iterable[str]):
        parsed = [self._parse(g) for g in globs]
        chars = sorted({c for states in parsed for c, _ in states if c and c != "?"} | {"/"})
        self.points = np.array([ord(c) for c in chars], dtype=np.uint32)
        known = {c: i for i, c in enumerate(chars)}
        bits = sum(len(states) for states in parsed)
        self.words = max(1, -(-bits // 64))
        step = np.zeros((len(chars) + 1, self.words), np.uint64)  # the last class: any other character
        loop, start = np.zeros_like(step), np.zeros(self.words, np.uint64)
        self.accept, at = [], 0
        for states in parsed:
            for k, (char, wild) in enumerate(states):
                word, bit = divmod(at, 64)
                mask = np.uint64(1 << bit)
                if k == 0:
                    start[word] |= mask
                elif char == "?":
                    step[:, word] |= mask
                    step[known["/"], word] &= ~mask
                else:
                    step[known[char], word] |= mask
                if wild:
                    loop[:, word] |= mask
                    if wild == "*":
                        loop[known["/"], word] &= ~mask
                at += 1
            self.accept.append(divmod(at - 1, 64))
        self.step, self.loop, self.start = step, loop, start

    @staticmethod
    def _parse(glob: str) -> list[tuple[str, str]]:
        states: list[tuple[str, str]] = [("", "")]
        for piece in re.findall(r"\*+|[^*]", glob):
            if piece[0] == "*":
                states[-1] = (states[-1][0], "**" if len(piece) > 1 else states[-1][1] or "*")
            else:
                states.append((piece, ""))
        return states

    def matches(self, strings: list[str]) -> np.ndarray:
        """One row for each string, one column for each glob."""
        out = np.zeros((len(strings), len(self.accept)), bool)
        if not strings or not self.accept:
            return out
        lengths = np.array([len(s) for s in strings])
        points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = np.searchsorted(self.points, points)
        classes[(classes == len(self.points)) | (self.points[np.minimum(classes, len(self.points) - 1)] != points)] = len(self.points)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        order = np.argsort(-lengths, kind="stable")
        lengths, begin = lengths[order], begin[order]
        state = np.tile(self.start, (len(strings), 1))
        live = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
        for at, n in enumerate(live):
            c, now = classes[begin[:n] + at], state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.step[c]) | (now & self.loop[c])
        for k, (word, bit) in enumerate(self.accept):
            out[order, k] = (state[:, word] >> np.uint64(bit)) & np.uint64(1) > 0
        return out


def judge(urls: list[str | None], rules: tuple[Rule, ...], default: str) -> tuple[list, list, list, list]:
    """Host, path, rule text (or None) and verdict of each url."""
    ranked = sorted(set(rules), key=lambda r: (-len(r.text), r.text, r.action != "block"))
    automaton = GlobAutomaton(g for r in ranked for g in r.globs())
    parts = [canonical(u) for u in urls]
    hit = automaton.matches([h + p for h, p in parts]).reshape(len(urls), len(ranked), -1).any(axis=2)
    first = np.where(hit.any(axis=1), hit.argmax(axis=1), -1) if ranked else np.full(len(urls), -1)
    won = [ranked[k] if k >= 0 else None for k in first]
    return [h for h, _ in parts], [p for _, p in parts], [r and r.text for r in won], [r.action if r else default for r in won]


def url_filter(
    df: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """id, host, path, rule, verdict for every row of df. No shuffle; only the two columns are read."""
    rules = tuple(rules)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            host, path, rule, verdict = judge(b.column(1).to_pylist(), rules, default)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict))], names=names)

    names = [id_col, "host", "path", "rule", "verdict"]
    schema = T.StructType([df.schema[id_col], *(T.StructField(n, T.StringType()) for n in names[1:])])
    return df.select(id_col, df[url_col].cast("string")).mapInArrow(batches, schema)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the registered query over all pages."""
    return url_filter(table(spark, sf_dir, "pages"), RULES)


def _fits(rule: Rule) -> str:
    host, path = rule.text.split("/", 1)
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"


_RANKED = sorted(RULES, key=lambda r: (-len(r.text), r.text))
ORACLE_SQL = f"""
WITH cut AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages)
SELECT page_id, host, path,
       CASE {' '.join(f"WHEN {_fits(r)} THEN '{r.text}'" for r in _RANKED)} END AS rule,
       CASE {' '.join(f"WHEN {_fits(r)} THEN '{r.action}'" for r in _RANKED)} ELSE 'allow' END AS verdict
FROM cut
"""
