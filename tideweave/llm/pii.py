"""Personal data and secrets in texts, with Spark SQL functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and range checks confirm them, words close before a
span adjust its score. All work is a projection of the text column: no shuffle, no Python.

Positions: the pieces between matches and the matches themselves give every offset by running sums; the sums run
in blocks, so that many matches in one text cost little more than in proportion. Repeats are possessive and starts are
anchored at the start of a run, so that no text takes quadratic time or deep recursion.

Defined results: a null text is treated as empty and has no spans; repeated rows each have their own result; an
empty table gives an empty result; columns other than the id and the text are ignored. Offsets are code points,
the end exclusive. Kinds are searched independently, so spans of different kinds may overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.llm.common import table

#: Matches whose offsets are summed together.
BLOCK = 64
#: Code points before a span in which context words count.
NEAR = 40
#: Spans of the kinds that aren't always kept need this score.
KEEP = 0.5


@dataclass(frozen=True)
class Kind:
    """gate: a cheap test of the text; regex: Java's; plain: the same language for engines without lookbehind;
    valid: SQL over m, the match; score: of a valid match; words: context that adds 0.4 to it."""

    name: str
    gate: str
    regex: str
    plain: str
    valid: str
    score: float
    words: str
    base: bool = True


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({d})), 0L, (a, i) -> a + CASE WHEN i % 2 = 0 "
    "THEN (2 * int(substring({d}, length({d}) - i + 1, 1))) div 10 + (2 * int(substring({d}, length({d}) - i + 1, 1))) % 10 "
    "ELSE int(substring({d}, length({d}) - i + 1, 1)) END, a -> a % 10 = 0)"
).format(d=_DIGITS)
_BARE = "regexp_replace(m, ' ', '')"
_MOD97 = (
    "aggregate(filter(split(concat(substring({b}, 5), substring({b}, 1, 4)), ''), c -> c <> ''), 0, (a, c) -> "
    "CASE WHEN c BETWEEN '0' AND '9' THEN (a * 10 + int(ascii(c)) - 48) % 97 ELSE (a * 100 + int(ascii(c)) - 55) % 97 END, a -> a = 1)"
).format(b=_BARE)

KINDS = (
    Kind(
        "email", "instr({t}, '@') > 0",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "true", 0.9, "mail|contact|write",
    ),
    Kind(
        "ip", "instr({t}, '.') > 0",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND int(concat('0', right(ltrim('0', p), 3))) <= 255)",
        0.6, "address|host|server|ip",
    ),
    Kind(
        "card", "true",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"[0-9]([\x20-]?[0-9])+",
        f"CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END",
        0.8, "card|visa|credit|pay",
    ),
    Kind(
        "phone", "instr({t}, '+') > 0",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        f"length({_DIGITS}) BETWEEN 9 AND 15",
        0.6, "phone|call|tel|mobile",
    ),
    Kind(
        "iban", "true",
        r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
        r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
        f"CASE WHEN length({_BARE}) BETWEEN 15 AND 34 THEN {_MOD97} ELSE false END",
        0.8, "iban|account|bank", False,
    ),
    Kind(
        "nid", "instr({t}, '-') > 0",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "left(m, 3) NOT IN ('000', '666') AND substring(m, 5, 2) <> '00' AND right(m, 4) <> '0000'",
        0.3, "ssn|social|security|passport", False,
    ),
    Kind(
        "secret", "instr({t}, 'AKIA') > 0 OR rlike({t}, '[=:]')",
        r"(?:[Tt]oken|TOKEN|[Pp]assword|PASSWORD|[Ss]ecret|SECRET|[Aa]pi_?[Kk]ey|API_?KEY) ?[=:] ?[\x22\x27]?[A-Za-z0-9_/+-]{16,}|AKIA[0-9A-Z]{16}",
        r"(?:[Tt]oken|TOKEN|[Pp]assword|PASSWORD|[Ss]ecret|SECRET|[Aa]pi_?[Kk]ey|API_?KEY) ?[=:] ?[\x22\x27]?[A-Za-z0-9_/+-]{16,}|AKIA[0-9A-Z]{16}",
        "true", 0.7, "key|access|login|credential", False,
    ),
)


def _spans(kind: Kind) -> str:
    """SQL over the columns txt, found (matches) and gaps (what lies between): array of spans."""
    context = f"rlike(lower(substring(txt, greatest(s.b - {NEAR - 1}, 1), least(s.b, {NEAR}))), '\\\\b(?:{kind.words})')"
    local = (
        f"transform(sequence(0, (size(found) - 1) div {BLOCK}), k -> aggregate("
        f"arrays_zip(slice(gaps, k * {BLOCK} + 1, {BLOCK}), slice(found, k * {BLOCK} + 1, {BLOCK})), "
        "named_struct('at', 0, 'out', cast(array() AS array<struct<b:int,m:string>>)), "
        "(a, x) -> CASE WHEN x['1'] IS NULL THEN a ELSE named_struct('at', a.at + length(x['0']) + length(x['1']), "
        "'out', concat(a.out, array(named_struct('b', a.at + length(x['0']), 'm', x['1'])))) END))"
    )
    bases = "aggregate(blocks, named_struct('at', 0, 'out', cast(array() AS array<int>)), (a, x) -> named_struct('at', a.at + x.at, 'out', concat(a.out, array(a.at))), a -> a.out)"
    whole = f"flatten(zip_with(blocks, {bases}, (x, base) -> transform(x.out, y -> named_struct('b', base + y.b, 'm', y.m))))"
    checked = f"filter({whole}, s -> exists(array(s.m), m -> {kind.valid}))"
    scored = f"transform({checked}, s -> named_struct('kind', '{kind.name}', 'start', s.b, 'end', s.b + length(s.m), 'text', s.m, 'score', {kind.score}D + CASE WHEN {context} THEN {min(0.4, round(1 - kind.score, 2))}D ELSE 0D END))"
    kept = scored if kind.base else f"filter({scored}, s -> s.score >= {KEEP})"
    return kept.replace("aggregate(blocks", f"aggregate({local}").replace("zip_with(blocks", f"zip_with({local}")


_EMPTY = "cast(array() AS array<struct<kind:string,start:int,end:int,text:string,score:double>>)"


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, and for each kind a column with its spans: array<struct<kind, start, end, text, score>>."""
    out = df.select(id_col, F.coalesce(df[text_col].cast("string"), F.lit("")).alias("txt"))
    for k in KINDS:
        regex = k.regex.replace("\\", "\\\\")
        gate = k.gate.format(t="txt")
        out = out.withColumn("found", F.expr(f"CASE WHEN {gate} THEN regexp_extract_all(txt, '{regex}', 0) END"))
        out = out.withColumn("gaps", F.expr(f"CASE WHEN size(found) > 0 THEN split(txt, '{regex}', -1) END"))
        out = out.withColumn(k.name, F.expr(f"CASE WHEN size(found) > 0 THEN {_spans(k)} ELSE {_EMPTY} END")).drop("found", "gaps")
    return out.drop("txt")


def _joined(parts: str) -> str:
    return f"array_join(transform({parts}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document, and the highest of their scores (0 without spans)."""
    spans = pii_spans(table(spark, sf_dir, "documents"))
    base, every = (f"concat({', '.join(k.name for k in KINDS if k.base or part)})" for part in (False, True))
    return spans.select(
        "doc_id",
        *(F.expr(f"bigint(size({k.name}))").alias(f"n_{k.name}") for k in KINDS if k.base),
        F.expr(f"sha2({_joined(base)}, 256)").alias("base_sha256"),
        F.expr(_joined(every)).alias("spans"),
        F.expr(f"bigint(size({every}))").alias("n_spans"),
        F.expr(f"round(coalesce(array_max(transform({every}, s -> s.score)), 0D), 2)").alias("max_score"),
    )


def _oracle() -> str:
    """The same spans in DuckDB: plain regular expressions, offsets by list functions."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (2 * CAST(substring({digits}, length({digits}) - i + 1, 1) AS INT)) // 10 + (2 * CAST(substring({digits}, length({digits}) - i + 1, 1) AS INT)) % 10 ELSE CAST(substring({digits}, length({digits}) - i + 1, 1) AS INT) END)) % 10 = 0"
    bare = "replace(m, ' ', '')"
    mod = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substring({bare}, 5) || substring({bare}, 1, 4), ''), lambda c: CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(ltrim(p, '0'), 3) AS INT) > 255)) = 0",
        "card": f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"CASE WHEN length({bare}) BETWEEN 15 AND 34 THEN {mod} ELSE false END",
        "nid": "left(m, 3) NOT IN ('000', '666') AND substring(m, 5, 2) <> '00' AND right(m, 4) <> '0000'",
        "secret": "true",
    }
    parts = []
    for n, k in enumerate(KINDS):
        near = f"regexp_matches(lower(substring(txt, greatest(b - {NEAR - 1}, 1), least(b, {NEAR}))), '\\b(?:{k.words})')"
        score = "" if k.base or k.score >= KEEP else f" AND {near}"
        parts.append(
            f"SELECT row, {n} AS kind_no, '{k.name}' AS kind, b, b + length(m) AS e, {k.score} + CASE WHEN {near} THEN {min(0.4, round(1 - k.score, 2))} ELSE 0 END AS score FROM ("
            "SELECT row, txt, found[i] AS m, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS INT) AS b FROM ("
            f"SELECT row, txt, found, gaps, unnest(range(1, len(found) + 1)) AS i FROM (SELECT row, txt, regexp_extract_all(txt, '{k.plain}') AS found, string_split_regex(txt, '{k.plain}') AS gaps FROM d))) WHERE {valid[k.name]}{score}"
        )
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k.name}') AS BIGINT) AS n_{k.name}" for k in KINDS if k.base)
    bases = ", ".join(f"'{k.name}'" for k in KINDS if k.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS txt FROM documents),
s AS ({' UNION ALL '.join(parts)}),
g AS (SELECT row, {counts},
  coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY kind_no, b) FILTER (kind IN ({bases})), '') AS base,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY kind_no, b) AS spans, count(*) AS n_spans, max(score) AS max_score FROM s GROUP BY row)
SELECT doc_id, {', '.join(f'coalesce(n_{k.name}, 0) AS n_{k.name}' for k in KINDS if k.base)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_spans, 0) AS n_spans, CAST(round(coalesce(max_score, 0), 2) AS DOUBLE) AS max_score
FROM d LEFT JOIN g USING (row)
"""


ORACLE_SQL = _oracle()
