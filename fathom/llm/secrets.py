"""Secret scans over a trigram inverted index; DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived: every text the rule matches satisfies it. The
index holds, for each trigram that some query names, the ids of the texts with it. Intersecting the posting lists by a query
gives the candidates of that rule, and only these run the regular expression. A rule whose expression forces no trigram
scans every text.

Trigrams are taken from texts with A-Z lower-cased, so a query also serves expressions that ignore case.

Defined cases: a null text counts as empty and has no spans; rows with a null id are candidates of every rule; rows that
share an id share its postings and are verified one by one; matches of a rule never overlap, the leftmost wins; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.plans.scratch import Scratch

try:
    from re import _constants as rc
    from re import _parser as rp
except ImportError:  # before Python 3.11
    import sre_constants as rc
    import sre_parse as rp


@dataclass(frozen=True)
class Rule:
    """group: what least_chars counts in a match; shorter matches are dropped after matching."""

    kind: str
    pattern: str
    group: int
    least_chars: int


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)

SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
MAX_STRINGS = 64  # of an expression's exact strings that are followed at once


def _trigrams(strings: set[str]) -> tuple | None:
    """All of these texts' trigrams: an OR over strings of an AND over trigrams; None if a string forces none."""
    ways = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in ways or not ways:
        return None
    least = [w for w in ways if not any(v < w for v in ways)]  # a way that holds whenever a larger one does stands for it
    return "or", tuple(sorted(map(tuple, map(sorted, least))))


def trigram_query(pattern: str) -> list[tuple]:
    """A conjunction of clauses ("or", ways); a way is a tuple of trigrams that must all be there. Empty: no mandatory trigram."""
    clauses: list[tuple] = []

    def flush(run: set[str]) -> set[str]:
        if (clause := _trigrams(run)) and clause not in clauses:
            clauses.append(clause)
        return {""}

    def strings(nodes) -> set[str] | None:
        """Every string that these nodes match, if these are few."""
        run = {""}
        for op, arg in nodes:
            if op is rc.LITERAL:
                more = {chr(arg).lower()}
            elif op is rc.IN and len(arg) <= 4 and all(o is rc.LITERAL for o, _ in arg):
                more = {chr(a).lower() for _, a in arg}
            elif op is rc.SUBPATTERN:
                more = strings(arg[3])
            elif op is rc.BRANCH:
                ways = [strings(x) for x in arg[1]]
                more = None if None in ways else set().union(*ways)
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[1] <= 2:
                one = strings(arg[2])
                more = None if one is None else set().union(*[_power(one, n) for n in range(arg[0], arg[1] + 1)])
            else:
                more = None
            if more is None or len(run) * len(more) > MAX_STRINGS:
                return None
            run = {a + b for a in run for b in more}
        return run

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            more = strings([node])
            if more is not None and len(run) * len(more) <= MAX_STRINGS:
                run = {a + b for a in run for b in more}
                continue
            run = flush(run)
            op, arg = node
            if op is rc.SUBPATTERN:
                walk(arg[3])
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] > 0:
                walk(arg[2])
        flush(run)

    walk(rp.parse(pattern))
    return clauses


def _power(strings: set[str], n: int) -> set[str]:
    out = {""}
    for _ in range(n):
        out = {a + b for a in out for b in strings}
    return out


def _holds(query: list[tuple], postings: Column) -> Column:
    """The query over the set of trigrams that the index has for an id."""
    out = F.lit(True)
    for _, ways in query:
        any_way = F.lit(False)
        for way in ways:
            any_way |= F.forall(F.array(*map(F.lit, way)), lambda t: F.array_contains(postings, t))
        out &= any_way
    return out


def postings(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: a row (trigram, id) for each trigram that a rule's query names and each text that has it."""
    grams = sorted({t for r in rules for _, ways in trigram_query(r.pattern) for way in ways for t in way})
    lowered = docs.select(F.col(id_col).alias("_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_low"))
    found = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    return lowered.select("_id", F.explode(found).alias("trigram")).where(F.col("_id").isNotNull())


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """Ids whose posting lists satisfy a rule's query: _id and a flag _may_<kind> for each rule with a query."""
    by_id = index.groupBy("_id").agg(F.collect_set("trigram").alias("_has"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    flags = by_id.select("_id", *[_holds(q, F.col("_has")).alias(f"_may_{k}") for k, q in queries.items()])
    return flags.where(F.greatest(*[F.col(f"_may_{k}") for k in queries], F.lit(False)))


def _matches(rule: Rule, rank: int, text: Column) -> Column:
    """The spans of a rule in a text: array of (start, rank, kind, end), in code points, end exclusive.

    Splitting a text by the expression gives what stands between the matches, so running lengths give the offsets. The arrays
    are built once and paired, never looked up from inside a lambda, which would build them again for every match.
    """
    pattern = _fast(rule)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    if rule.group:
        counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
        sizes = F.zip_with(whole, counted, lambda m, v: F.struct(F.length(m).alias("n"), F.length(v).alias("v")))
    else:
        sizes = F.transform(whole, lambda m: F.struct(F.length(m).alias("n"), F.length(m).alias("v")))
    steps = F.zip_with(gaps, sizes, lambda g, s: F.struct(F.length(g).alias("gap"), s["n"].alias("n"), s["v"].alias("v")))

    def step(acc: Column, s: Column) -> Column:
        start, end = acc["at"] + s["gap"], acc["at"] + s["gap"] + s["n"]
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(s["v"] >= rule.least_chars, F.concat(acc["spans"], F.array(one))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans")), step, lambda acc: acc["spans"])


def _fast(rule: Rule) -> str:
    """For a rule that is one class of characters, its runs of enough length only: such runs are whole matches either way."""
    m = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{m[1]}{{{rule.least_chars},}}" if m and not rule.group else rule.pattern


def secret_spans(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column spans: array of (start, rank, kind, end) by start, then rule order."""
    scratch = Scratch(docs.sparkSession, "secrets")
    flags = scratch.table(candidates(postings(docs, rules, id_col, text_col), rules), "candidates")
    joined = docs.join(flags.withColumnRenamed("_id", "_cand"), docs[id_col] == F.col("_cand"), "left")
    text = F.coalesce(docs[text_col], F.lit(""))
    parts = []
    for rank, rule in enumerate(rules):
        gate = F.rlike(text, F.lit(_fast(rule)))
        if f"_may_{rule.kind}" in flags.columns:
            gate = F.coalesce(F.col(f"_may_{rule.kind}"), docs[id_col].isNull()) & gate
        parts.append(F.when(gate, _matches(rule, rank, text)).otherwise(F.array().cast(SPANS)))
    return joined.select(*[docs[c] for c in docs.columns], F.array_sort(F.concat(*parts)).alias("spans"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def secret_scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document row: doc_id, n_<kind> for each rule, base_sha256, spans."""
    found = secret_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rules)
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("spans", _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in rules]
    return found.select("doc_id", *counts, said.alias("spans")).withColumn("base_sha256", F.sha2("spans", 256))


_ASSIGN = """(?i:(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _oracle() -> str:
    kinds = ((0, "assign", _ASSIGN, 2, 6), (1, "access", "AKIA[A-Z0-9]+", 0, 20), (2, "hex", "[0-9a-f]+", 0, 24))
    parts = []
    for rank, kind, pattern, group, least in kinds:
        parts.append(f"""
  SELECT doc_id, {rank} AS rk, '{kind}' AS kind, st, st + n AS en FROM (
    SELECT doc_id, length(whole[i]) AS n, length(counted[i]) AS v,
           coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) AS st
    FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {group}) AS counted,
             string_split_regex(t, '{pattern}') AS gaps FROM d)))
  WHERE v >= {least}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, count(*) FILTER (rk = 0) AS n_assign, count(*) FILTER (rk = 1) AS n_access, count(*) FILTER (rk = 2) AS n_hex,
             string_agg(kind || ':' || st::BIGINT || ':' || en::BIGINT, ',' ORDER BY st, rk) AS spans FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(spans, '') AS spans, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE_SQL = _oracle()
