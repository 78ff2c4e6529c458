"""Secret scans by a trigram inverted index, with DataFrame functions only.

A Boolean query over trigrams is derived from each rule's regular expression: what a match must contain.  The index
maps each trigram that some query names to the documents that hold it; postings are intersected (and united, for
alternatives), and only the documents that remain are verified with the expression itself.  Rules without a mandatory
trigram scan all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import doc_columns, written

#: Alternatives that a query spells out at most; beyond, a part asks for nothing.
SPELLED = 48


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0  # what `least` measures
    least: int = 0
    base: bool = True


# The base rules, in the order of their kinds.  A maximal run that is too short holds no longer match, so `hex` and
# `access` state their length outright; `assign` must not, as a dropped match still takes its characters.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("header", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", base=False),
)

Query = "frozenset[frozenset[str]] | None"  # any of these sets of trigrams, each wholly; None: all documents


def _tri(text: str) -> frozenset[str]:
    low = text.lower()
    return frozenset(low[i : i + 3] for i in range(len(low) - 2))


def _either(a, b):
    return None if a is None or b is None or len(a | b) > SPELLED else a | b


def _both(a, b):
    if a is None or b is None:
        return b if a is None else a
    joined = frozenset(x | y for x in a for y in b)
    return joined if len(joined) <= SPELLED else min(a, b, key=len)


def _of_strings(strings: frozenset[str]):
    found = frozenset(map(_tri, strings))
    return None if frozenset() in found else found


def _walk(items) -> tuple[frozenset[str] | None, object]:
    """(all strings that the items match, if they can be spelled out; what any match must contain)."""
    exact, query, run = frozenset([""]), None, frozenset([""])
    for op, value in items:
        strings, must = _one(op, value)
        if strings is not None and run is not None and len(run) * len(strings) <= SPELLED:
            run = frozenset(a + b for a in run for b in strings)
            exact = None if exact is None else frozenset(a + b for a in exact for b in strings)
        else:
            query = _both(_both(query, _of_strings(run)), must if strings is None else _of_strings(strings))
            run, exact = frozenset([""]), None
    return exact, _both(query, _of_strings(run))


def _one(op, value) -> tuple[frozenset[str] | None, object]:
    if op is ops.LITERAL:
        return frozenset([chr(value).lower()]), None
    if op is ops.IN and all(k is ops.LITERAL for k, _ in value) and len(value) <= 6:
        return frozenset(chr(v).lower() for _, v in value), None
    if op is ops.SUBPATTERN:
        return _walk(value[3])
    if op is ops.BRANCH:
        parts = [_walk(x) for x in value[1]]
        if all(s is not None for s, _ in parts):
            return frozenset().union(*(s for s, _ in parts)), None
        must = frozenset()
        for strings, q in parts:
            must = _either(must, q if strings is None else _of_strings(strings))
        return None, must
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        low, high, inner = value
        strings, must = _walk(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, None
        if low == high and strings is not None and len(strings) == 1:
            return frozenset(s * low for s in strings), None
        return None, (must if strings is None else _of_strings(strings)) if low else None
    if op is ops.AT:
        return frozenset([""]), None
    return None, None


def trigram_query(regex: str):
    """What every match of a regular expression must contain, as alternatives of sets of lower-case trigrams; None if nothing."""
    exact, query = _walk(parser.parse(regex))
    query = query if exact is None else _both(query, _of_strings(exact))
    return None if query is None else frozenset(q for q in query if not any(other < q for other in query))


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index over rows (doc_id, mark, text): (trigram, doc_id, mark), for the given trigrams."""
    pattern = "(?=(" + "|".join(re.escape(t) for t in trigrams) + "))"
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(1)))
    return rows.select(F.explode(held).alias("trigram"), "doc_id", "mark")


def intersect(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(doc_id, mark, and a column for each kind): documents that a query leaves, from postings alone."""
    trigrams = sorted({t for q in queries.values() for part in q for t in part})
    words = [trigrams[i : i + 62] for i in range(0, len(trigrams), 62)]
    one = lambda w: F.coalesce(*[F.when(F.col("trigram") == t, F.lit(1 << i).cast("long")) for i, t in enumerate(w)], F.lit(0).cast("long"))
    masks = [F.bit_or(one(w)).alias(f"m{k}") for k, w in enumerate(words)]
    found = index.groupBy("doc_id", "mark").agg(*masks)

    def fits(query) -> Column:
        any_of = F.lit(False)
        for part in sorted(query, key=sorted):
            all_of = F.lit(True)
            for k, w in enumerate(words):
                if own := sum(1 << i for i, t in enumerate(w) if t in part):
                    all_of = all_of & (F.col(f"m{k}").bitwiseAND(F.lit(own)) == F.lit(own))
            any_of = any_of | all_of
        return any_of

    marked = found.select("doc_id", "mark", *[fits(q).alias(kind) for kind, q in queries.items()])
    keep = F.lit(False)
    for kind in queries:
        keep = keep | F.col(kind)
    return marked.filter(keep)


def spans(rule: Rule, order: int) -> str:
    """SQL for all matches of a rule in `text`, as (start, order, end, kind); places count code points.

    Places follow from lengths: the text is cut at the matches, and pieces and matches add up in turn.
    """
    regex = rule.regex.replace("'", "\\x27")
    one = f"regexp_extract_all(text, r'{regex}', 0)"
    measured = f"length(regexp_extract(x.m, r'{regex}', {rule.group})) >= {rule.least}" if rule.least else "true"
    empty = "cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)"
    walked = f"""aggregate(zip_with({one}, split(text, r'{regex}', -1), (m, g) -> struct(m, g)), struct(0 as at, {empty} as found),
        (acc, x) -> if(x.m is null, acc, struct(acc.at + length(x.g) + length(x.m) as at,
            if({measured}, concat(acc.found, array(struct(acc.at + length(x.g) as start, {order} as ord, acc.at + length(x.g) + length(x.m) as end, '{rule.kind}' as kind))), acc.found) as found)),
        acc -> acc.found)"""
    return f"if(text rlike r'{regex}', {walked}, {empty})"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text: doc_id, found: array of (start, ord, end, kind) by start, then rule order.

    Places are code points, ends exclusive; matches of one rule are leftmost and don't overlap.  Null and empty texts
    have none.  Repeated rows give repeated results, an empty table an empty one; other columns are ignored.

    Candidates are a saved table of ids; texts only meet them by a join that Spark sizes from that table (broadcast if
    it is small, by shuffle of the texts otherwise).
    """
    return _marked(docs, rules, id_col, text_col).select("doc_id", "found")


def without_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with each secret of find_secrets() replaced by its kind in brackets; overlapping ones are replaced as one.

    All columns stay as they are but the text and, if there is one, the column with its length.
    """
    step = """if(x.start >= acc.at, struct(x.end as at, concat(acc.out, substring(text, acc.at + 1, x.start - acc.at), '[', x.kind, ']') as out),
        if(x.end > acc.at, struct(x.end as at, acc.out as out), acc))"""
    clean = f"if(size(found) = 0, row.`{text_col}`, aggregate(found, struct(0 as at, '' as out), (acc, x) -> {step}, acc -> concat(acc.out, substring(text, acc.at + 1, length(text)))))"
    rows = _marked(docs, rules, id_col, text_col).select("row", F.expr(clean).alias("clean"))
    own = {text_col: F.col("clean")}
    if length_col in docs.columns:
        own[length_col] = F.length("clean").cast(docs.schema[length_col].dataType)
    return rows.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _marked(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(row: all columns of docs, doc_id, text, found)."""
    rows = doc_columns(docs, F.struct("*").alias("row"), id_col=id_col, text_col=text_col).withColumn("mark", F.xxhash64("text"))
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    empty = "cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)"
    scanned = [F.expr(spans(r, i)) if queries[r.kind] is None else F.expr(empty) for i, r in enumerate(rules)]
    if indexed:
        trigrams = sorted({t for q in indexed.values() for part in q for t in part})
        candidates = written(intersect(postings(rows, trigrams), indexed), "candidates")
        rows = rows.alias("d").join(candidates.select(F.col("doc_id").alias("c_id"), F.col("mark").alias("c_mark"), *indexed), F.col("d.doc_id").eqNullSafe(F.col("c_id")) & (F.col("d.mark") == F.col("c_mark")), "left")
        scanned = [F.expr(f"if(coalesce({r.kind}, false), {spans(r, i)}, {empty})") if r.kind in indexed else scanned[i] for i, r in enumerate(rules)]
    return rows.select("row", "doc_id", "text", F.array_sort(F.concat(*scanned)).alias("found"))
