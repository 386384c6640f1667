"""Secret scans through a trigram index. Column functions only.

Each rule's regular expression gives a Boolean query on trigrams that every match must hold. An index
holds which rows have which of the queries' trigrams; intersecting it gives each rule's candidates, and
only those are matched. A rule without a mandatory trigram is matched against every row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordon.llm.text import LOWER, UPPER, let
from cordon.session import cut


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # matched leftmost, without overlap; no look-around, so that Java and others agree
    keep: str = ""  # a match stays if it has this; empty: all stay
    base: bool = False


#: The base kinds in their order, then those that this method adds.
RULES = [
    Rule("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+",
         r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}$", True),
    Rule("access", r"AKIA[A-Z0-9]+", r"^.{16,}$", True),
    Rule("hex", r"[0-9a-f]{32,}", "", True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
STRINGS = 64  # exact strings of a part of a pattern that are followed at once


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """An AND of ORs of trigram sets, folded to lower case; empty if nothing is mandatory.

    Walks the parsed pattern: a part that is one of few strings grows by what follows; where it can't grow it is
    closed, and each of its strings of three characters or more adds its trigrams (OR between strings, AND between parts)."""
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            clauses.append(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted))

    def exact(items) -> set[str] | None:
        """The strings that a sequence can be, if few."""
        out = {""}
        for op, arg in items:
            if op is C.LITERAL:
                more = {chr(arg)}
            elif op is C.IN and arg[0][0] is not C.NEGATE:
                more = set()
                for kind, x in arg:
                    if kind is C.LITERAL:
                        more.add(chr(x))
                    elif kind is C.RANGE and x[1] - x[0] < STRINGS:
                        more.update(map(chr, range(x[0], x[1] + 1)))
                    else:
                        return None
            elif op is C.SUBPATTERN:
                more = exact(arg[3])
            elif op is C.BRANCH:
                parts = [exact(b) for b in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op is C.MAX_REPEAT and arg[1] <= 3:
                one = exact(arg[2])
                more = None if one is None else {s * n for s in one for n in range(arg[0], arg[1] + 1)}
            else:
                more = None
            if more is None:
                return None
            out = {(a + b).lower() for a in out for b in more}
            if len(out) > STRINGS:
                return None
        return out

    def walk(items) -> None:
        run: set[str] = {""}
        for item in items:
            more = exact([item])
            if more is not None and len(joined := {a + b for a in run for b in more}) <= STRINGS:
                run = joined
                continue
            close(run)
            run = more if more is not None else {""}
            if more is None and item[0] is C.SUBPATTERN:
                walk(item[1][3])
            elif more is None and item[0] is C.MAX_REPEAT and item[1][0] >= 1:
                walk(item[1][2])
        close(run)

    walk(parser.parse(pattern))
    return clauses


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches in code points, end exclusive. The parts between the
    matches, which split() gives, and the matches themselves give the places."""
    gaps, found = F.split(text, rule.pattern), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def step(acc, pair):
        first = acc["at"] + F.length(pair["gap"])
        last = first + F.length(pair["hit"])
        ok = pair["hit"].rlike(rule.keep) if rule.keep else F.lit(True)
        one = F.array(F.struct(first.cast("long").alias("start"), last.cast("long").alias("end")))
        return F.struct(last.cast("long").alias("at"), F.when(ok, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def place(hits):
        pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.when(F.size(hits) == 0, empty).otherwise(F.aggregate(pairs, start, step, lambda acc: acc["out"]))

    return let(found, place)


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, _key): which row holds which of the trigrams, letters A-Z taken as a-z."""
    folded = F.translate(F.col("text"), UPPER, LOWER)

    def present(t):
        return F.array_compact(F.array(*[F.when(t.contains(x), F.lit(i)) for i, x in enumerate(trigrams)]))

    return docs.select("_key", F.explode(let(folded, present)).alias("trigram"))


def candidates(postings: DataFrame, trigrams: list[str], queries: dict[str, list]) -> DataFrame:
    """(_key, _rules): the rules whose query the row's postings satisfy. Postings of a row meet as bits, which
    add up before the shuffle, so that a trigram that all rows hold is no hot group."""
    words = (len(trigrams) + 62) // 63
    bits = [F.bit_or(F.when(F.floor(F.col("trigram") / 63) == w, F.expr("shiftleft(1L, trigram % 63)")).otherwise(F.lit(0).cast("long"))).alias(f"_b{w}") for w in range(words)]
    rows = postings.groupBy("_key").agg(*bits)

    def has(need: frozenset) -> Column:
        out = F.lit(True)
        for w in range(words):
            mask = sum(1 << (i % 63) for i, x in enumerate(trigrams) if x in need and i // 63 == w)
            if mask:
                out = out & (F.col(f"_b{w}").bitwiseAND(F.lit(mask).cast("long")) == mask)
        return out

    def holds(clauses) -> Column:
        out = F.lit(True)
        for clause in clauses:
            one = F.lit(False)
            for need in clause:
                one = one | has(need)
            out = out & one
        return out

    rules = F.array_compact(F.array(*[F.when(holds(q), F.lit(kind)) for kind, q in queries.items()]))
    return rows.select("_key", rules.alias("_rules")).where(F.size("_rules") > 0)


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, _key (of id and text), spans array<struct<kind, start, end>> by start, then the rules' order.

    Null texts count as empty and have no spans; repeated rows get the same spans each; an empty table gives no rows.
    Only the rows that some rule has to be matched against are joined with their texts again."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_key", F.xxhash64("doc_id", "text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for need in clause for t in need})
    order = {r.kind: i for i, r in enumerate(rules)}

    def tagged(rule):
        return F.transform(spans_of(F.col("text"), rule), lambda s: F.struct(s["start"].alias("start"), F.lit(order[rule.kind]).alias("rank"), s["end"].alias("end")))

    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    full = [tagged(r) for r in rules if r.kind not in queries]
    every = keyed.select("doc_id", "_key", (F.concat(*full) if full else none).alias("_full"))
    found = cut(candidates(index(keyed, trigrams), trigrams, queries))
    checked = keyed.select("_key", "text").join(found, "_key").select(
        "_key", F.concat(none, *[F.when(F.array_contains("_rules", r.kind), tagged(r)).otherwise(none) for r in rules if r.kind in queries]).alias("_found"))
    checked = checked.where(F.size("_found") > 0).groupBy("_key").agg(F.first("_found").alias("_found"))  # rows of a key have the same
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    merged = F.array_sort(F.concat("_full", F.coalesce("_found", none)))
    spans = F.transform(merged, lambda s: F.struct(F.element_at(kinds, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return every.join(checked, "_key", "left").select("doc_id", "_key", spans.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Per row: counts of the base kinds, the hash of the base spans, and all spans as text."""
    base = [r.kind for r in rules if r.base]
    own = F.filter("spans", lambda s: s["kind"].isin(base))

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in base]
    return scan(docs, rules).select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with every span of its texts replaced by [kind]; same columns, same rows. Spans that overlap are replaced as one, named by the first."""
    names = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"_own_{c}") for c in names])
    found = scan(own, rules).where(F.size("spans") > 0).groupBy("_key").agg(F.first("spans").alias("_spans"))
    keyed = own.withColumn("_key", F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        plain = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0).cast("long")))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.concat(acc["out"], plain, mark).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    def finish(acc):
        return F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))

    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.aggregate("_spans", start, step, finish))
    out = keyed.join(found, "_key", "left").withColumn("text", text)
    return out.select(*[F.col(f"`{c if c in ('doc_id', 'text') else '_own_' + c}`").alias(c) for c in names])


def check_rules(rules: list[Rule] = RULES) -> None:
    for r in rules:
        re.compile(r.pattern)
