"""Phrase kernel: which entries of a dictionary occur in a text, in one pass at any dictionary size.

The entries are put into one shared-prefix automaton, so a text is read once, character by character, whether the
dictionary holds thirty words or a hundred thousand in twenty-five languages. Entries of all languages are found
together and told apart afterwards, by columns. Texts go through Arrow in batches and are never shuffled; the
dictionary is broadcast in parts of a counted size, one automaton each, so no dictionary is too large for a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordon.session import small_batches

try:
    import ahocorasick
except ModuleNotFoundError:  # the same answers, one scan a phrase
    ahocorasick = None

PART_BYTES = 16 << 20  # of phrases in one automaton


class Automaton:
    """Entries by phrase; built once in each worker. Rows are kept as numbers by phrase, as lists of a large dictionary
    would take more than its automaton."""

    def __init__(self, phrases: list[str | None], table: pa.Table):
        numbers: dict[str, int] = {}
        code = np.array([-1 if p is None else numbers.setdefault(p, len(numbers)) for p in phrases], dtype="int32")
        self.order = np.argsort(code, kind="stable").astype("int32")
        self.starts = np.searchsorted(code[self.order], np.arange(len(numbers) + 1)).astype("int32")
        self.sizes, self.empty = np.array([len(p) for p in numbers], dtype="int32"), numbers.get("", -1)
        self.phrases, self.table, self.built = pa.array(numbers, pa.large_string()), table, None

    def __getstate__(self):
        return self.__dict__ | {"built": None}

    def rows(self, i: int) -> list[int]:
        """Rows of phrase ``i`` in order; none for -1."""
        return self.order[self.starts[i]:self.starts[i + 1]].tolist() if i >= 0 else []

    def build(self) -> None:
        if self.built is None:
            if ahocorasick:
                built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                for i, phrase in enumerate(self.phrases):
                    if i != self.empty:
                        built.add_word(phrase.as_py(), i)
                built.make_automaton()
                self.built = built
            else:
                self.built = [(p, i) for i, p in enumerate(self.phrases.to_pylist()) if p]

    def found(self, text: str) -> list[int]:
        """Rows of the phrases that ``text`` holds anywhere, in order. The empty phrase is in every text."""
        self.build()
        if ahocorasick:
            hit = {i for _, i in self.built.iter(text)} if len(self.built) else set()
        else:
            hit = {i for p, i in self.built if p in text}
        return sorted([row for i in hit for row in self.rows(i)] + self.rows(self.empty))

    def found_first(self, text: str) -> list[int]:
        """Of ``found``, in order, what may stand as whole words, up to the first that surely does."""
        self.build()
        if not ahocorasick:
            return self.found(text)
        best, may, n = len(self.table), set(self.rows(self.empty)), len(text)
        for end, i in self.built.iter(text) if len(self.built) else ():
            row = int(self.order[self.starts[i]])
            if row < best:
                at = end + 1 - int(self.sizes[i])
                before = _edge(text[at - 1] if at else None, text[at])
                after = _edge(text[end], text[end + 1] if end + 1 < n else None) if before is not False else False
                if before and after:
                    best = row
                elif after is not False:
                    may.update(self.rows(i))
        return sorted({row for row in may if row < best} | ({best} if best < len(self.table) else set()))


def _edge(a: str | None, b: str | None) -> bool | None:
    """Is there a word's edge between two characters (None: the text's end)? None where only Java's classes tell."""
    a, b = _in_word(a), _in_word(b)
    return None if a is None or b is None else a != b


def _in_word(c: str | None) -> bool | None:
    if c is None or c.isspace():
        return False
    if c.isalpha() or c.isdecimal() or c == "_":
        return True
    return False if c < "\x80" else None


def occurring(df: DataFrame, ref: DataFrame, phrase: str, text: Column | str, out: str, first_whole: bool = False) -> DataFrame:
    """``df`` with ``out``: the rows of ``ref``, as an array of structs in the order of its columns, whose ``phrase``
    occurs in ``text``, letter case aside. Null phrases never occur, a null text holds nothing, repeated rows of
    ``ref`` count each, and an empty dictionary gives empty arrays. With ``first_whole`` the array may end after the
    first row that stands as a whole word, and lacks rows that never do: enough to find the first that does."""
    small_batches(df.sparkSession)
    text = F.col(text) if isinstance(text, str) else text
    ref = ref.withColumn(phrase, F.lower(phrase))
    size = ref.agg(F.sum(F.octet_length(phrase))).first()[0] or 0
    parts = size // PART_BYTES + 1
    kind = T.ArrayType(T.StructType(ref.schema.fields))
    made = []
    for part in range(parts):
        mine = ref if parts == 1 else ref.where(F.pmod(F.xxhash64(phrase), F.lit(parts)) == part)
        table = mine.orderBy(*[F.col(f"`{c}`") for c in ref.columns]).toArrow().combine_chunks()
        made.append(_scan(df, Automaton(table.column(phrase).to_pylist(), table), kind, first_whole))
    lowered = F.lower(F.coalesce(text, F.lit("")))
    empty = F.array().cast(kind)
    hits = [F.when(text.isNull(), empty).otherwise(scan(lowered)) for scan in made]
    return df.withColumn(out, hits[0] if parts == 1 else F.array_sort(F.concat(*hits)))


def _scan(df: DataFrame, automaton: Automaton, kind: T.ArrayType, first_whole: bool):
    shared = df.sparkSession.sparkContext.broadcast(automaton)

    def scan(texts: pa.Array) -> pa.Array:
        own = shared.value
        found = own.found_first if first_whole else own.found
        rows, ends = [], [0]
        for text in texts:
            rows += found(text.as_py())
            ends.append(len(rows))
        entries = own.table.take(pa.array(rows, pa.int64())).to_struct_array()
        entries = entries.combine_chunks() if isinstance(entries, pa.ChunkedArray) else entries
        if not len(rows):
            entries = pa.array([], pa.struct(own.table.schema))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)

    return F.arrow_udf(scan, kind)


def in_terms(df: DataFrame, terms: DataFrame, text: Column | str, out: str) -> DataFrame:
    """The entries ``(grp_rank, rank, grp, keyword, lang)`` of a keyword dictionary that occur in ``text``."""
    return occurring(df, terms.select("grp_rank", "rank", "grp", "keyword", "lang"), "keyword", text, out)


def of_language(hits: Column | str, lang: Column) -> Column:
    """Those of one language; none for a null language."""
    return F.filter(hits, lambda h: F.coalesce(h["lang"] == lang, F.lit(False)))


def listed(terms: DataFrame, lang: Column, default: str) -> Column:
    """``lang`` where the dictionary has words of it, else ``default``."""
    langs = sorted(r[0] for r in terms.select("lang").distinct().collect() if r[0] is not None)
    return F.when(lang.isin(langs), lang).otherwise(F.lit(default)) if langs else F.lit(default)


def any_of_language(hits: Column | str, lang: Column) -> Column:
    return F.exists(hits, lambda h: F.coalesce(h["lang"] == lang, F.lit(False)))
