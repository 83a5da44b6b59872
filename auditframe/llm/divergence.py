"""Operator 11: source divergence audit.

How far do the sources of a language differ in the words they use? Per language
the terms in enough documents are kept; each (language, source) group and each
language gives every kept term a smoothed share in billionths (``SCALE``). The
audit lists, per group, the other sources by their chi-square-like divergence,
and the terms that the group uses more than its language.

The tokenizer is one table: ``bytes.translate`` lowers A-Z and blanks separators
in one pass, ``bytes.split`` gives the terms and a Counter per document their
frequencies. Everything behind it is sparse: only terms that occur in a group
are rows. A pair's sum over all kept terms is put together from

* the terms in neither source, all of one value,
* the terms in one of them, by count (``count -> terms`` of a source is small),
* a correction for the terms in both, from the sources of each term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.llm.common import Scratch

LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
TERM_RANKS = 200
#: A task hands on its counts when it holds so many (group, term) entries.
FLUSH_ENTRIES = 400_000
#: Longer texts are split in blocks of so many bytes, cut at separators.
BLOCK_BYTES = 1 << 20

#: Letters and bytes beyond ASCII belong to terms, A-Z lowered; all others separate.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter[bytes]:
    """Frequencies of the terms of one text."""
    text = text.translate(_TABLE)
    if len(text) <= BLOCK_BYTES:
        return Counter(text.split())
    out, a = Counter(), 0
    while a < len(text):
        b = text.find(b" ", a + BLOCK_BYTES)
        b = len(text) if b < 0 else b
        out.update(text[a:b].split())
        a = b
    return out


def group_term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and the
    documents that hold it, added up per task; a row with a null term says that
    the group occurs. Null columns are read as ''."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = 0

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                size = len(terms) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size), pa.array([source] * size), pa.array([None, *terms], pa.binary()).cast(pa.string()),
                     pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(d.__getitem__, terms)], pa.int64())], names=names)
            held.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.large_binary()), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                counts = term_counts(text.as_py())
                entries -= len(n)
                n.update(counts)
                d.update(counts.keys())
                entries += len(n)
                if entries >= FLUSH_ENTRIES:
                    yield from handed()
                    entries = 0
        yield from handed()

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    return docs.select(*blank).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exactly, as a long division by
    thousands: no step leaves 64 bits while counts stay below 9 * 10**15."""
    rest, whole, out = n + 1, total + terms, F.lit(0).cast("bigint")
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + F.call_function("div", rest, whole), rest % whole
    return out + 1


def _excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(
    scratch: Scratch, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_documents: int = LEAST_DOCUMENTS, term_ranks: int = TERM_RANKS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other
    sources of the language, part ``term`` the kept terms of the group whose share
    is above the language's, up to ``term_ranks``.

    Null text, lang and source are read as ''. A group without terms takes part
    with count 0 for every kept term; without kept terms every pair has value 0.
    Rows that repeat are counted each. Extra columns are ignored; an empty table
    gives an empty result. Sums are 64-bit: a share is at most SCALE + 1."""
    # the tasks have added up their rows, so they are dealt by term at once: the sums
    # per source and the sources of a term need no further exchange
    dealt = group_term_counts(docs, text_col, lang_col, source_col).repartition("lang", "term")
    kept = scratch.write(
        dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("uses"))
        .where(F.col("term").isNull() | (F.col("docs") >= least_documents)).drop("docs"))
    occurring = kept.where("term is null").select("lang", F.inline("uses").alias("source", "n")).drop("n")
    kept = kept.where("term is not null")
    uses = kept.select("lang", "term", F.col("n").alias("lang_n"), F.inline("uses").alias("source", "n"))

    languages = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    totals = uses.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("used"))
    groups = (
        occurring.join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
        .na.fill(0, ["total", "used", "lang_total", "terms"])
        .withColumn("none", F.when(F.col("terms") > 0, _share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms")))))
    groups = scratch.write(groups)

    shares = uses.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    shares = shares.select(
        "lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    shares = scratch.write(shares)

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _excess(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= term_ranks))

    one = groups.select("lang", "source", F.col("none").alias("p0"), "terms", "used")
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("q0"), F.col("used").alias("item_used"))
    pairs = one.join(other, "lang").where("source != item")
    by_count = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    own = (
        by_count.join(other, "lang").where("source != item")
        .groupBy("lang", "source", "item").agg(F.sum(F.col("m") * _excess(F.col("p"), F.col("q0"))).alias("own")))
    others = (
        by_count.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "m").join(one, "lang").where("source != item")
        .groupBy("lang", "source", "item").agg(F.sum(F.col("m") * _excess(F.col("p0"), F.col("q"))).alias("others")))
    both = (
        shares.join(groups.select("lang", "source", "none"), ["lang", "source"])
        .groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "none")).alias("uses")).where(F.size("uses") > 1)
        .select("lang", "uses", F.inline("uses").alias("source", "p", "p0"))
        .select("lang", "source", "p", "p0", F.inline("uses").alias("item", "q", "q0")).where("source != item")
        .groupBy("lang", "source", "item").agg(
            F.sum(_excess(F.col("p"), F.col("q")) - _excess(F.col("p"), F.col("q0")) - _excess(F.col("p0"), F.col("q"))).alias("corrected"),
            F.count("*").alias("shared")))
    keys = ["lang", "source", "item"]
    neither = F.col("terms") - F.col("used") - F.col("item_used") + F.coalesce("shared", F.lit(0))
    value = sum((F.coalesce(c, F.lit(0)) for c in ("own", "others", "corrected")), F.coalesce(neither * _excess(F.col("p0"), F.col("q0")), F.lit(0)))
    pairs = (
        pairs.join(own, keys, "left").join(others, keys, "left").join(both, keys, "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("bigint").alias("value"))
        .withColumn("rank", F.row_number().over(best)))
    return pairs.unionByName(terms)
