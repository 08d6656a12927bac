"""Benchmark decontamination by winnowing, in Catalyst expressions alone.

Both sides are cut into word windows of ``span`` words; a benchmark item of
fewer words is one window of its own length. Each window is represented by the
smallest hash of the ``gram``-word grams in it. Equal windows hold equal grams,
so they have the same smallest hash: no shared window can be missed. A run of
neighbouring windows with the same smallest hash is one fingerprint, some two
for every ``span - gram + 2`` words, and carries the run's words. Documents' and
benchmark's fingerprints are joined; only the runs that hit are extended, by
comparing each of their windows with the benchmark's windows word by word.

No document is shuffled: one scan makes the fingerprints, drops those that hit
nothing while they stream past the benchmark's, and sums up by document. The
benchmark's fingerprints and windows are broadcast up to
``BROADCAST_WINDOWS`` windows; a larger benchmark takes shuffled joins.

Words are ``WORD`` after lower-casing A-Z. Null text has no words. A window that
lies under several items counts for each; repeated item rows count once, and
null item ids are hit but not listed. Rows are told apart by their place in their
file, so rows without an id or with a repeated one are documents of their own.
Empty tables are fine on either side. Only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import located, settled

SPAN, GRAM = 10, 4
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: About 150 bytes a window: 75 MB at most.
BROADCAST_WINDOWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, also where the body uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(F.coalesce(lowered, F.lit("")), F.lit(WORD), F.lit(0))


def _windows(n: Column, span: int) -> Column:
    """0-based starts of the windows of n words; empty if there are none."""
    return F.when(n >= span, F.sequence(F.lit(0), n - span)).otherwise(F.expr("array_repeat(0, 0)"))


def sliding_least(values: Column, wide: int, body) -> Column:
    """``body`` of the least of ``wide`` neighbours from each place on (of fewer at the end), by doubling."""

    def step(m: Column, have: int) -> Column:
        if have == wide:
            return body(m)
        more = min(have, wide - have)
        return let(F.transform(m, lambda x, i: F.least(x, F.get(m, i + more))), lambda y: step(y, have + more))

    return step(values, 1)


def runs(w: Column, spans: list[int], gram: int) -> Column:
    """Fingerprints of an array of words for each window length: (length, least gram hash, start of the run's first window, number of windows, the run's words)."""

    def of_span(g: Column, h: Column, span: int, k: int) -> Column:
        n = F.greatest(F.size(h) - (span - 1), F.lit(0))

        def of_minima(all_minima: Column) -> Column:
            def of_starts(m: Column, s: Column) -> Column:
                def run(a: Column, j: Column) -> Column:
                    many = F.coalesce(F.get(s, j + 1), F.size(m)) - a
                    return F.struct(F.lit(span).alias("len"), F.get(m, a).alias("m"), a.alias("at"), many.alias("n"), F.slice(w, a + 1, many + (span - 1)).alias("ctx"))

                return F.transform(s, run)

            def starts(m: Column) -> Column:
                return F.filter(F.transform(m, lambda x, i: F.when((i == 0) | (x != F.get(m, i - 1)), i)), lambda i: i.isNotNull())

            return let(F.slice(all_minima, F.lit(1), n), lambda m: let(starts(m), lambda s: of_starts(m, s)))

        return sliding_least(g, span - k + 1, of_minima)

    def of_grams(h: Column, k: int) -> Column:
        own = [span for span in spans if min(gram, span) == k]
        grams = F.transform(_windows(F.size(h), k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return let(grams, lambda g: F.concat(*[of_span(g, h, span, k) for span in own]))

    def of_hashes(h: Column) -> Column:
        return F.concat(*[of_grams(h, k) for k in sorted({min(gram, span) for span in spans})])

    return let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes)


def benchmark_windows(benchmark: DataFrame, span: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct windows of all items: their number of words, their text, and the items that hold them."""
    split = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    sized = split.filter(F.size("w") > 0).withColumn("len", F.least(F.lit(span), F.size("w")))
    each = sized.select("item", "len", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("len")), lambda i: F.array_join(F.slice(F.col("w"), i + 1, F.col("len")), " "))).alias("window"))
    return each.groupBy("len", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and its place: file, row."""
    found = settled(benchmark_windows(benchmark, span, item_col, item_text_col), "benchmark-windows")
    sizes = {r["len"]: r["n"] for r in found.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}  # span rows at most
    small = F.broadcast if sum(sizes.values()) <= BROADCAST_WINDOWS else (lambda df: df)

    source, file, row = located(docs, *dict.fromkeys((id_col, text_col)))
    split = source.select(F.col(id_col).cast("long").alias("doc_id"), F.col(file).alias("file"), F.col(row).alias("row"), words(F.col(text_col)).alias("w"))
    key = ("file", "row", "doc_id", "n_words")
    nothing = F.array(F.expr("struct(0 as len, cast(null as bigint) as m, -1 as at, 0 as n, array_repeat('', 0) as ctx)"))
    lengths = sorted(sizes)
    every = F.concat(nothing, runs(F.col("w"), lengths, gram)) if lengths else nothing
    rows = split.select(*key[:3], F.size("w").alias("n_words"), F.explode(every).alias("x")).select(*key, "x.*")

    marks = None  # the benchmark's fingerprints: a window's least hash
    for length in lengths:
        own = found.filter(F.col("len") == length).select(F.element_at(runs(F.split("window", " "), [length], gram), 1)["m"].alias("m"), F.lit(length).alias("len"))
        marks = own if marks is None else marks.unionByName(own)
    none = F.expr("array_repeat(cast(null as string), 0)")
    if marks is None:
        hits = rows.select(*key, F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), none.alias("items"))
    else:
        marked = rows.join(small(marks.distinct().withColumn("hit", F.lit(True))), ["m", "len"], "left").filter(F.col("hit") | (F.col("at") < 0))
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: F.struct((F.col("at") + i).alias("at"), F.array_join(F.slice(F.col("ctx"), i + 1, F.col("len")), " ").alias("window")))
        spread = marked.select(*key, "len", F.explode(each).alias("e")).select(*key, "len", "e.at", "e.window")
        joined = spread.join(small(found), ["len", "window"], "left").filter(F.col("items").isNotNull() | (F.col("at") < 0))
        hits = joined.select(*key, F.when(F.col("at") >= 0, F.col("at")).alias("a"), F.when(F.col("at") >= 0, F.col("at") + F.col("len")).alias("b"), "items")
    # a document's hits are as many as its words at most
    summed = hits.groupBy(*key).agg(F.array_sort(F.collect_set(F.when(F.col("a").isNotNull(), F.struct("a", "b")))).alias("spans"), F.collect_set("items").alias("lists"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["b"]).alias("end")),
        lambda acc: acc["n"],
    )
    items = F.array_sort(F.array_distinct(F.flatten("lists")))
    done = summed.select("doc_id", "file", "row", F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"), items.alias("items"))
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "file", "row")
