"""The language of a text by character trigrams, learnt from texts whose language is known.

The model is a table: each trigram with, for each language that has it, by how much its
log probability is above that of one never seen there. Logs are whole thousandths, so
sums don't depend on their order. A text's score for a language is the sum over its
trigrams; the largest wins, the first in order among equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from .language import DETECTED
from .shared import settled

#: The trigrams of up to so many languages are joined with a column a language; those of more with a row a language.
MOST_COLUMNS = 32
#: Up to so many trigrams (some 200 bytes each) are sent to all executors; a larger table is joined by a shuffle.
MOST_BROADCAST = 500_000


def grams(text: Column) -> Column:
    """The trigrams of a text in lower case, white space collapsed, a blank at either end."""
    spaced = F.concat(F.lit(" "), collapse(F.lower(F.coalesce(text, F.lit("")))), F.lit(" "))
    # at each character, it and the two that follow
    return F.regexp_extract_all(spaced, F.lit("(?s)(?=(...))."), F.lit(1))


def _log(x: Column) -> Column:
    return F.round(F.log(x) * 1000).cast("long")


def learnt(texts: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The model (gram, scores: lang, above, unseen) from texts with a language; others don't count, nor do trigrams without a letter.

    The texts are read once, at the call: their trigrams' counts are written to the shared folder.
    """
    each = texts.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(grams(F.col(text_col))).alias("gram"))
    counts = each.groupBy("gram", "lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("gram").rlike(r"\p{L}"))
    counts = settled(counts, "trigrams")
    kinds = counts.agg(F.countDistinct("gram").alias("kinds"))
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("total")).crossJoin(F.broadcast(kinds))  # one row a language, one row
    unseen = _log(F.lit(1) / (F.col("total") + F.col("kinds")))
    scores = counts.join(sizes, "lang").withColumn("unseen", unseen).withColumn("above", _log((F.col("n") + 1) / (F.col("total") + F.col("kinds"))) - F.col("unseen"))
    return scores.groupBy("gram").agg(F.collect_list(F.struct("lang", "above", "unseen")).alias("scores"))  # one entry a language


def detected(samples: DataFrame, model: DataFrame, sample: str = "sample") -> DataFrame:
    """doc_id and detected: the language of each sample, null where the model knows none of its trigrams."""
    langs = model.select(F.explode("scores").alias("s")).select("s.lang", "s.unseen").distinct().orderBy("lang").take(MOST_COLUMNS + 1)
    few = 0 < len(langs) <= MOST_COLUMNS
    if few:
        of = lambda code: F.get(F.filter("scores", lambda s: s["lang"] == code), 0)["above"]
        model = model.select("gram", *[of(r["lang"]).alias(f"above_{i}") for i, r in enumerate(langs)])
    model = F.broadcast(model) if model.count() <= MOST_BROADCAST else model
    each = samples.select("doc_id", grams(F.col(sample)).alias("found")).select("doc_id", F.size("found").alias("size"), F.explode("found").alias("gram"))
    hits = each.join(model, "gram")
    # summed where the text is, so what is shuffled is a row a text (and language)
    if few:
        sums = hits.groupBy("doc_id").agg(F.first("size").alias("size"), *[F.sum(f"above_{i}").alias(f"above_{i}") for i in range(len(langs))])
        # null where the language has none of the text's trigrams
        scores = [F.when(F.col(f"above_{i}").isNotNull(), F.struct((-(F.col(f"above_{i}") + F.col("size") * r["unseen"])).alias("score"), F.lit(r["lang"]).alias("lang"))) for i, r in enumerate(langs)]
        best = sums.select("doc_id", F.array_min(F.array_compact(F.array(*scores)))["lang"].alias("code"))
    else:
        each_lang = hits.select("doc_id", "size", F.explode("scores").alias("s"))
        sums = each_lang.groupBy("doc_id", F.col("s.lang").alias("lang")).agg((F.sum("s.above") + F.first("size") * F.first("s.unseen")).alias("score"))
        best = sums.groupBy("doc_id").agg(F.min_by("lang", F.struct((-F.col("score")).alias("score"), F.col("lang"))).alias("code"))
    known = F.create_map(*[F.lit(x) for pair in DETECTED.items() for x in pair])
    named = best.select("doc_id", F.coalesce(F.try_element_at(known, F.col("code")), F.split_part("code", F.lit("-"), F.lit(1))).alias("detected"))
    return samples.select("doc_id").join(named, "doc_id", "left")
