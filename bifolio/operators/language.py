"""Languages: names to codes, detection, and how a pair of them is reached."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS_CHARS
from ..schema import PIVOT

# Two-letter codes of ISO 639-1, in order, and two codes beside them.
ISO_639_1 = """
aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es
et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj
kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv
ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti
tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu
""".split()
EXTRA_CODES = ["pb", "zt"]
# Spanish names of languages, normalised.
SPANISH_NAMES = {
    "albanes": "sq", "aleman": "de", "arabe": "ar", "azerbaiyano": "az", "azeri": "az", "bengali": "bn", "bulgaro": "bg",
    "castellano": "es", "catalan": "ca", "checo": "cs", "chino": "zh", "chino tradicional": "zt", "coreano": "ko", "croata": "hr",
    "danes": "da", "eslovaco": "sk", "esloveno": "sl", "espanol": "es", "esperanto": "eo", "estonio": "et", "euskera": "eu",
    "farsi": "fa", "filipino": "tl", "fines": "fi", "finlandes": "fi", "frances": "fr", "gallego": "gl", "griego": "el",
    "hebreo": "he", "hindi": "hi", "holandes": "nl", "hungaro": "hu", "indonesio": "id", "ingles": "en", "irlandes": "ga",
    "italiano": "it", "japones": "ja", "leton": "lv", "lituano": "lt", "malayo": "ms", "neerlandes": "nl", "noruego": "nb",
    "persa": "fa", "polaco": "pl", "portugues": "pt", "portugues brasileno": "pb", "rumano": "ro", "ruso": "ru", "serbio": "sr",
    "suajili": "sw", "sueco": "sv", "swahili": "sw", "tagalo": "tl", "tailandes": "th", "turco": "tr", "ucraniano": "uk",
    "urdu": "ur", "vasco": "eu", "vietnamita": "vi",
}
# Codes of detectors that have another name here.
DETECTED = {"zh-cn": "zh", "zh-tw": "zt"}

#: Catalogues of packages have a few thousand rows; with more than this they are joined by a shuffle.
BROADCAST_PACKAGES = 200_000


#: Compares names without case and accents.
COLLATION = "UNICODE_CI_AI"


def normalized(name: str | Column) -> Column:
    """A name as a key that is grouped and joined without case and accents; white space around it doesn't count."""
    return F.collate(F.trim(name, F.lit(WS_CHARS)), COLLATION)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_PACKAGES + 1).count() <= BROADCAST_PACKAGES else df


def known_names(packages: DataFrame) -> DataFrame:
    """key, code: normalised names of a catalogue (installed first, then by ord); of several, the last wins."""
    sides = [packages.select(F.col(f"{s}_name").alias("name"), F.col(f"{s}_code").alias("code"), F.struct(~F.col("installed"), F.col("ord"), F.lit(i)).alias("at")) for i, s in enumerate(("from", "to"))]
    return sides[0].unionByName(sides[1]).filter("name <> ''").groupBy(normalized("name").alias("key")).agg(F.max_by("code", "at").alias("code"))


def catalogue(packages: DataFrame) -> DataFrame:
    """code, name of all languages of a catalogue; of several names the first wins, and a code without one is its own."""
    sides = [packages.select(F.col(f"{s}_code").alias("code"), F.when(F.col(f"{s}_name") != "", F.col(f"{s}_name")).otherwise(F.col(f"{s}_code")).alias("name"), F.struct(~F.col("installed"), F.col("ord"), F.lit(i)).alias("at")) for i, s in enumerate(("from", "to"))]
    return sides[0].unionByName(sides[1]).groupBy("code").agg(F.min_by(F.coalesce("name", "code"), "at").alias("name"))


def language_list(packages: DataFrame) -> DataFrame:
    """One row: the languages by name."""
    each = catalogue(packages).groupBy().agg(F.array_sort(F.collect_list(F.struct("name", "code"))).alias("x"))  # one row a language
    return each.select(F.array_join(F.transform("x", lambda e: F.concat(e["name"], F.lit(" ("), e["code"], F.lit(")"))), ", ").alias("languages"))


def look_up(answers: DataFrame, packages: DataFrame, answer: str = "answer") -> DataFrame:
    """The answers with ``code``: from the catalogue's names, else the Spanish names, else the code itself; null if unknown."""
    spark = answers.sparkSession
    spanish = spark.createDataFrame(sorted(SPANISH_NAMES.items()), "key string, spanish string")
    codes = spark.createDataFrame([(c,) for c in [*ISO_639_1, *EXTRA_CODES]], "key string").withColumn("iso", F.col("key"))
    keyed = answers.withColumn("key", normalized(answer))
    for side in (_small(known_names(packages)), F.broadcast(spanish), F.broadcast(codes)):  # the last two are the fixed lists above
        keyed = keyed.join(side.withColumn("key", normalized("key")), "key", "left")
    return keyed.withColumn("code", F.coalesce("code", "spanish", "iso")).drop("key", "spanish", "iso")


def pair_plan(pairs: DataFrame, packages: DataFrame) -> DataFrame:
    """How each (source, target) is reached: pivot, to_install, error.

    First what is installed, directly or through the pivot; then what is
    available, directly or through the pivot; else an error.
    """
    p = packages.groupBy("from_code", "to_code").agg(F.bool_or("installed").alias("installed"))
    p = _small(p)
    at = pairs.withColumn("_row", F.struct("source", "target"))

    def leg(rows: DataFrame, a: Column, b: Column, name: str) -> DataFrame:
        return rows.join(p.select(F.col("from_code").alias("_a"), F.col("to_code").alias("_b"), F.col("installed").alias(name)), (a == F.col("_a")) & (b == F.col("_b")), "left").drop("_a", "_b")

    hub = F.lit(PIVOT)
    legs = leg(leg(leg(at, F.col("source"), F.col("target"), "direct"), F.col("source"), hub, "first"), hub, F.col("target"), "second")
    two = (F.col("source") != PIVOT) & (F.col("target") != PIVOT) & F.col("first").isNotNull() & F.col("second").isNotNull()
    way = F.when(F.col("source") == F.col("target"), "same").when(F.col("direct"), "direct").when(two & F.col("first") & F.col("second"), "pivot").when(F.col("direct").isNotNull(), "direct").when(two, "pivot").otherwise("none")
    step = lambda a, b, flag: F.when(~F.col(flag), F.struct(a.alias("from_code"), b.alias("to_code")))
    steps = F.when(F.col("way") == "direct", F.array(step(F.col("source"), F.col("target"), "direct"))).when(F.col("way") == "pivot", F.array(step(F.col("source"), hub, "first"), step(hub, F.col("target"), "second")))
    error = F.when(F.col("way") == "same", "El idioma de destino no puede ser el mismo que el de origen.").when(F.col("way") == "none", F.concat(F.lit("Sin traducción "), "source", F.lit("→"), "target", F.lit(", ni directa ni por pivote en inglés.")))
    planned = legs.withColumn("way", way)
    return planned.select("source", "target", (F.col("way") == "pivot").alias("pivot"), F.coalesce(F.array_compact(steps), F.expr("array_repeat(named_struct('from_code', '', 'to_code', ''), 0)")).alias("to_install"), error.alias("error"))


def provision(plan: DataFrame, packages: DataFrame) -> DataFrame:
    """The packages that plans want installed, each once, the first of the catalogue that fits."""
    wanted = plan.select(F.explode("to_install").alias("s")).select("s.*").distinct()
    first = packages.groupBy("from_code", "to_code").agg(F.min_by(F.struct("from_name", "to_name", "ord"), F.struct(~F.col("installed"), F.col("ord"))).alias("x"))
    return _small(first).join(wanted, ["from_code", "to_code"], "left_semi").select("from_code", "to_code", "x.*")


def detect(samples: DataFrame, make: Callable[[], Callable[[str], str | None]], sample: str = "sample") -> DataFrame:
    """The rows with ``detected``: the code that a detector of one's own, built once in each task, gives; null for blank samples and where it fails. ``detection`` has one that learns and stays in the JVM."""

    def code(find: Callable[[str], str | None], text: str | None) -> str | None:
        if not text or not text.strip():
            return None
        try:
            found = find(text)
        except Exception:
            return None
        return DETECTED.get(found, found.split("-")[0]) if found else None

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = make()
        for texts in batches:
            yield texts.map(lambda t: code(find, t))

    return samples.withColumn("detected", run(sample))


def packages_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    from ..schema import PACKAGES

    return spark.createDataFrame(rows, PACKAGES)
