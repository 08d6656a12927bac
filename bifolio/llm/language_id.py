"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled with sample text
of it. A text is compressed with every dictionary; the language whose
dictionary leaves the fewest bytes is chosen. Case is folded in both, and the
matcher takes matches from four bytes on, as words are short; stretches without
letters count as one space. If the runner-up
is nearly as small, the choice is marked as rejected.

The sample is bounded: of each language at most ``DOCS_EACH`` documents, fewer where
there are so many languages that all would pass ``SAMPLE_BYTES``, chosen by a hash of
their ids among those of at most ``LONGEST`` bytes (the shortest one, if all are
longer); their whole texts are learnt. All languages are. What is classified is always
the whole text.

Null texts and texts without a letter get ``und`` and score 0. If no labelled
text has a letter, every document gets ``und``. Ties go to the language first
in alphabetical order. Repeated rows get equal results; an empty table gives an
empty result. Only the columns named are read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean
from .text_kernel import sliced

UNKNOWN = "und"
_GAP = re.compile(r"[\W\d_]+")
#: The sample: so many whole documents of a language, of so many bytes at most, and fewer of each where the languages are so many that all would pass SAMPLE_BYTES.
DOCS_EACH, LONGEST, SAMPLE_BYTES = 192, 8192, 160 << 20
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"

Model = dict[str, bytes]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_each: int = DOCS_EACH, longest: int = LONGEST, languages: int | None = None) -> Model:
    """Dictionaries' contents by language, from the rows where ``learn`` holds and the language is known: of all languages, or of the ``languages`` with the most rows."""
    size = F.octet_length(F.col(text_col))
    named = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (size <= longest).alias("short"), size.alias("size"))
    lot = F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(1 << 20))
    counts = named.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("short").alias("short"), F.min("size").alias("least"), F.min(F.when(F.col("short"), lot)).alias("lowest")).orderBy(F.desc("n"), "lang")
    counts = (counts if languages is None else counts.limit(languages)).collect()  # one row a language
    if not counts:
        return {}
    docs_each = max(1, min(docs_each, SAMPLE_BYTES // (len(counts) * longest)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], float(min(1.0, 1.3 * docs_each / max(1, r["short"]))))])
    least = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], -1 if r["short"] else r["least"])])
    lowest = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], -1 if r["lowest"] is None else r["lowest"])])  # one row at least, however few are wanted
    chosen = named.filter((F.col("short") & ((lot < F.element_at(share, F.col("lang")) * F.lit(1 << 20)) | (lot == F.element_at(lowest, F.col("lang"))))) | (F.col("size") == F.element_at(least, F.col("lang"))))
    # of repeated rows one serves; a language has 1.3 * docs_each rows or so
    rows = chosen.groupBy("lang", "id", F.xxhash64("text")).agg(F.min("text").alias("text")).drop("xxhash64(text)").collect()
    model: Model = {}
    for lang in sorted(r["lang"] for r in counts):
        own = sorted((r["id"] is not None, r["id"] or 0, r["text"]) for r in rows if r["lang"] == lang)
        own = own[:docs_each] if len(own[0][2].encode()) <= longest else own[:1]
        model[lang] = folded("\n".join(x[2] for x in own))
    return model


def folded(text: str) -> bytes:
    """Lower-case words, one space between them."""
    return _GAP.sub(" ", text.lower()).encode()


_COMPRESSORS: dict[tuple, list[tuple[str, object]]] = {}


def compressors(model: Model) -> list[tuple[str, object]]:
    """A compressor for each language; a process keeps those of its last model."""
    import zstandard as z

    key = (os.getpid(), hash(tuple(sorted(model.items()))))
    if key not in _COMPRESSORS:
        _COMPRESSORS.clear()
        found = []
        for lang, content in sorted(model.items()):
            how = z.ZstdCompressionParameters(window_log=20, hash_log=17, chain_log=17, search_log=1, min_match=4, strategy=z.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            found.append((lang, z.ZstdCompressor(compression_params=how, dict_data=d)))
        _COMPRESSORS[key] = found
    return _COMPRESSORS[key]


def classify(text: str | None, known: list[tuple[str, object]], margin: float) -> tuple[str, float, bool]:
    """(language, score, rejected) of one text."""
    if not text or not known or not has_letter(text):
        return UNKNOWN, 0.0, True
    data = folded(text)
    sizes = sorted((len(c.compress(data)), lang) for lang, c in known)
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    (best, lang), (second, _) = sizes[:2]
    gain = (second - best) / max(second, 1.0)
    return lang, min(1.0, 0.5 + gain * 2.5), gain < margin


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.01) -> DataFrame:
    """One row a document: doc_id, lang_pred, score, rejected."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = compressors(model)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for whole in batches:
            for batch in sliced(whole, "text"):
                lang, score, rejected = zip(*[classify(t, known, margin) for t in batch.column(1).to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)
