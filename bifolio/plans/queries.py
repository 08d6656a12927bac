"""Queries over the driver's tables, and the same results as SQL for DuckDB.

``documents`` have no blank lines, so under the paragraph rule each is one
paragraph (``doc_volume``). The ``line_`` queries double each line feed first,
so that every line is a block and the operators have something to do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import BOLD, chapter_file, collapse, decoded, duration, escape, marked, normal_lines, once, plain, rate_and_eta, stem, styled, suffix, thousands
from ..operators import detection, language, layout, profile, render, shared, store
from ..schema import MARKER, PARAGRAPH
from ..sources import docx, epub, files, html_walk
from ..sources.blocks import BLOCK, block
from ..sources.textmd import block_array, text_blocks

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of fewer bytes a core may lie in fewer pieces than there are cores.
SMALL = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """A small table's rows dealt to all cores, as one row group is one task; larger tables have pieces enough and aren't shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SMALL else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def doc_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is one chapter, so all is counted in its row."""
    volume = profile.volume_of(block_array(F.col("text"), html=False), F.lit(1))
    return documents(spark, sf_dir).select("doc_id", volume.alias("v")).select("doc_id", "v.*")


DOC_VOLUME = r"""
SELECT doc_id,
       CASE WHEN trim(coalesce(text, ''), E' \n') = '' THEN 0 ELSE CAST(len(string_split_regex(trim(text, E' \n'), '\s+')) AS BIGINT) END AS words,
       CASE WHEN trim(coalesce(text, ''), E' \n') = '' THEN 0 ELSE 1 END AS paragraphs,
       CASE WHEN trim(coalesce(text, ''), E' \n') = '' THEN 0 ELSE 1 END AS translatable,
       1 AS chapters
FROM documents
"""


def line_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, text, and the lines that aren't blank, white space collapsed, as an array."""
    cut = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), collapse)
    return documents(spark, sf_dir).select("doc_id", "lang", "text", F.filter(cut, lambda x: x != "").alias("lines"))


def lines(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Each line a paragraph, as ``text_blocks`` makes of doubled line feeds where there is no markup: doc_id, lang, others of the document, chapter_idx, block_idx, kind, text, html, level."""
    each = line_arrays(spark, sf_dir).select("doc_id", "lang", *more, F.posexplode("lines").alias("block_idx", "line"))
    own = [c for c in each.columns if c not in ("block_idx", "line")]
    return each.select(*own, F.lit(0).alias("chapter_idx"), "block_idx", F.lit(PARAGRAPH).alias("kind"), F.col("line").alias("text"), F.lit("").alias("html"), F.lit(2).alias("level"))


LINES = r"""
lines AS (
  SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS block_idx, text
  FROM (SELECT doc_id, lang, pos, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text
        FROM (SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), E'\n')) AS line, generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS pos FROM documents))
  WHERE text <> ''
)"""


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "block_idx", "text")


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines through the whole Markdown automaton."""
    docs = documents(spark, sf_dir).withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    return text_blocks(docs)


def _structured(text, role, turn, repeat, lf):
    """A turn's text among all constructs, also in each other's way; pieces to be concatenated, for columns and SQL alike."""
    return [
        repeat("#", turn), " ", role, " ##  " + lf, text, lf + "see ![a](b) and ![c](d) [link](u) `x` **bo *it* ld** _i_ [^1]" + lf + "***" + lf,
        "- ", role, lf + "  goes on" + lf + "[^a]: in the item" + lf + "12) | item" + lf + " | with | bars" + lf + "-|-" + lf,
        "| a | b |" + lf + "|---|:-:|" + lf + "| ", role, " | 2 |" + lf + "# | of the table" + lf + "after the table" + lf + lf,
        "> # Quoted *", role, "*" + lf + "> said" + lf + ">" + lf + "> | a | b |" + lf + "> |---|---|" + lf + "| c | d |" + lf + "    - far" + lf + "____" + lf,
        "[^n]: note" + lf + "- of it" + lf + "# and | this" + lf + " " + lf + "![i](j)" + lf + "# " + lf + "* " + lf + "last ", role,
    ]


def markdown_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, lists, rules, tables, notes, quotes and images around the text of each turn of a conversation, as blocks."""
    turns = spread(table(spark, sf_dir, "conversations"))
    parts = _structured(F.coalesce("text", F.lit("")), F.col("role"), F.col("turn") % 6 + 1, lambda c, n: F.repeat(F.lit(c), n), "\n")
    texts = turns.select(F.struct("conv_id", "turn").alias("at"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("text"))
    return text_blocks(texts, "at").select(F.col("doc_id.conv_id").alias("doc_id"), F.col("doc_id.turn").alias("turn"), "block_idx", "kind", "text", "html", "level")


def line_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.transform("lines", lambda x: F.struct(F.lit(PARAGRAPH).alias("kind"), x.alias("text")))
    found = line_arrays(spark, sf_dir).filter(F.size("lines") > 0).select("doc_id", profile.volume_of(blocks, F.lit(1)).alias("v"))
    return found.select("doc_id", "v.words", "v.paragraphs", "v.translatable")


LINE_VOLUME = f"""
WITH {LINES}
SELECT doc_id, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS words, count(*) AS paragraphs, count(*) AS translatable
FROM lines GROUP BY doc_id
"""


def language_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.volume(lines(spark, sf_dir), keys=("lang",))


def sample_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_arrays(spark, sf_dir).filter(F.size("lines") > 0).select("doc_id", profile.first_texts(F.col("lines")).alias("sample"))


SAMPLE = f"""
WITH {LINES}, head AS (
  SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lines
)
SELECT doc_id, substring(string_agg(text, E'\\n' ORDER BY block_idx), 1, 4000) AS sample FROM head WHERE before < 4000 GROUP BY doc_id
"""


def bold_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "block_idx", F.regexp_replace("text", BOLD, "$1$2").alias("text"))


def inline_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "block_idx", F.regexp_replace(escape(F.col("text")), BOLD, "<b>$1$2</b>").alias("html"))


def italic_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "block_idx", plain(F.col("text")).alias("text"), marked(F.col("text")).alias("html"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return documents(spark, sf_dir).select("doc_id", sha.alias("sha256"), F.concat_ws("-", F.left(sha, F.lit(12)), "lang", F.lit("xx")).alias("job"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with the store's key: their document's content and the pair. Copies of a text share their keys."""
    return lines(spark, sf_dir, F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.concat_ws("-", "lang", F.lit("xx")).alias("pair"))


def _versions(keyed: DataFrame) -> DataFrame:
    """Store rows: an older one for each line, and a newer one for lines with an e."""
    version = lambda t, seq: F.struct(t.alias("t"), F.lit(seq).cast("long").alias("seq"))
    newer = F.when(F.contains("text", F.lit("e")), F.array(version(F.concat("text", F.lit("!")), 2))).otherwise(F.array(version(F.col("text"), 2)).cast("array<struct<t:string,seq:bigint>>"))
    has = F.contains("text", F.lit("e"))
    every = F.concat(F.array(version(F.lower("text"), 1)), F.filter(newer, lambda x: has))
    return keyed.select(*store.KEY, F.explode(every).alias("v")).select(*store.KEY, "v.*")


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(all lines with the store's key, a store that has those of over 40 characters)."""
    keyed = _keyed(spark, sf_dir)
    return keyed, store.last_wins(_versions(keyed.filter(F.length("text") > 40)))


def pending_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed, done = _store(spark, sf_dir)
    return store.pending(keyed, done).select("doc_id", "block_idx", "text")


def resume_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed, done = _store(spark, sf_dir)
    return store.resumed(keyed, done)


def resume_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all lines of all documents."""
    return store.last_wins(_versions(_keyed(spark, sf_dir))).select("sha256", "pair", "block_idx", "t")


def resume_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines with what a store on disk has for them: a commit of those of over 40 characters, then the jobs of contents whose hash begins with 0 to 7 end, then a commit of those with an e. The store stays in the shared folder."""
    keyed, at = shared.settled(_keyed(spark, sf_dir), "lines"), shared.scratch(spark, "store")
    store.buckets(spark, at, 16)
    long = keyed.filter(F.length("text") > 40).withColumn("seq", F.lit(0).cast("long"))  # of copies of a text one counts
    store.append(long.withColumn("t", F.lower("text")), at)
    contents = shared.settled(keyed.filter(F.col("sha256") < "8").select("sha256", "pair").distinct(), "contents")
    for (pair,) in contents.select("pair").distinct().collect():  # one row a language
        store.discard(spark, at, contents.filter(F.col("pair") == pair).select("sha256"), pair)
    store.append(long.filter(F.contains("text", F.lit("e"))).withColumn("t", F.concat("text", F.lit("!"))), at)
    return render.aligned(keyed, store.stored(spark, at), store.KEY).select("doc_id", "block_idx", "t")


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed, done = _store(spark, sf_dir)
    return render.rows(render.aligned(keyed, done, store.KEY), F.col("lang"), F.lit("xx"))


def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).select("doc_id", "block_idx", "row")


def rendered_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = render.bodies(_rendered(spark, sf_dir))
    return body.select("doc_id", F.length("body").cast("long").alias("chars"), F.sha2("body", 256).alias("sha256"))


KEYED = f"""{LINES}, keyed AS (
  SELECT l.*, sha256(coalesce(d.text, '')) AS sha256, concat_ws('-', l.lang, 'xx') AS pair FROM lines l JOIN documents d ON d.doc_id = l.doc_id
), versions AS (
  SELECT sha256, pair, block_idx, text, lower(text) AS t, 1 AS seq FROM keyed UNION ALL SELECT sha256, pair, block_idx, text, text || '!', 2 FROM keyed WHERE contains(text, 'e')
), every AS (
  SELECT sha256, pair, block_idx, arg_max(t, seq) AS t FROM versions GROUP BY ALL
), store AS (
  SELECT sha256, pair, block_idx, arg_max(t, seq) AS t FROM versions WHERE length(text) > 40 GROUP BY sha256, pair, block_idx
)"""
KEYED = KEYED.replace("GROUP BY ALL", "GROUP BY sha256, pair, block_idx")


ALIGNED = f"""
WITH {KEYED}, esc AS (
  SELECT k.*, replace(replace(replace(replace(replace(k.text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS o, coalesce(s.t, '') AS t
  FROM keyed k LEFT JOIN store s ON s.sha256 = k.sha256 AND s.pair = k.pair AND s.block_idx = k.block_idx
), rendered AS (
  SELECT doc_id, block_idx, '<tr><td lang="' || lang || '">' || o || '</td><td lang="xx">' || replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</td></tr>' AS row FROM esc
)"""


def merge_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.transform("lines", lambda x: F.struct(F.lit(PARAGRAPH).alias("kind"), x.alias("text"), F.lit("").alias("html")))
    merged = line_arrays(spark, sf_dir).select("doc_id", F.posexplode(layout.merged(blocks)).alias("pos", "b"))
    return merged.select("doc_id", "pos", "b.text", F.col("b.parts").cast("long").alias("parts"))


MERGED = f"""
WITH {LINES}, prev AS (
  SELECT *, lag(text) OVER w AS p, lead(text) OVER w AS q FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)
), flag AS (
  SELECT *, coalesce(p LIKE '%-' OR (NOT regexp_matches(p, '[.!?:;…»”"'']\\s*$') AND regexp_matches(text, '^[a-záéíóúüñàèìòùâêîôûäëïöç]')), false) AS joins FROM prev
), isle AS (
  SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block_idx) AS island,
         CASE WHEN NOT joins OR p LIKE '%-' THEN '' ELSE ' ' END AS sep,
         coalesce(lead(joins) OVER (PARTITION BY doc_id ORDER BY block_idx), false) AND text LIKE '%-' AS cut FROM flag
)
SELECT doc_id, CAST(island - 1 AS INTEGER) AS pos, string_agg(sep || CASE WHEN cut THEN regexp_replace(text, '-$', '') ELSE text END, '' ORDER BY block_idx) AS text, count(*) AS parts
FROM isle GROUP BY doc_id, island
"""


def line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.transform("lines", lambda x: F.struct(x.alias("plain"), F.concat(F.lit("<i>"), escape(x), F.lit("</i>")).alias("html")))
    joined = line_arrays(spark, sf_dir).filter(F.size("lines") > 0).select("doc_id", layout.joined(each).alias("x")).select("doc_id", "x.*")
    return joined.select("doc_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"), F.sha2("html", 256).alias("html_sha256"))


LINE_JOIN = f"""
WITH {LINES}, near AS (
  SELECT *, coalesce(lag(text) OVER w LIKE '%-' AND regexp_matches(text, '^[a-záéíóúüñàèìòùâêîôûäëïöç]'), block_idx = 0) OR block_idx = 0 AS glued,
         text LIKE '%-' AND regexp_matches(coalesce(lead(text) OVER w, ''), '^[a-záéíóúüñàèìòùâêîôûäëïöç]') AS cut
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)
), part AS (
  SELECT doc_id, block_idx, CASE WHEN glued THEN '' ELSE ' ' END AS sep, CASE WHEN cut THEN left(text, -1) ELSE text END AS p FROM near
), j AS (
  SELECT doc_id, string_agg(sep || p, '' ORDER BY block_idx) AS text,
         replace(string_agg(sep || '<i>' || replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</i>', '' ORDER BY block_idx), '</i> <i>', ' ') AS html
  FROM part GROUP BY doc_id
)
SELECT doc_id, length(text) AS chars, sha256(text) AS sha256, sha256(html) AS html_sha256 FROM j
"""

# A small catalogue: (from_code, from_name, to_code, to_name, installed, ord).
PACKAGES = [
    ("en", "English", "es", "Spanish", True, 1), ("es", "Spanish", "en", "English", True, 2), ("fr", "French", "en", "English", True, 3),
    ("fr", "French", "es", "Spanish", False, 4), ("de", "German", "en", "English", False, 5), ("en", "English", "fr", "French", False, 6),
    ("en", "English", "pt", "Portuguese", False, 7), ("pt", "Portuguese", "en", "English", False, 8), ("ca", "Catalan", "es", "Spanish", False, 9),
]


def pair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of languages of the documents and the catalogue."""
    packages = language.packages_table(spark, PACKAGES)
    target = language.catalogue(packages).select(F.col("code").alias("target"))
    pairs = table(spark, sf_dir, "documents").select(F.col("lang").alias("source")).filter("source is not null").distinct().join(F.broadcast(target))  # PACKAGES names seven languages
    plan = language.pair_plan(pairs, packages)
    legs = F.array_join(F.transform("to_install", lambda s: F.concat(s["from_code"], F.lit(">"), s["to_code"])), ",")
    return plan.select("source", "target", "pivot", legs.alias("to_install"), F.col("error").isNull().alias("resolved"))


_PACKAGES_SQL = "packages(f, fn, t, tn, i, o) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', {str(e).lower()}, {g})" for a, b, c, d, e, g in PACKAGES) + ")"

PAIR_PLAN = f"""
WITH {_PACKAGES_SQL}, codes AS (SELECT f AS c FROM packages UNION SELECT t FROM packages),
pairs AS (SELECT s.lang AS source, codes.c AS target FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) AS s, codes),
legs AS (
  SELECT source, target, d.i AS di, a.i AS ai, b.i AS bi, source <> 'en' AND target <> 'en' AS far
  FROM pairs LEFT JOIN packages d ON d.f = source AND d.t = target LEFT JOIN packages a ON a.f = source AND a.t = 'en' LEFT JOIN packages b ON b.f = 'en' AND b.t = target
), way AS (
  SELECT *, CASE WHEN source = target THEN 'same' WHEN coalesce(di, false) THEN 'direct' WHEN far AND coalesce(ai, false) AND coalesce(bi, false) THEN 'pivot'
                 WHEN di IS NOT NULL THEN 'direct' WHEN far AND ai IS NOT NULL AND bi IS NOT NULL THEN 'pivot' ELSE 'none' END AS w FROM legs
)
SELECT source, target, w = 'pivot' AS pivot,
       CASE WHEN w = 'direct' AND NOT di THEN source || '>' || target
            WHEN w = 'pivot' THEN concat_ws(',', CASE WHEN NOT ai THEN source || '>en' END, CASE WHEN NOT bi THEN 'en>' || target END) ELSE '' END AS to_install,
       w IN ('direct', 'pivot') AS resolved
FROM way
"""

ANSWERS = ["English", "  FRENCH ", "Español", "français", "Alemán", "de", "PB", "zz", "", "Portugués brasileño", "chino tradicional", "catalan", "xx", "Húngaro"]


def language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' languages and some answers, as codes."""
    typed = spark.createDataFrame([(a,) for a in ANSWERS], "answer string")
    own = table(spark, sf_dir, "documents").select(F.col("lang").alias("answer")).filter("answer is not null").distinct()
    return language.look_up(typed.unionByName(own).distinct(), language.packages_table(spark, PACKAGES))


def _lookup_sql() -> str:
    spanish = ", ".join(f"('{k}', '{v}')" for k, v in sorted(language.SPANISH_NAMES.items()))
    codes = ", ".join(f"('{c}')" for c in [*language.ISO_639_1, *language.EXTRA_CODES])
    answers = ", ".join(f"('{a}')" for a in ANSWERS)
    return f"""
WITH {_PACKAGES_SQL}, spanish(k, c) AS (VALUES {spanish}), iso(c) AS (VALUES {codes}),
answers AS (SELECT * FROM (VALUES {answers}) AS v(answer) UNION SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL),
names AS (SELECT lower(strip_accents(n)) AS k, arg_max(c, p) AS c FROM (SELECT fn AS n, f AS c, (CASE WHEN i THEN 0 ELSE 1000 END) + o * 2 AS p FROM packages UNION ALL SELECT tn, t, (CASE WHEN i THEN 0 ELSE 1000 END) + o * 2 + 1 FROM packages) GROUP BY 1),
keyed AS (SELECT answer, lower(strip_accents(trim(answer))) AS k FROM answers)
SELECT answer, coalesce(names.c, spanish.c, iso.c) AS code
FROM keyed LEFT JOIN names ON names.k = keyed.k LEFT JOIN spanish ON spanish.k = keyed.k LEFT JOIN iso ON iso.c = keyed.k
"""


def detected_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document's sample by trigrams of all documents' samples."""
    samples = line_arrays(spark, sf_dir).filter(F.size("lines") > 0).select("doc_id", "lang", profile.first_texts(F.col("lines")).alias("sample"))
    samples = shared.settled(samples, "samples")
    return detection.detected(samples, detection.learnt(samples, text_col="sample"))


DETECTED_LANGUAGE = rf"""
WITH {LINES}, head AS (
  SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lines
), sample AS (
  SELECT doc_id, any_value(lang) AS lang, ' ' || trim(regexp_replace(lower(substring(string_agg(text, E'\n' ORDER BY block_idx), 1, 4000)), '\s+', ' ', 'g')) || ' ' AS s FROM head WHERE before < 4000 GROUP BY doc_id
), g AS (
  SELECT doc_id, lang, substring(s, i, 3) AS gram FROM sample, unnest(range(1, length(s) - 1)) AS r(i)
), c AS (
  SELECT lang, gram, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY ALL HAVING regexp_matches(gram, '\p{{L}}')
), total AS (
  SELECT lang, sum(n) + (SELECT count(DISTINCT gram) FROM c) AS t FROM c GROUP BY lang
), model AS (
  SELECT gram, lang, round(1000 * ln((n + 1) / t)) - round(1000 * ln(1 / t)) AS above FROM c JOIN total USING (lang)
), own AS (
  SELECT doc_id, gram, count(*) AS times FROM g GROUP BY ALL
), sums AS (
  SELECT doc_id, model.lang, sum(times * above) AS above FROM own JOIN model USING (gram) GROUP BY ALL
), scored AS (
  SELECT doc_id, lang, above + size * round(1000 * ln(1 / t)) AS score FROM sums JOIN total USING (lang) JOIN (SELECT doc_id, sum(times) AS size FROM own GROUP BY doc_id) USING (doc_id)
), best AS (
  SELECT doc_id, lang FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1
)
SELECT doc_id, best.lang AS detected FROM sample LEFT JOIN best USING (doc_id)
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files.bounded_batches(spark)
    found = spread(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html"))
    blocks = found.mapInArrow(html_walk.block_rows, f"doc_id {dict(found.dtypes)['doc_id']}, block_idx int, kind string, text string, html string, level int")
    return blocks.select("doc_id", F.lit(0).alias("chapter_idx"), "block_idx", "kind", "text", "html", "level")


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).drop("chapter_idx")


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    default = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(0).alias("chapter_idx"), F.regexp_extract("url", r"([^/]*)$", 1).alias("title"))
    return files.chapter_titles(pages(spark, sf_dir), default).drop("chapter_idx")


def _with_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' blocks; short ones, such as links of a list, stand for images, and copyright lines for tables."""
    blocks = pages(spark, sf_dir)
    mark = F.when(F.col("text").startswith("©"), "[tabla omitida]").when(F.length("text") < 6, "[imagen omitida]")
    return blocks.withColumn("kind", F.when(mark.isNotNull(), MARKER).otherwise(F.col("kind"))).withColumn("html", F.when(mark.isNotNull(), "").otherwise(F.col("html"))).withColumn("text", F.coalesce(mark, "text"))


def page_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.omitted(pages(spark, sf_dir))


def omitted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of omissions of the pages, where short blocks stand for images and copyright lines for tables."""
    return profile.omitted(_with_omissions(spark, sf_dir))


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered rows of all kinds: headings, paragraphs with inline HTML, markers."""
    blocks = _with_omissions(spark, sf_dir).withColumn("t", F.when(F.col("kind") != MARKER, F.concat("text", F.lit(" '*'"))))
    return render.rows(blocks, F.lit("en"), F.lit("xx")).select("doc_id", "block_idx", "row")


def page_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and console line of pages with headings."""
    chapters = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    volumes = profile.volume(_with_omissions(spark, sf_dir), chapters)
    return volumes.withColumn("line", profile.line_of())


PAGES = r"""
cut AS (
  SELECT page_id AS doc_id, unnest(string_split(x, chr(1))) AS piece, generate_subscripts(string_split(x, chr(1)), 1) AS pos
  FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'g'), '^.*?<body>', ''), '<(li|p|h1|div class="ad"|footer)>', chr(1) || '\1>', 'g'), '</(li|p|div|article|footer|body|html|ul|nav)>', chr(1), 'g') AS x FROM pages)
), inner_html AS (
  SELECT doc_id, pos, piece LIKE 'h1>%' AS heading, contains(piece, '<b>') AS bold, regexp_replace(replace(regexp_extract(piece, '^(li|p|h1|div class="ad"|footer)>(.*)$', 2, 's'), '<br>', ' '), '</?[a-zA-Z][^<>]*>', '', 'g') AS raw
  FROM cut WHERE regexp_matches(piece, '^(li|p|h1|div class="ad"|footer)>')
), plain AS (
  SELECT doc_id, pos, heading, bold, replace(replace(replace(replace(replace(replace(raw, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM inner_html
), blocks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS block_idx, CASE WHEN heading THEN 'heading' ELSE 'paragraph' END AS kind,
         trim(regexp_replace(t, '\s+', ' ', 'g')) AS text,
         trim(CASE WHEN bold THEN '<b>' ELSE '' END || regexp_replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\s+', ' ', 'g') || CASE WHEN bold THEN '</b>' ELSE '' END) AS html,
         CASE WHEN heading THEN 1 ELSE 2 END AS level
  FROM plain WHERE trim(regexp_replace(t, '\s+', ' ', 'g')) <> ''
), marked AS (
  SELECT doc_id, block_idx, CASE WHEN m IS NULL THEN kind ELSE 'marker' END AS kind, coalesce(m, text) AS text, CASE WHEN m IS NULL THEN html ELSE '' END AS html, level
  FROM (SELECT *, CASE WHEN text LIKE '©%' THEN '[tabla omitida]' WHEN length(text) < 6 THEN '[imagen omitida]' END AS m FROM blocks)
)"""


def _omitted_sql(blocks: str) -> str:
    return f"""
WITH {PAGES}, n AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'marker' AND text = '[imagen omitida]') AS images, count(*) FILTER (WHERE kind = 'marker' AND text = '[tabla omitida]') AS tables, count(*) FILTER (WHERE kind = 'marker' AND text = '[nota omitida]') AS notes FROM {blocks} GROUP BY doc_id
)
SELECT doc_id, images, tables, notes, CASE WHEN images + tables + notes > 0 THEN 'elementos omitidos con marca en el HTML: ' || concat_ws(', ', CASE WHEN images > 0 THEN images || ' imagen(es)' END, CASE WHEN tables > 0 THEN tables || ' tabla(s)' END, CASE WHEN notes > 0 THEN notes || ' nota(s)' END) END AS summary
FROM n
"""


PAGE_TITLES = f"""
WITH {PAGES}, heads AS (SELECT doc_id, arg_min(text, block_idx) AS heading FROM blocks WHERE kind = 'heading' GROUP BY doc_id)
SELECT page_id AS doc_id, coalesce(heading, regexp_extract(url, '([^/]*)$', 1)) AS title FROM pages LEFT JOIN heads ON heads.doc_id = pages.page_id
"""

PAGE_ROWS = f"""
WITH {PAGES}, esc AS (
  SELECT *, replace(replace(replace(replace(replace(text || ' ''*''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS u FROM marked
)
SELECT doc_id, block_idx,
       CASE kind WHEN 'marker' THEN '<tr class="fila-marca"><td colspan="2">' || text || '</td></tr>'
                 WHEN 'heading' THEN '<tr class="fila-encabezado nivel-' || level || '"><td colspan="2"><span class="enc-orig" lang="en">' || html || '</span><span class="enc-trad" lang="xx">' || u || '</span></td></tr>'
                 ELSE '<tr><td lang="en">' || html || '</td><td lang="xx">' || u || '</td></tr>' END AS row
FROM esc
"""

PAGE_VOLUME = f"""
WITH {PAGES}, v AS (
  SELECT page_id AS doc_id, CAST(coalesce(sum(len(string_split(text, ' '))) FILTER (WHERE kind <> 'marker'), 0) AS BIGINT) AS words,
         count(*) FILTER (WHERE kind = 'paragraph') AS paragraphs, count(*) FILTER (WHERE kind IN ('paragraph', 'heading')) AS translatable, CAST(1 AS BIGINT) AS chapters
  FROM pages LEFT JOIN marked ON marked.doc_id = pages.page_id GROUP BY page_id
)
SELECT *, 'Volumen: ' || replace(format('{{:,}}', words), ',', '.') || ' palabras · ' || replace(format('{{:,}}', paragraphs), ',', '.') || ' párrafos · 1 capítulo' AS line FROM v
"""


def _turn_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as the body of a Word file: a paragraph in a style that may be a heading, a table, and a paragraph with images and notes."""
    turns = spread(table(spark, sf_dir, "conversations"))
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    style = F.element_at(F.array(*map(F.lit, ("Heading 2", "título 7", "Title", "Normal"))), (F.col("turn") % 4 + 1).cast("int"))
    run = lambda t, flags: F.struct(t.alias("text"), F.lit(flags).alias("flags"))

    def row(is_table, style, style_id, images, notes, *runs):
        return F.struct(is_table.alias("is_table"), style.alias("style"), style_id.alias("style_id"), images.cast("int").alias("images"), notes.cast("int").alias("notes"), F.array(*runs).alias("runs"))

    none, no = F.lit(""), F.lit(0)
    rows = F.array(
        row(F.lit(False), style, F.when(F.col("role") == "user", "heading").otherwise("x"), no, no, run(F.concat("role", F.lit(" ")), 18), run(none, 16), run(text, 2)),
        row(turn % 3 == 0, none, none, no, no, run(none, 0)),
        row(F.lit(False), F.lit("Body"), F.lit("B"), turn % 3, turn % 2, run(text, 0)),
    )
    return turns.select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(docx.blocks(rows)).alias("block_idx", "b")).select("doc_id", "turn", "block_idx", "b.*")


def word_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of Word bodies: headings by style, runs with formatting, omissions."""
    return _turn_bodies(spark, sf_dir)


def word_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images, tables and notes that are left out of each conversation's bodies."""
    return profile.omitted(_turn_bodies(spark, sf_dir))


WORD = r"""
r AS (
  SELECT row_number() OVER () AS k, conv_id, turn, role, coalesce(text, '') AS t, replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM conversations
), parts AS (
  SELECT k, 1 AS p, CASE WHEN turn % 4 = 3 AND role <> 'user' THEN 'paragraph' ELSE 'heading' END AS kind, role || ' ' || t AS x, '<b><i>' || role || ' </i></b>' || CASE WHEN t = '' THEN '' ELSE '<i>' || e || '</i>' END AS h,
         CASE turn % 4 WHEN 0 THEN 2 WHEN 1 THEN 6 WHEN 2 THEN 1 ELSE CASE WHEN role = 'user' THEN 1 ELSE 2 END END AS level FROM r
  UNION ALL SELECT k, 2, 'marker', '[tabla omitida]', '', 2 FROM r WHERE turn % 3 = 0
  UNION ALL SELECT k, 3, 'marker', '[imagen omitida]', '', 2 FROM r, unnest(range(turn % 3)) AS i(n)
  UNION ALL SELECT k, 4, 'marker', '[nota omitida]', '', 2 FROM r WHERE turn % 2 = 1
  UNION ALL SELECT k, 5, 'paragraph', t, e, 2 FROM r
), flat AS (
  SELECT k, p, kind, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text, trim(regexp_replace(h, '\s+', ' ', 'g')) AS html, level FROM parts
), blocks AS (
  SELECT conv_id AS doc_id, turn, CAST(row_number() OVER (PARTITION BY k ORDER BY p) - 1 AS INTEGER) AS block_idx, kind, flat.text, html, CAST(level AS INTEGER) AS level FROM flat JOIN r USING (k) WHERE flat.text <> ''
)"""


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a book's package: a manifest, of which one member is missing now and then, a spine, and what was found in each member."""
    pages = spread(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url"))
    item = lambda href, member, stem, present: F.struct(href.alias("href"), member.alias("member"), stem.alias("stem"), present.alias("present"))
    name = F.concat(F.lit("p"), F.col("doc_id").cast("string"))
    lit, n = F.lit, F.col("doc_id")
    items = F.create_map(
        lit("a"), item(lit("a%20b.xhtml"), lit("O/a b.xhtml"), lit("a b"), lit(True)), lit("b"), item(F.concat(name, lit(".xhtml")), F.concat(lit("O/"), name), name, n % 3 != 0),
        lit("nav"), item(lit("nav.xhtml"), lit("O/nav.xhtml"), lit("nav"), lit(True)), lit("e"), item(lit(""), lit("O"), lit(""), lit(False)),
    )
    refs = F.array(*[F.struct(lit(i).alias("idref"), lit(linear).alias("linear")) for i, linear in SPINE])
    piece = lambda kind, text: block(lit(kind), text, escape(text), lit(1 if kind == "heading" else 2))
    none = F.array().cast(f"array<{BLOCK}>")
    of_a = F.when(n % 5 == 0, none).otherwise(F.array(piece("paragraph", F.concat(lit("text of "), "url"))))
    of_b = F.when(n % 2 == 0, F.array(piece("heading", F.concat(lit("On "), "url")), piece("paragraph", F.col("url")))).otherwise(F.array(piece("paragraph", F.col("url"))))
    books = pages.withColumn("wanted", epub.spine(F.struct(items.alias("items"), refs.alias("refs"))))
    return books.withColumn("found", F.transform(F.filter("wanted", lambda i: i["present"]), lambda i: F.when(i["stem"] == "a b", of_a).otherwise(of_b)))


#: A spine with a reference that isn't linear, one to nothing, one to an item without a file, and one that comes twice.
SPINE = [("nav", "No"), ("b", "yes"), ("zz", "yes"), ("a", "YES"), ("e", "yes"), ("b", "yes")]


def book_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters of books in the order of their spines, with their titles and numbers of blocks."""
    made = _books(spark, sf_dir).select("doc_id", F.posexplode(epub.chapters(F.col("wanted"), F.col("found"))).alias("chapter_idx", "c"))
    return made.select("doc_id", "chapter_idx", "c.title", F.size("c.blocks").alias("blocks"), F.col("c.blocks")[0]["text"].alias("first"))


def book_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that spines name and that aren't there."""
    return _books(spark, sf_dir).select("doc_id", F.posexplode(epub.warnings(F.col("wanted"))).alias("place", "warning"))


BOOKS = f"""
refs AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{r}', '{linear}')" for i, (r, linear) in enumerate(SPINE))}) AS v(pos, id, linear)),
items AS (
  SELECT page_id AS doc_id, url, v.id, CASE v.id WHEN 'b' THEN 'p' || page_id || '.xhtml' ELSE v.href END AS href, CASE v.id WHEN 'b' THEN 'p' || page_id ELSE v.stem END AS stem, CASE v.id WHEN 'b' THEN page_id % 3 <> 0 ELSE v.id <> 'e' END AS present
  FROM pages, (VALUES ('a', 'a%20b.xhtml', 'a b'), ('b', '', ''), ('nav', 'nav.xhtml', 'nav'), ('e', '', '')) AS v(id, href, stem)
), spine AS (
  SELECT doc_id, url, pos, items.id, href, stem, present FROM refs JOIN items USING (id) WHERE lower(linear) <> 'no' AND href <> ''
)"""
BOOK_CHAPTERS = f"""
WITH {BOOKS}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS chapter_idx, CASE WHEN id = 'b' AND doc_id % 2 = 0 THEN 'On ' || url ELSE stem END AS title,
       CASE WHEN id = 'b' AND doc_id % 2 = 0 THEN 2 ELSE 1 END AS blocks, CASE WHEN id = 'a' THEN 'text of ' || url WHEN doc_id % 2 = 0 THEN 'On ' || url ELSE url END AS first
FROM spine WHERE present AND NOT (id = 'a' AND doc_id % 5 = 0)
"""
BOOK_WARNINGS = f"""
WITH {BOOKS}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS place, 'EPUB: el documento «' || href || '» aparece en el spine pero no está en el zip; se omite.' AS warning FROM spine WHERE NOT present
"""


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chapters, their lines as blocks, numbered without gaps."""
    cut = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("spine_pos"), "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    rows = files.dense(cut.withColumn("text", collapse(F.col("line"))))
    return rows.select("doc_id", F.col("chapter_idx").cast("int"), F.col("block_idx").cast("int"), "role", "text")


CONVERSATIONS = r"""
WITH cut AS (
  SELECT conv_id, turn, role, unnest(string_split(coalesce(text, ''), E'\n')) AS line, generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS pos FROM conversations
), flat AS (
  SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM cut
)
SELECT conv_id AS doc_id, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS chapter_idx,
       CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS INTEGER) AS block_idx, role, text
FROM flat WHERE text <> ''
"""

def numbers_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as the console and the file names show them."""
    n = F.col("n_chars")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", thousands(n * 1000).alias("thousands"), duration(n).alias("duration"), chapter_file(F.col("doc_id")).alias("file"), rate_and_eta(F.lit(10), n, F.lit(2.0))["eta"].cast("long").alias("eta"))


NUMBERS = """
SELECT doc_id, replace(format('{:,}', n_chars * 1000), ',', '.') AS thousands,
       CASE WHEN n_chars < 60 THEN n_chars || ' s' WHEN n_chars < 3600 THEN (n_chars // 60) || ' min ' || (n_chars % 60) || ' s' ELSE (n_chars // 3600) || ' h ' || (n_chars // 60 % 60) || ' min' END AS duration,
       printf('cap-%03d.jsonl', doc_id) AS file, CAST(trunc((n_chars - 10) / 5.0) AS BIGINT) AS eta
FROM documents
"""


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems and suffixes of the pages' addresses, and the reader that each suffix would have."""
    at = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return at.select("page_id", stem(F.col("path")).alias("stem"), suffix(F.col("path")).alias("suffix"), suffix(F.col("path")).isin(*files.FORMATS).alias("supported"))


FILE_NAMES = r"""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages), n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS suffix FROM p)
SELECT page_id, regexp_replace(name, '(.)\.[^.]*$', '\1') AS stem, suffix, suffix IN ('.txt', '.md', '.epub', '.docx', '.pdf') AS supported FROM n
"""


def decoded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read back from bytes: with a byte order mark, with foreign line ends, and in the old single-byte encoding where it has all characters."""
    raw = F.concat(F.lit("\ufeff"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\r\n")))
    utf8 = normal_lines(decoded(F.encode(raw, "UTF-8")))
    single = F.when(F.coalesce("text", F.lit("")).rlike("^[\\x00-\\x7f\\xa0-\\xff]*$"), decoded(F.encode(F.concat(F.coalesce("text", F.lit("")), F.lit(" é")), "ISO-8859-1")))
    return documents(spark, sf_dir).select("doc_id", F.sha2(utf8, 256).alias("utf8"), F.sha2(single, 256).alias("single"))


DECODED = r"""
SELECT doc_id, sha256(coalesce(text, '')) AS utf8, CASE WHEN regexp_full_match(coalesce(text, ''), '[\x00-\x7f\x{a0}-\x{ff}]*', 's') THEN sha256(coalesce(text, '') || ' é') END AS single FROM documents
"""


def languages_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's languages by name, of several names the first, with the number of documents of each."""
    counts = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("code")).agg(F.count(F.lit(1)).alias("documents"))
    every = language.packages_table(spark, [*PACKAGES, ("es", "Castilian", "ca", "Valencian", False, 10), ("xa", "", "en", "English", False, 11)])
    return language.catalogue(every).join(counts, "code", "left").select("code", "name", F.coalesce("documents", F.lit(0)).alias("documents"), (F.row_number().over(Window.orderBy("name")) - 1).alias("place"))  # one row a language


def language_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All languages in one line, by name."""
    return language.language_list(language.packages_table(spark, PACKAGES))


def install_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packages that the documents' languages need for Spanish and Portuguese, each once."""
    packages = language.packages_table(spark, PACKAGES)
    own = table(spark, sf_dir, "documents").select(F.col("lang").alias("source")).filter("source is not null").distinct()
    pairs = own.withColumn("target", F.explode(F.array(F.lit("es"), F.lit("pt"))))
    return language.provision(language.pair_plan(pairs, packages), packages).select("from_code", "to_code", "from_name", "to_name", "ord")


def styled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's words as runs, formatted by their lengths."""
    words = F.transform(F.split("text", " "), lambda w: F.struct(F.concat(w, F.lit(" ")).alias("text"), F.element_at(F.array(F.lit(0), F.lit(2), F.lit(16), F.lit(18)), F.pmod(F.length(w), F.lit(4)) + 1).alias("flags")))
    return lines(spark, sf_dir).select("doc_id", "block_idx", styled(words).alias("s")).select("doc_id", "block_idx", F.sha2("s.html", 256).alias("html"), F.trim("s.plain").alias("plain"))


STYLED = f"""
WITH {LINES}, w AS (SELECT doc_id, block_idx, text, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS i FROM lines),
e AS (SELECT *, replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || ' ' AS h FROM w)
SELECT doc_id, block_idx, sha256(string_agg(CASE length(x) % 4 WHEN 0 THEN h WHEN 1 THEN '<i>' || h || '</i>' WHEN 2 THEN '<b>' || h || '</b>' ELSE '<b><i>' || h || '</i></b>' END, '' ORDER BY i)) AS html, any_value(text) AS plain
FROM e GROUP BY doc_id, block_idx
"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their lines as pages: eight layout boxes a page; lines of under 12 characters are images; pages of over four lines have a table over the third and fourth, and half of the fifth."""
    box = lambda *x: F.struct(*[v.cast("double").alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), x, strict=True)])
    no_lines = F.array().cast("array<array<struct<text:string,flags:int>>>")

    def boxed(text: Column, i: Column) -> Column:
        image = F.length(text) < 12
        spans = F.transform(F.split(text, ", "), lambda t: F.array(F.struct(t.alias("text"), F.lit(2).alias("flags"))))
        return F.struct(i.alias("pos"), image.cast("int").alias("type"), box(F.lit(0), i * 10, F.lit(9), i * 10 + 10).alias("bbox"), F.when(image, no_lines).otherwise(spans).alias("lines"))

    def page(n: Column) -> Column:
        def of(own: Column) -> Column:
            tables = F.when(F.size(own) > 4, F.array(box(F.lit(-5), F.lit(20), F.lit(50), F.lit(45)))).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
            return F.struct(n.alias("page"), F.transform(own, boxed).alias("boxes"), tables.alias("tables"))

        return once(F.slice("lines", n * 8 + 1, 8), of)

    docs = line_arrays(spark, sf_dir).filter(F.size("lines") > 0).select("doc_id", "lines")
    return docs.select("doc_id", F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 8).cast("int")), page).alias("pages"))


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with a layout: lines joined, tables and images marked, fragments merged."""
    return layout.numbered(_pages(spark, sf_dir)).select("doc_id", "block_idx", "kind", "text", "html")


def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with pages that hold images alone, and the warning."""
    found = layout.scanned_documents(_pages(spark, sf_dir))
    return found.select("doc_id", "n_scanned", F.array_join(F.col("first_pages").cast("array<string>"), ", ").alias("first_pages"), layout.scanned_warning(F.col("n_scanned"), F.col("first_pages")).alias("warning"))


_BOXES = f"""{LINES}, box AS (
  SELECT doc_id, block_idx // 8 AS page, block_idx % 8 AS pos, text, length(text) < 12 AS image, count(*) OVER (PARTITION BY doc_id, block_idx // 8) > 4 AND block_idx % 8 IN (2, 3) AS inside FROM lines
)"""

LAYOUT = rf"""
WITH {_BOXES}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page, inside AND NOT image ORDER BY pos) AS k,
         trim(regexp_replace(replace(regexp_replace(text, '-, ([a-záéíóúüñàèìòùâêîôûäëïöç])', '\1', 'g'), ', ', ' '), '\s+', ' ', 'g')) AS joined FROM box
), b AS (
  SELECT doc_id, page * 8 + pos AS nr, CASE WHEN image OR inside THEN 'marker' ELSE 'paragraph' END AS kind,
         CASE WHEN image THEN '[imagen omitida]' WHEN inside THEN '[tabla omitida]' ELSE joined END AS text
  FROM placed WHERE image OR (inside AND k = 1) OR (NOT inside AND joined <> '' AND NOT regexp_matches(joined, '^[0-9]{{1,4}}$'))
), flag AS (
  SELECT *, lag(text) OVER w AS p, coalesce(kind = 'paragraph' AND lag(kind) OVER w = 'paragraph' AND (lag(text) OVER w LIKE '%-' OR (NOT regexp_matches(lag(text) OVER w, '[.!?:;…»”"'']\s*$') AND regexp_matches(text, '^[a-záéíóúüñàèìòùâêîôûäëïöç]'))), false) AS joins
  FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY nr)
), isle AS (
  SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER w AS island, CASE WHEN NOT joins OR p LIKE '%-' THEN '' ELSE ' ' END AS sep, coalesce(lead(joins) OVER w, false) AND text LIKE '%-' AS cut
  FROM flag WINDOW w AS (PARTITION BY doc_id ORDER BY nr)
), part AS (
  SELECT *, CASE WHEN cut THEN left(text, -1) ELSE text END AS t FROM isle
)
SELECT doc_id, CAST(island - 1 AS INTEGER) AS block_idx, any_value(kind) AS kind, string_agg(sep || t, '' ORDER BY nr) AS text,
       CASE WHEN any_value(kind) = 'marker' THEN '' ELSE string_agg(sep || '<i>' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</i>', '' ORDER BY nr) END AS html
FROM part GROUP BY doc_id, island
"""

SCANNED = f"""
WITH {_BOXES}, p AS (SELECT doc_id, page + 1 AS page FROM box GROUP BY doc_id, page HAVING bool_and(image)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM p),
d AS (SELECT doc_id, count(*) AS n_scanned, string_agg(CAST(page AS VARCHAR), ', ' ORDER BY page) FILTER (WHERE i <= 10) AS first_pages FROM k GROUP BY doc_id)
SELECT *, 'PDF: ' || n_scanned || ' página(s) sin capa de texto omitida(s) (¿escaneadas?): ' || first_pages || CASE WHEN n_scanned > 10 THEN '…' ELSE '' END || '. OCR fuera del alcance.' AS warning FROM d
"""

_PACKAGES_MORE = _PACKAGES_SQL[:-1] + ", ('es', 'Castilian', 'ca', 'Valencian', false, 10), ('xa', '', 'en', 'English', false, 11))"

LANGUAGES_USED = f"""
WITH {_PACKAGES_MORE}, names AS (
  SELECT c AS code, arg_min(CASE WHEN n = '' THEN c ELSE n END, p) AS name FROM (SELECT f AS c, fn AS n, (CASE WHEN i THEN 0 ELSE 1000 END) + o * 2 AS p FROM packages UNION ALL SELECT t, tn, (CASE WHEN i THEN 0 ELSE 1000 END) + o * 2 + 1 FROM packages) GROUP BY c
)
SELECT code, name, (SELECT count(*) FROM documents WHERE lang = code) AS documents, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS place FROM names
"""

LANGUAGE_MENU = f"""
WITH {_PACKAGES_SQL}, names AS (
  SELECT c, arg_min(n, p) AS n FROM (SELECT f AS c, fn AS n, (CASE WHEN i THEN 0 ELSE 1000 END) + o * 2 AS p FROM packages UNION ALL SELECT t, tn, (CASE WHEN i THEN 0 ELSE 1000 END) + o * 2 + 1 FROM packages) GROUP BY c
)
SELECT string_agg(n || ' (' || c || ')', ', ' ORDER BY n) AS languages FROM names
"""

INSTALL_LIST = f"""
{PAIR_PLAN.replace("codes AS (SELECT f AS c FROM packages UNION SELECT t FROM packages)", "codes(c) AS (VALUES ('es'), ('pt'))").replace("SELECT source, target, w = 'pivot' AS pivot,", "SELECT DISTINCT p.f AS from_code, p.t AS to_code, p.fn AS from_name, p.tn AS to_name, p.o AS ord FROM (SELECT source, target, w = 'pivot' AS pivot,")}) AS plan
JOIN packages p ON contains(',' || to_install || ',', ',' || p.f || '>' || p.t || ',')
"""

# Inline Markdown without lookarounds: two passes take the place of one that looks at its neighbours.
_ITALIC = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(^|[^*])\*([^*\n]+)\*($|[^*])', '\1{a}\2{b}\3', 'g'), '(^|[^*])\*([^*\n]+)\*($|[^*])', '\1{a}\2{b}\3', 'g'), '(^|[^_])_([^_\n]+)_($|[^_])', '\1{a}\2{b}\3', 'g'), '(^|[^_])_([^_\n]+)_($|[^_])', '\1{a}\2{b}\3', 'g')"
_LINKS = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[\^[^\]]+\]', '', 'g'), '\[([^\]]+)\]\(([^)]*)\)', '\1', 'g'), '`([^`]*)`', '\1', 'g'), '\s+', ' ', 'g'))"
_BOLD = r"\*\*(.+?)\*\*|__(.+?)__"

_UNLINKED = f"unlinked AS (SELECT doc_id, block_idx, {_LINKS} AS x FROM lines)"
_PLAIN = _ITALIC.format(rf"regexp_replace(x, '{_BOLD}', '\1\2', 'g')", a="", b="")
_MARKED = _ITALIC.format(rf"regexp_replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '{_BOLD}', '<b>\1\2</b>', 'g')", a="<i>", b="</i>")
#: The documents' lines have no other markup than inline one.
MARKDOWN = f"WITH {LINES}, {_UNLINKED} SELECT doc_id, 0 AS chapter_idx, block_idx, 'paragraph' AS kind, {_PLAIN} AS text, {_MARKED} AS html, 2 AS level FROM unlinked"
ITALICS = f"WITH {LINES}, {_UNLINKED} SELECT doc_id, block_idx, {_PLAIN} AS text, {_MARKED} AS html FROM unlinked"

class _Sql(str):
    """An SQL expression among the strings of ``_structured``."""


_TURN = " || ".join(x if isinstance(x, _Sql) else "'" + x + "'" for x in _structured(_Sql("coalesce(text, '')"), _Sql("role"), "turn % 6 + 1", lambda c, n: _Sql(f"repeat('{c}', CAST({n} AS INTEGER))"), "\n"))
#: The automaton as a fold over a text's lines, one of each text a step.
MARKDOWN_CONSTRUCTS = rf"""
WITH RECURSIVE turns AS (
  SELECT row_number() OVER () AS k, conv_id, turn, {_TURN} AS t FROM conversations
), cut AS (
  SELECT k, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM turns
), quoted AS (
  SELECT *, regexp_replace(raw, '^\s{{0,3}}>\s?', '') AS line, coalesce(lead(raw) OVER (PARTITION BY k ORDER BY n), '') AS after FROM cut
), kinds AS (
  SELECT *, CASE WHEN NOT regexp_matches(raw, '\S') THEN 'b' WHEN NOT regexp_matches(line, '\S') THEN 'q' WHEN regexp_matches(line, '^#{{1,6}}\s') THEN 'h'
                 WHEN regexp_matches(line, '^\s{{0,3}}(-{{3,}}|\*{{3,}}|_{{3,}})\s*$') THEN 'r' WHEN regexp_matches(line, '^\s{{0,3}}\[\^[^\]]+\]:') THEN 'n'
                 WHEN contains(raw, '|') AND contains(after, '|') AND regexp_matches(after, '^\s*\|?[\s:|-]+\|[\s:|-]*\|?\s*$') THEN 't'
                 WHEN regexp_matches(line, '^\s{{0,3}}([-*+]|[0-9]{{1,3}}[.)])\s+') THEN 'i' ELSE 'x' END AS c FROM quoted
), valued AS (
  SELECT k, n, contains(raw, '|') AS bar, c, CASE c WHEN 'h' THEN regexp_extract(line, '^#{{1,6}}\s+(.*?)\s*#*\s*$', 1) WHEN 'i' THEN trim(regexp_replace(line, '^\s{{0,3}}([-*+]|[0-9]{{1,3}}[.)])\s+', ''), E' \t') ELSE trim(line, E' \t') END AS v,
         CASE c WHEN 'h' THEN length(regexp_extract(line, '^(#{{1,6}})', 1)) ELSE 2 END AS level FROM kinds
), fold(k, n, mode, nr, kind, v, level) AS (
  SELECT k, 0, 'none', 0, CAST(NULL AS VARCHAR), '', 2 FROM turns UNION ALL
  SELECT x.k, x.n, x.mode, f.nr + CASE WHEN x.kind IS NULL OR (x.kind = 'paragraph' AND f.mode = x.mode AND x.more) THEN 0 ELSE 1 END, x.kind, x.v, x.level FROM fold AS f JOIN LATERAL (
    SELECT l.k, l.n, l.v, l.level, l.c = 'x' OR (l.c = 'n' AND f.mode = 'item') AS more,
           CASE WHEN l.c = 'b' THEN 'none' WHEN f.mode = 'note' THEN 'note' WHEN f.mode = 'table' AND l.bar THEN 'table' WHEN l.c = 'x' AND f.mode IN ('text', 'item') THEN f.mode WHEN l.c = 'n' AND f.mode = 'item' THEN 'item'
                WHEN l.c = 'x' THEN 'text' WHEN l.c = 'n' THEN 'note' WHEN l.c = 't' THEN 'table' WHEN l.c = 'i' THEN 'item' ELSE 'none' END AS mode,
           CASE WHEN l.c IN ('b', 'q', 'r') OR f.mode = 'note' OR (f.mode = 'table' AND l.bar) THEN NULL WHEN l.c = 'h' THEN 'heading' WHEN l.c = 't' OR (l.c = 'n' AND f.mode <> 'item') THEN 'marker' ELSE 'paragraph' END AS kind
    FROM valued AS l WHERE l.k = f.k AND l.n = f.n + 1
  ) AS x ON true
), whole AS (
  SELECT k, nr, any_value(kind) AS kind, CASE any_value(kind) WHEN 'marker' THEN CASE WHEN any_value(mode) = 'note' THEN '[nota omitida]' ELSE '[tabla omitida]' END ELSE string_agg(v, ' ' ORDER BY n) END AS md, min(level) AS level
  FROM fold WHERE kind IS NOT NULL GROUP BY k, nr
), placed AS (
  SELECT k, nr, 0 AS j, 'marker' AS kind, '[imagen omitida]' AS text, 2 AS level FROM whole, unnest(regexp_extract_all(md, '!\[[^\]]*\]\([^)]*\)')) AS r(image) WHERE kind = 'paragraph' UNION ALL
  SELECT k, nr, 1, kind, CASE WHEN kind = 'paragraph' THEN regexp_replace(md, '!\[[^\]]*\]\([^)]*\)', '', 'g') ELSE md END, level FROM whole
), unlinked AS (
  SELECT *, {_LINKS} AS x FROM placed
), done AS (
  SELECT *, CASE WHEN kind = 'marker' THEN text ELSE {_PLAIN} END AS own, CASE WHEN kind = 'marker' THEN '' ELSE {_MARKED} END AS html FROM unlinked
)
SELECT conv_id AS doc_id, turn, CAST(row_number() OVER (PARTITION BY k ORDER BY nr, j) - 1 AS INTEGER) AS block_idx, kind, own AS text, html, CAST(level AS INTEGER) AS level
FROM done JOIN turns USING (k) WHERE own <> ''
"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "doc_volume": (doc_volume, DOC_VOLUME),
    "line_blocks": (line_blocks, f"WITH {LINES} SELECT doc_id, block_idx, text FROM lines"),
    "markdown_blocks": (markdown_blocks, MARKDOWN),
    "markdown_constructs": (markdown_constructs, MARKDOWN_CONSTRUCTS),
    "line_volume": (line_volume, LINE_VOLUME),
    "language_volume": (language_volume, f"WITH {LINES} SELECT lang, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS words, count(*) AS paragraphs, count(*) AS translatable FROM lines GROUP BY lang"),
    "sample_text": (sample_text, SAMPLE),
    "bold_plain": (bold_plain, rf"WITH {LINES} SELECT doc_id, block_idx, regexp_replace(text, '{_BOLD}', '\1\2', 'g') AS text FROM lines"),
    "inline_html": (inline_html, rf"WITH {LINES} SELECT doc_id, block_idx, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '{_BOLD}', '<b>\1\2</b>', 'g') AS html FROM lines"),
    "italic_plain": (italic_plain, ITALICS),
    "content_hash": (content_hash, "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, substring(sha256(coalesce(text, '')), 1, 12) || '-' || lang || '-xx' AS job FROM documents"),
    "pending_blocks": (pending_blocks, f"WITH {KEYED} SELECT doc_id, block_idx, text FROM keyed ANTI JOIN store USING (sha256, pair, block_idx)"),
    "resume_counts": (resume_counts, f"WITH {KEYED} SELECT k.doc_id, count(*) AS translatable, count(s.t) AS resumed, count(*) - count(s.t) AS fresh FROM keyed k LEFT JOIN store s USING (sha256, pair, block_idx) GROUP BY k.doc_id"),
    "resume_last_wins": (resume_last_wins, f"WITH {KEYED} SELECT sha256, pair, block_idx, t FROM every"),
    "resume_from_store": (resume_from_store, f"WITH {KEYED} SELECT doc_id, block_idx, CASE WHEN length(text) > 40 THEN CASE WHEN contains(text, 'e') THEN text || '!' WHEN sha256 >= '8' THEN lower(text) END END AS t FROM keyed"),
    "aligned_rows": (aligned_rows, f"{ALIGNED} SELECT doc_id, block_idx, row FROM rendered"),
    "rendered_document": (rendered_document, f"{ALIGNED} SELECT doc_id, length(string_agg(row, E'\\n' ORDER BY block_idx)) AS chars, sha256(string_agg(row, E'\\n' ORDER BY block_idx)) AS sha256 FROM rendered GROUP BY doc_id"),
    "merge_fragments": (merge_fragments, MERGED),
    "line_join": (line_join, LINE_JOIN),
    "language_lookup": (language_lookup, _lookup_sql()),
    "pair_plan": (pair_plan, PAIR_PLAN),
    "detected_language": (detected_language, DETECTED_LANGUAGE),
    "omitted_summary": (omitted_summary, _omitted_sql("marked")),
    "page_blocks": (page_blocks, f"WITH {PAGES} SELECT doc_id, block_idx, kind, text, html, level FROM blocks"),
    "page_titles": (page_titles, PAGE_TITLES),
    "page_omitted": (page_omitted, _omitted_sql("blocks")),
    "page_rows": (page_rows, PAGE_ROWS),
    "page_volume": (page_volume, PAGE_VOLUME),
    "word_blocks": (word_blocks, f"WITH {WORD} SELECT * FROM blocks"),
    "word_omissions": (word_omissions, f"WITH {WORD}" + _omitted_sql("blocks")[_omitted_sql("blocks").index(", n AS ("):]),
    "book_chapters": (book_chapters, BOOK_CHAPTERS),
    "book_warnings": (book_warnings, BOOK_WARNINGS),
    "conversation_blocks": (conversation_blocks, CONVERSATIONS),
    "numbers_text": (numbers_text, NUMBERS),
    "file_names": (file_names, FILE_NAMES),
    "decoded_text": (decoded_text, DECODED),
    "languages_used": (languages_used, LANGUAGES_USED),
    "language_menu": (language_menu, LANGUAGE_MENU),
    "install_list": (install_list, INSTALL_LIST),
    "styled_words": (styled_words, STYLED),
    "layout_blocks": (layout_blocks, LAYOUT),
    "scanned_pages": (scanned_pages, SCANNED),
}
