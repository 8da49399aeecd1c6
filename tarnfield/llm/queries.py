"""The operators' queries over the given tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm import ann, brown, collocations, decontam, fertility, langid, linededup, mixing, pages, sharding, simhash, spelling, toxicity
from tarnfield.llm.common import remainder

SHARDS = 40


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op2_language_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    rest = remainder(F.col("doc_id"), 3)
    model = langid.fit(docs.filter(rest != 1).select("text", "lang"))
    return langid.labelled(docs.select("doc_id", "text"), model).select(
        "doc_id", (rest == 1).alias("held_out"), "lang_pred", "score", "spans"
    )


def op3_brown_classes(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", remainder(F.col("doc_id"), 10) == 0)
    model, vocabulary = brown.fit(docs.filter(~F.col("held_out")))
    return brown.scored(docs, model, vocabulary).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"
    )


def op4_interleaved_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.interleaved(read(spark, folder, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_qgram_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = decontam.with_leaks(docs, read(spark, folder, "benchmark"))
    items = F.array_sort(F.array_distinct("leaks.item_id")).alias("item_ids")
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), items, "leaks")


def op6_line_windows(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = linededup.without_repeated_windows(read(spark, folder, "documents"))
    span = F.transform("removed", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string")))
    return cleaned.select("doc_id", "text", "n_lines", "n_removed", F.array_join(span, ",").alias("removed"))


def op7_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, folder, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return toxicity.scored(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "passages"
    )


def op8_kmeans_tree_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_url_differencing(spark: SparkSession, folder: str) -> DataFrame:
    return pages.main_text(read(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op10_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.poisson_mix(read(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "copies", "copy", "position", "text")


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(read(spark, folder, "documents"))


def op12_tokeniser_fertility(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    return fertility.judged(docs, texts=False).drop("lang")


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_language_spans, op3_brown_classes, op4_interleaved_shards, op5_qgram_decontamination, op6_line_windows, op7_toxic_segments, op8_kmeans_tree_neighbours, op9_url_differencing, op10_poisson_mix, op11_spelling_variants, op12_tokeniser_fertility, op13_phrase_collocations)}

#: 52 bits of a text's md5 as a number in [0, 1).
UNIT = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"

#: crc32's table of 256 steps.
STEPS = """
        steps AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                lambda a, k: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END))) AS step)"""

#: ``{}`` with A-Z in lower case and nothing else changed.
LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op4_interleaved_shards": f"""
        WITH steps AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                lambda a, k: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END))) AS step),
        texts AS (
            SELECT doc_id, source, coalesce(doc_id, -1) AS id, coalesce(hex(encode(text)), '') AS h,
                   coalesce(octet_length(encode(text)), 0) + 16 AS size FROM documents),
        sums AS (
            SELECT doc_id, source, id, size, xor(4294967295, list_reduce(list_prepend(4294967295,
                list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                lambda a, x: xor(a >> 8, step[xor(a % 256, x) + 1]))) AS crc FROM texts, steps),
        keyed AS (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY crc, size, source) AS nth FROM sums),
        drawn AS (
            SELECT *, {UNIT.format("id || '/' || nth || '/shard17'")} AS draw FROM keyed),
        ranked AS (
            SELECT *, (row_number() OVER (PARTITION BY source ORDER BY draw, id, nth) - 0.5::DOUBLE)
                / count(*) OVER (PARTITION BY source) AS fraction FROM drawn),
        placed AS (
            SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, id, nth) - 1 AS place,
                count(*) OVER () AS n FROM ranked),
        cut AS (SELECT *, place * {SHARDS} // n AS shard FROM placed)
        SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard,
               (place - (shard * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard
        FROM cut""",
    "op6_line_windows": """
        WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        windows AS (
            SELECT doc_id, line, [lines[line + 1], lines[line + 2], lines[line + 3]] AS three
            FROM (SELECT doc_id, lines, unnest(range(len(lines) - 2)) AS line FROM split WHERE len(lines) >= 3)),
        later AS (
            SELECT doc_id, line FROM (
                SELECT *, row_number() OVER (PARTITION BY three ORDER BY doc_id, line) AS nth FROM windows)
            WHERE nth > 1),
        gone AS (
            SELECT DISTINCT doc_id, unnest([line, line + 1, line + 2]) AS line FROM later),
        runs AS (
            SELECT doc_id, min(line) AS first, max(line) AS last FROM (
                SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM gone)
            GROUP BY doc_id, run),
        spans AS (
            SELECT doc_id, string_agg(first || '-' || last, ',' ORDER BY first) AS removed,
                   sum(last - first + 1) AS n FROM runs GROUP BY doc_id),
        kept AS (
            SELECT doc_id, string_agg(content, chr(10) ORDER BY line) AS text FROM (
                SELECT doc_id, unnest(lines) AS content, unnest(range(len(lines))) AS line FROM split)
            ANTI JOIN gone USING (doc_id, line) GROUP BY doc_id)
        SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
               coalesce(len(s.lines), 0)::INT AS n_lines, coalesce(p.n, 0)::INT AS n_removed,
               coalesce(p.removed, '') AS removed
        FROM split s LEFT JOIN kept k USING (doc_id) LEFT JOIN spans p USING (doc_id)""",
    "op10_poisson_mix": f"""
        WITH sizes AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
        rates AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM sizes),
        parts AS (SELECT source, greatest(1, ceil(rate / 16))::INT AS parts, rate / greatest(1, ceil(rate / 16)) AS mean FROM rates),
        laws AS (
            SELECT source, parts, list_transform(range(81), lambda k: list_sum(list_transform(range(k + 1),
                lambda j: exp(j * ln(mean) - mean - lgamma(j + 1))))) AS cumulative FROM parts),
        counted AS (
            SELECT doc_id, d.source, text, list_sum(list_transform(range(1, parts + 1), lambda p: len(list_filter(cumulative,
                lambda c: c <= {UNIT.format("coalesce(doc_id::VARCHAR, '') || '/' || p || '/poisson17'")}))))::INT AS copies
            FROM documents d JOIN laws l ON d.source IS NOT DISTINCT FROM l.source),
        copied AS (SELECT *, unnest(range(1, copies + 1))::INT AS copy FROM counted WHERE copies > 0)
        SELECT doc_id, source, copies, copy, row_number() OVER (ORDER BY
            {UNIT.format("coalesce(doc_id::VARCHAR, '') || '/' || copy || '/order17'")}, doc_id, copy) - 1 AS position, text
        FROM copied""",
    "op11_spelling_variants": f"""
        WITH RECURSIVE {STEPS},
        runs AS (
            SELECT doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
        each AS (
            SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h
            FROM runs GROUP BY doc_id, run),
        drawn AS (
            SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295,
                list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                lambda a, x: xor(a >> 8, step[xor(a % 256, x) + 1]))) AS crc FROM each, steps),
        written AS (
            SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2)
                ELSE run END AS word, n FROM drawn),
        words AS (
            SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        spots AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
        replaced AS (SELECT word, n, substr(word, 1, i) || '?' || substr(word, i + 2) AS key FROM spots),
        deleted AS (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS key FROM spots),
        pairs AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM replaced a JOIN replaced b USING (key) WHERE a.word <> b.word
            UNION ALL SELECT d.word, w.word, w.n FROM deleted d JOIN words w ON w.word = d.key
            UNION ALL SELECT w.word, d.word, d.n FROM deleted d JOIN words w ON w.word = d.key),
        best AS (
            SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM pairs
            QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
        forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form,
                CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
        chain AS (
            SELECT word, form AS root FROM forms WHERE form IS NOT NULL
            UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
        ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
        SELECT f.word, form, coalesce(e.root, f.word) AS root, n, n_near, form_n
        FROM forms f LEFT JOIN ends e ON e.word = f.word""",
    "op13_phrase_collocations": f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                unnest(regexp_split_to_array({LOWER.format("text")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
        starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
        sized AS (SELECT lang, w, i, unnest([1, 2, 3, 4]) AS k FROM starts),
        counted AS (
            SELECT lang, list_slice(w, i, i + k - 1) AS p, count(*) AS f FROM sized WHERE i + k - 1 <= len(w) GROUP BY ALL),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE len(p) = 1 GROUP BY lang),
        often AS (SELECT * FROM counted WHERE f >= 30),
        cuts AS (SELECT lang, p, f, unnest(range(1, len(p))) AS k FROM often WHERE len(p) > 1),
        parted AS (
            SELECT c.lang, c.p, c.f AS a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
            FROM cuts c JOIN often x ON x.lang = c.lang AND x.p = c.p[1:c.k]
            JOIN often y ON y.lang = c.lang AND y.p = c.p[c.k + 1:len(c.p)]),
        weakest AS (SELECT * FROM parted QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
        spans AS (SELECT lang, p, f, unnest(range(2, len(p))) AS size FROM often WHERE len(p) > 2),
        inner_ AS (
            SELECT lang, list_slice(p, i, i + size - 1) AS p, f FROM (
                SELECT *, unnest(range(1, len(p) - size + 2)) AS i FROM spans)),
        most AS (SELECT lang, p, max(f) AS f FROM inner_ GROUP BY ALL),
        kept AS (
            SELECT w.*, array_to_string(w.p, ' ') AS phrase FROM weakest w LEFT JOIN most m ON m.lang = w.lang AND m.p = w.p
            WHERE m.f IS NULL OR 100 * m.f < 80 * w.a),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT r.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r.r::BIGINT AS r, n, score::BIGINT AS score
        FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000""",
}
