"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import (
    chat, collocations, decontamination, exact_dedup, knn_quality, line_dedup, mixing, packing, quality_rules, simhash, suffix_dedup,
    toxicity, vector_codes
)
from recordloom.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _words_sql() -> str:
    lists = ", ".join(f"({code!r}, {listed!r})" for code, listed in quality_rules.COMMON_WORDS.items())
    return f"(VALUES {lists}) AS fixed(lang, listed)"


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


@query(
    r"""
    WITH h AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
    )
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM h WINDOW w AS (PARTITION BY text_sha256)
    """
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("hash")).alias("text_sha256")
    )


@query()
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


@query(
    r"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
            sha256('mix:' || doc_id) AS digest
        FROM documents
    ), totals AS (
        SELECT source, sum(size)::BIGINT AS source_size,
            [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight
        FROM sized GROUP BY source
    ), ordered AS (
        SELECT *, sum(source_size) OVER () AS words,
            coalesce(sum(3 * source_size) OVER before, 0) AS held, sum(weight) OVER after AS free
        FROM totals
        WINDOW before AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            after AS (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ), level AS (
        SELECT (words - held)::BIGINT AS w, free::BIGINT AS f FROM ordered
        WHERE 3 * source_size * free >= weight * (words - held)
        ORDER BY source_size / weight, source LIMIT 1
    ), targets AS (
        SELECT source, source_size, CASE WHEN 3 * source_size * f < weight * w THEN 3.0::DOUBLE * source_size
            ELSE weight * w::DOUBLE / f::DOUBLE END AS target
        FROM totals, level
    ), rated AS (
        SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS rate FROM targets
    ), drawn AS (
        SELECT d.doc_id, d.size, r.*, s.seed, floor(rate)::BIGINT +
            (('0x' || substr(digest, 8 * s.seed + 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate))::BIGINT AS copies
        FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source, (SELECT unnest(range(8))::INT AS seed) s
    ), gaps AS (
        SELECT source, seed, abs(sum(size * copies) - any_value(target)) AS gap FROM drawn GROUP BY source, seed
    ), best AS (
        SELECT source, seed FROM gaps QUALIFY row_number() OVER (PARTITION BY source ORDER BY gap, seed) = 1
    )
    SELECT d.doc_id, d.size, d.source_size, d.target, d.size * d.copies AS taken
    FROM drawn d JOIN best b ON d.source IS NOT DISTINCT FROM b.source AND d.seed = b.seed
    """
)
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, sources = mixing.plan_mixture(table(spark, sf_dir, "documents"))
    return mixing.with_copies(sizes, sources, sizes.count()).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@query(
    r"""
    WITH lines AS (
        SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS lines FROM documents
    ), windows AS (
        SELECT doc_id, i, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS content
        FROM (SELECT doc_id, lines, unnest(range(len(lines) - 2)) AS i FROM lines WHERE len(lines) >= 3)
    ), later AS (
        SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, i) > 1
    ), gone AS (
        SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run
        FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS line FROM later)
    ), places AS (
        SELECT doc_id, list(line) AS places, count(DISTINCT run) AS n_spans FROM gone GROUP BY doc_id
    ), left_over AS (
        SELECT l.doc_id, len(lines) AS n_lines, coalesce(len(places), 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            array_to_string(CASE WHEN places IS NULL THEN lines
                ELSE list_transform(list_filter(range(len(lines)), lambda x: NOT list_contains(places, x)), lambda x: lines[x + 1]) END, chr(10)) AS kept
        FROM lines l LEFT JOIN places p ON l.doc_id = p.doc_id
    )
    SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
        sha256(coalesce(kept, '')) AS kept_sha256
    FROM left_over
    """
)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256")
    )


@query(
    r"""
    WITH raw AS MATERIALIZED (
        SELECT doc_id, d.lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, fixed.listed AS fixed
        FROM documents d LEFT JOIN @WORDS@ ON d.lang = fixed.lang
    ), own AS (
        SELECT lang, list(word ORDER BY word) AS listed FROM (
            SELECT lang, word FROM (
                SELECT lang, unnest(w) AS word, 1000000000 // len(w) AS share
                FROM (SELECT DISTINCT lang, regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+') AS w FROM raw WHERE fixed IS NULL) WHERE len(w) > 0
            ) GROUP BY lang, word QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sum(share) DESC, word) <= 20
        ) GROUP BY lang
    ), base AS MATERIALIZED (
        SELECT raw.*, coalesce(fixed, own.listed) AS listed FROM raw LEFT JOIN own ON raw.lang IS NOT DISTINCT FROM own.lang
    ), windows AS (
        SELECT doc_id, i, w[i + 1 : i + 5] AS content FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM base)
    ), repeats AS (
        SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (
            SELECT doc_id, i + unnest(range(5)) AS place FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, content) > 1
        ) GROUP BY doc_id
    ), l1 AS (SELECT *, regexp_replace(t, '\p{Ll}+', '', 'g') AS l1 FROM base
    ), l2 AS (SELECT *, regexp_replace(l1, '[\x20\x09-\x0D]+', '', 'g') AS l2 FROM l1
    ), l3 AS (SELECT *, regexp_replace(l2, '\p{Lu}+', '', 'g') AS l3 FROM l2
    ), l4 AS (SELECT *, regexp_replace(l3, '\p{L}+', '', 'g') AS l4 FROM l3
    ), l5 AS (SELECT *, regexp_replace(l4, '\p{N}+', '', 'g') AS l5 FROM l4
    ), l6 AS (SELECT *, regexp_replace(l5, '[.,;:?''"()-]+', '', 'g') AS l6 FROM l5
    ), l7 AS (SELECT *, regexp_replace(l6, '\p{M}+', '', 'g') AS l7 FROM l6
    ), judged AS MATERIALIZED (
        SELECT doc_id, lang, t, length(t) AS n_chars, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
            len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
            (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
                - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
            len(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(w) AS base_failed,
            [length(t) - length(l1), length(l1) - length(l2), length(l2) - length(l3), length(l3) - length(l4), length(l4) - length(l5),
                length(l5) - length(l6), length(l6) - length(l7), length(l7)] AS chars,
            list_transform(range(1, 21), lambda k: len(list_filter(w, lambda x: lower(x) = listed[k]))) AS found
        FROM l7 LEFT JOIN repeats USING (doc_id)
    ), bins AS (
        SELECT doc_id, 'chars' AS kind, unnest(range(1, 9)) AS k, unnest([1, 1, 1, 1, 2, 3, 1, 4]) AS g, unnest(chars) AS n, n_chars AS total, n_chars >= 200 AS enough FROM judged
        UNION ALL
        SELECT doc_id, 'words', unnest(range(1, 22)), unnest(list_append(list_transform(range(20), lambda x: 1), 2)),
            unnest(list_append(found, n_words - list_sum(found))), n_words, n_words >= 100
        FROM judged
    ), texts AS (
        SELECT min(doc_id) AS doc_id, lang FROM judged WHERE NOT base_failed GROUP BY lang, t
    ), steps AS MATERIALIZED (
        SELECT lang, doc_id, kind, k, g, n, total, round(n * 2000 / total::DOUBLE) AS step FROM texts JOIN bins USING (doc_id) WHERE enough
    ), medians AS (
        SELECT lang, kind, k, g, median(step) AS m, count(*) AS n FROM steps GROUP BY lang, kind, k, g
    ), whole AS (
        SELECT kind, k, g, m / sum(m) OVER () AS p FROM (SELECT kind, k, g, median(step) AS m FROM steps WHERE kind = 'chars' GROUP BY kind, k, g)
        UNION ALL
        SELECT 'words', k, CASE WHEN k < 21 THEN 1 ELSE 2 END, CASE WHEN k < 21 THEN c / 20 ELSE 1 - c END FROM (
            SELECT median(round(2000 - n * 2000 / total::DOUBLE)) / 2000 AS c FROM steps WHERE kind = 'words' AND k = 21), (SELECT unnest(range(1, 22)) AS k)
    ), shared AS (
        SELECT lang, kind, k, g, n / (n + 10.0::DOUBLE) AS weight, m / nullif(sum(m) OVER (PARTITION BY lang, kind), 0) AS x, p,
            sum(p) OVER (PARTITION BY lang, kind, g) AS pg
        FROM medians JOIN whole USING (kind, k, g)
    ), refs AS (
        SELECT lang, kind, k, (weight * xg + (1 - weight) * pg) * CASE WHEN xg > 0 THEN x / xg WHEN pg > 0 THEN p / pg ELSE 0 END AS q
        FROM (SELECT *, sum(x) OVER (PARTITION BY lang, kind, g) AS xg FROM shared) WHERE x IS NOT NULL
    ), distances AS (
        SELECT doc_id, kind, sqrt(greatest(sum(
            CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) / 2 ELSE 0 END), 0)) AS d
        FROM (SELECT doc_id, lang, kind, k, n / greatest(total, 1)::DOUBLE AS p FROM bins JOIN judged USING (doc_id) WHERE enough) s
        JOIN refs USING (kind, k) WHERE s.lang IS NOT DISTINCT FROM refs.lang
        GROUP BY doc_id, kind
    ), off AS (
        SELECT doc_id, bool_or(kind = 'chars' AND d > 0.3 OR kind = 'words' AND d > 0.27) AS off FROM distances GROUP BY doc_id
    )
    SELECT j.* EXCLUDE (lang, t, n_chars, chars, found), NOT base_failed AND NOT coalesce(off, false) AS kept FROM judged j LEFT JOIN off USING (doc_id)
    """.replace("@WORDS@", _words_sql())
)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules.score_quality(table(spark, sf_dir, "documents")).select("doc_id", *counts, "base_failed", "kept")


@query()
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query()
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"  # a conversation whose texts imitate the format
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, labels, fold("doc_id", 3) != 1)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    scored = knn_quality.score_quality(docs, labels, fold("doc_id", 5) != 0)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeated_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("has_repeats"), (F.col("n_removed") / F.greatest("n_bytes", F.lit(1))).alias("removed_share"),
    )


def _vector_codes_sql() -> str:
    """Six rounds and a final assignment, one after another."""
    assign = """
    near{i} AS MATERIALIZED (
        SELECT vec_id, p, part, e, gap FROM (
            SELECT vec_id, a.p, part, e,
                list_sum(list_transform(range(1, len(part) + 1), lambda k: (part[k] - entry[k]) * (part[k] - entry[k])))::BIGINT AS gap
            FROM parts a JOIN book{i} b ON a.p = b.p
        ) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY gap, e) = 1
    )"""
    renew = """
    book{j} AS MATERIALIZED (
        SELECT b.p, b.e, coalesce(fresh, entry) AS entry FROM book{i} b LEFT JOIN (
            SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY k)::BIGINT[] AS fresh FROM (
                SELECT p, e, k, sum(part[k])::BIGINT AS s, count(*) AS n
                FROM (SELECT p, e, part, unnest(range(1, len(part) + 1)) AS k FROM near{i}) GROUP BY p, e, k
            ) GROUP BY p, e
        ) f ON b.p = f.p AND b.e = f.e
    )"""
    rounds = vector_codes.ROUNDS
    steps = ",".join(assign.format(i=i) + "," + renew.format(i=i, j=i + 1) for i in range(rounds)) + "," + assign.format(i=rounds)
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), parts AS MATERIALIZED (
        SELECT vec_id, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS part FROM kept, (SELECT unnest(range(8)) AS p)
    ), book0 AS MATERIALIZED (
        SELECT p, row_number() OVER w - 1 AS e, part AS entry FROM parts
        WINDOW w AS (PARTITION BY p ORDER BY vec_id) QUALIFY row_number() OVER w <= 16
    ),{steps}, coded AS (
        SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(gap)::BIGINT AS error FROM near{rounds} GROUP BY vec_id
    ), digest AS (
        SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
    )
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
    FROM coded JOIN kept USING (vec_id), digest
    """


@query(_vector_codes_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    return vector_codes.label_errors(coded).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256")
    )


@query(
    r"""
    WITH docs AS MATERIALIZED (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), @UP@, @LOW@), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), items AS (
        SELECT coalesce(item_id::VARCHAR, '') AS item,
            regexp_extract_all(translate(coalesce(text, ''), @UP@, @LOW@), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark
    ), windows AS MATERIALIZED (
        SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS content
        FROM (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)
    ), places AS (
        SELECT doc_id, i, m, array_to_string(w[i + 1 : i + m], ' ') AS content
        FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM docs), (SELECT DISTINCT m FROM windows) WHERE i + m <= len(w)
    ), found AS MATERIALIZED (
        SELECT doc_id, i, m, item FROM places JOIN windows USING (m, content)
    ), hit AS (
        SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, i + unnest(range(m)) AS word FROM found) GROUP BY doc_id
    ), listed AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
    """.replace("@UP@", "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'").replace("@LOW@", "'abcdefghijklmnopqrstuvwxyz'")
)
def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, span: n + span["b"] - span["a"])
    return decontamination.scan_documents(docs, benchmark).select(
        "row.doc_id",
        "found.n_words",
        hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@query(
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
            SELECT lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents)
    ), f AS MATERIALIZED (
        SELECT lang, k, array_to_string(w[i + 1 : i + k], ' ') AS phrase, count(*) AS n
        FROM (SELECT lang, w, unnest(range(len(w))) AS i FROM pieces), (SELECT unnest(range(1, 5)) AS k)
        WHERE i + k <= len(w) GROUP BY ALL
    ), sizes AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
    ), candidates AS MATERIALIZED (
        SELECT lang, k AS size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= 30
    ), cuts AS (
        SELECT c.lang, c.phrase, c.a, cut, l.n AS l, r.n AS r, (2000000::HUGEINT * a // (l.n + r.n))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, size)) AS cut FROM candidates) c
        JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[:cut], ' ')
        JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1 :], ' ')
    ), best AS (
        SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
    ), covered AS (
        SELECT lang, phrase, max(a) AS longer FROM (
            SELECT lang, a, array_to_string(w[i + 1 : i + m], ' ') AS phrase
            FROM (SELECT *, unnest(range(size)) AS i FROM candidates), (SELECT unnest([2, 3]) AS m) WHERE m < size AND i + m <= size
        ) GROUP BY lang, phrase
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM best JOIN sizes USING (lang) LEFT JOIN covered USING (lang, phrase)
    WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
    QUALIFY rank <= 2000
    """
)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_collocations(table(spark, sf_dir, "documents"))
