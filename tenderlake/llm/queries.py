"""The registered queries of this sub-package and, where SQL can express them, their DuckDB SQL.

Each query applies its operator with production parameters to the whole table and derives the
digest columns that its contract names from the operator's own output.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm import (byte_bpe, exact_dedup, improbable_digest, jaccard_join, mixing, pii, quality_nbsvm,
                            repair_shards, repetition_rules, spelling, substring_dedup, token_alignment, warc_derive)
from tenderlake.llm.common import documents
from tenderlake.session import checkpoint_dir
from tenderlake.sources.tables import read_table

LLM_QUERIES: dict = {}
LLM_ORACLE: dict[str, str] = {}


def llm_query(name: str, sql: str | None = None):
    def deco(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLE[name] = sql
        return fn
    return deco


_LOWER_SQL = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


@llm_query("op6_exact_dedup", f"""
    WITH d AS (SELECT doc_id, sha256({_LOWER_SQL}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), digest=True)


_MIX_SQL = f"""
    WITH RECURSIVE counted AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
             CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS INTEGER) AS draw
      FROM documents),
    sized AS (SELECT *, CASE WHEN size = 0 THEN -1 ELSE length(bin(size)) - 1 END AS class FROM counted),
    src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
            FROM sized GROUP BY source),
    tot AS (SELECT sum(source_size) AS t, sum(w) AS ws FROM src),
    fill AS (                                        -- sources by cap / weight: the first that fits sets the level
      SELECT s.*, t - coalesce(sum(3 * source_size) OVER b, 0) AS rest, ws - coalesce(sum(w) OVER b, 0) AS free
      FROM src s, tot
      WINDOW b AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (SELECT CAST(rest AS DOUBLE) AS rest, CAST(free AS DOUBLE) AS free FROM fill
              WHERE w * CAST(rest AS DOUBLE) / CAST(free AS DOUBLE) <= 3 * source_size
              ORDER BY 3.0 * source_size / w, source NULLS LAST LIMIT 1),
    goal AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), w * level.rest / level.free) AS target
             FROM src, level),
    part AS (SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS whole,
                    (target - floor(target / greatest(source_size, 1)) * source_size) / greatest(source_size, 1) AS f FROM goal),
    hist AS (SELECT source, class, draw, sum(size) AS words FROM sized WHERE class >= 0 GROUP BY source, class, draw),
    line AS (SELECT *, CAST(sum(words) OVER (PARTITION BY source, class ORDER BY draw) AS BIGINT) AS upto FROM hist),
    class AS (SELECT h.source, h.class, f, list(draw ORDER BY draw) AS bins, list(upto ORDER BY draw) AS uptos,
                     row_number() OVER (PARTITION BY h.source ORDER BY h.class DESC) AS k
              FROM line h JOIN part p ON h.source IS NOT DISTINCT FROM p.source GROUP BY h.source, h.class, f),
    fill_class AS (                                  -- long documents first; what a class leaves open goes on to the next
      SELECT source, CAST(0 AS BIGINT) AS k, -1 AS class, CAST(floor(f * 4096) AS BIGINT) AS cut, CAST(0 AS DOUBLE) AS gap FROM part
      UNION ALL
      SELECT source, k, class, CASE WHEN within = len(uptos) THEN 4096 ELSE bins[within + 1] + CAST(nearer AS BIGINT) END,
             open - CASE WHEN within = len(uptos) THEN uptos[-1] ELSE base + CASE WHEN nearer THEN over ELSE 0 END END
      FROM (SELECT *, base + over - want < want - base AS nearer FROM
        (SELECT *, uptos[within + 1] - base AS over FROM
          (SELECT *, CASE WHEN within = 0 THEN 0 ELSE uptos[within] END AS base FROM
            (SELECT *, len(list_filter(uptos, lambda u: u <= want)) AS within FROM
              (SELECT *, greatest(open, 0) AS want FROM
                (SELECT c.source, c.k, c.class, bins, uptos, s.gap + c.f * uptos[-1] AS open
                 FROM fill_class s JOIN class c ON s.source IS NOT DISTINCT FROM c.source AND c.k = s.k + 1))))))),
    gaps AS (SELECT source, arg_max(gap, k) AS gap FROM fill_class GROUP BY source),
    marked AS (SELECT d.*, d.draw < coalesce(c.cut, 0) AS inside, g.gap FROM sized d
               LEFT JOIN fill_class c ON d.source IS NOT DISTINCT FROM c.source AND d.class = c.class
               JOIN gaps g ON d.source IS NOT DISTINCT FROM g.source),
    near AS (SELECT source, arg_min(doc_id, (abs(size - abs(gap)), draw, doc_id)) AS closer
             FROM marked WHERE inside = (gap < 0) AND abs(size - abs(gap)) < abs(gap) GROUP BY source)
    SELECT m.doc_id, m.size, p.source_size, p.target,
           p.whole + CAST(inside <> (m.doc_id IS NOT DISTINCT FROM n.closer AND n.closer IS NOT NULL) AS BIGINT) AS repeats,
           m.size * (p.whole + CAST(inside <> (m.doc_id IS NOT DISTINCT FROM n.closer AND n.closer IS NOT NULL) AS BIGINT)) AS taken
    FROM marked m JOIN part p ON m.source IS NOT DISTINCT FROM p.source
    LEFT JOIN near n ON m.source IS NOT DISTINCT FROM n.source"""


@llm_query("op7_mix_sources", _MIX_SQL)
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


BYTE_BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@llm_query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(BYTE_BPE_RANKS)
    return (byte_bpe.encode(documents(spark, sf_dir), path, digests=True)
            .select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))


WORD_BPE = "word_bpe_49k.json"


@llm_query("op2_repair_shards")
def op2_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-repair-{uuid.uuid4().hex}"
    repair_shards.write_shards(documents(spark, sf_dir), tokenizer_path(WORD_BPE), path)
    return repair_shards.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@llm_query("op1_warc_derivatives")
def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return warc_derive.derive(warc_derive.responses_from_pages(pages), keep=("page_id",))


@llm_query("op5_quality_nbsvm")
def op5_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_nbsvm.train(docs, read_table(spark, sf_dir, "labels"))
    return (quality_nbsvm.score(docs, model)
            .select("doc_id", quality_nbsvm.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"))


@llm_query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (pii.find_pii(documents(spark, sf_dir))
            .select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans"))


@llm_query("op10_improbable_digest")
def op10_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return improbable_digest.compare_neighbours(documents(spark, sf_dir))


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


@llm_query("op4_substring_dedup", f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
            FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
    again AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE least < doc_id),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM again),
    word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
    kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (r)""")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (substring_dedup.remove_repeats(documents(spark, sf_dir))
            .select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


@llm_query("op9_jaccard_join", f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER_SQL)} AS w FROM documents),
    held AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s
             FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    size AS (SELECT r, count(*) AS n FROM held GROUP BY r),
    shared AS (SELECT a.r AS x, b.r AS y, count(*) AS n FROM held a JOIN held b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
    link AS (SELECT x, y FROM shared JOIN size a ON a.r = x JOIN size b ON b.r = y WHERE 100 * shared.n >= 80 * (a.n + b.n - shared.n)),
    edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
    reach(x, y) AS (SELECT r, r FROM d UNION SELECT reach.x, edge.y FROM reach JOIN edge ON edge.x = reach.y)
    SELECT any_value(d.doc_id) AS doc_id, CAST(coalesce(any_value(size.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
    FROM reach JOIN d ON d.r = reach.x JOIN d o ON o.r = reach.y LEFT JOIN size ON size.r = d.r GROUP BY reach.x""")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


BYTE_BPE_JSON, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


@llm_query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(documents(spark, sf_dir), tokenizer_path(BYTE_BPE_JSON), tokenizer_path(PIECE_BPE))


# CRC-32 bit by bit: the message's bits, lowest first, after the start value; runs hold code points below 256 only.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295], flatten(list_transform({bytes}, lambda b: [b & 1, (b >> 1) & 1, (b >> 2) & 1, (b >> 3) & 1,
                 (b >> 4) & 1, (b >> 5) & 1, (b >> 6) & 1, (b >> 7) & 1]))), lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1))), 4294967295)"""
_BYTES_SQL = """flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)]
                 ELSE [CAST(192 + (unicode(ch) >> 6) AS BIGINT), CAST(128 + (unicode(ch) & 63) AS BIGINT)] END))"""


@llm_query("op13_spelling_variants", f"""
    WITH RECURSIVE run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOWER_SQL}, '{spelling.RUN}')) AS w FROM documents),
    hashed AS (SELECT w, n, {_CRC_SQL.format(bytes=_BYTES_SQL.format(text="id || ':' || w"))} AS h
               FROM (SELECT id, w, count(*) AS n FROM run WHERE length(w) >= {spelling.MIN_LENGTH} GROUP BY id, w)),
    slipped AS (SELECT CASE WHEN h % {spelling.SLIP} = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n
                FROM hashed),
    words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= {spelling.MIN_LENGTH}
                           GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
    less AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS MATERIALIZED (
      SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
      UNION SELECT less.word, words.word FROM less JOIN words ON words.word = less.d
      UNION SELECT words.word, less.word FROM less JOIN words ON words.word = less.d),
    best AS (SELECT a, count(*) AS n_near, max(words.n) AS top FROM near JOIN words ON words.word = near.b GROUP BY a),
    named AS MATERIALIZED (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {spelling.RATIO} * w.n THEN top END AS form_n,
             CASE WHEN top >= {spelling.RATIO} * w.n THEN (SELECT min(near.b) FROM near JOIN words x ON x.word = near.b WHERE near.a = w.word AND x.n = top) END AS form
      FROM words w LEFT JOIN best ON best.a = w.word),
    path AS (SELECT word, word AS root, form AS next FROM named UNION ALL
             SELECT path.word, named.word, named.form FROM path JOIN named ON named.word = path.next)
    SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM named JOIN (SELECT word, root FROM path WHERE next IS NULL) USING (word)""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def _repeated_words(width: int) -> str:
    """For every row the words in runs of ``width`` words that the row holds twice or more."""
    return f"""SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {width})) AS p FROM (
                 SELECT r, i, count(*) OVER (PARTITION BY r, k) AS many FROM (
                   SELECT r, i, md5(array_to_string(w[i:i + {width - 1}], ' ')) AS k
                   FROM (SELECT r, w, unnest(range(1, len(w) - {width - 2})) AS i FROM d WHERE len(w) >= {width}))) WHERE many > 1) GROUP BY r"""


@llm_query("op11_repetition_rules", f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    line AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)
             WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
    three AS ({_repeated_words(repetition_rules.REPEAT_WORDS)}),
    cover AS ({_repeated_words(repetition_rules.LEAST)}),
    beyond AS ({_repeated_words(repetition_rules.MAX_LONGEST + 1)}),
    m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(line.n, 0) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(three.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_covered, beyond.n AS too_long
          FROM d LEFT JOIN line USING (r) LEFT JOIN three USING (r) LEFT JOIN cover USING (r) LEFT JOIN beyond USING (r))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_covered <= {repetition_rules.MAX_COVERED} * n_words AND too_long IS NULL AS kept,
           n_covered
    FROM m""")
def op11_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repetition_rules.judge(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered")
