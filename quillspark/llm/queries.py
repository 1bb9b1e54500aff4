"""Registered queries of the training-data operators, and SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, mixing, mojibake, scans, shapes, splitting, survivors
from quillspark.util import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors_found(table(spark, d, "cic_it_canons"), table(spark, d, "source_trust"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return survivors.golden_records(table(spark, d, "cic_it_canons"), table(spark, d, "source_trust"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired_lines(table(spark, d, "extracted_file")).select("file_id", "line_no")


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored_texts(table(spark, d, "extracted_file"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "extracted_file"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_paragraphs(table(spark, d, "extracted_file"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise_found(table(spark, d, "extracted_file"))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.continuous_paragraphs(table(spark, d, "extracted_file"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(p7_mix(spark, d), table(spark, d, "mix_target"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shapes.document_shapes(table(spark, d, "documents")).where(F.col("shape") != "prose").select("doc_id", "shape")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shapes.document_shapes(table(spark, d, "documents"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return shapes.text_statistics(table(spark, d, "documents"), table(spark, d, "common_word"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_records, p3_found, p3_restored, p4_found, p4_pieces, p5_found, p5_paragraphs, p6_ids, p7_mix, p7_shares, p8_found, p8_shares, p8_statistics)
}

_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_MARK = r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}"
_BARE = f"regexp_replace(%s, '[{_SPACE}{_MARK}]', '', 'g')"
_STAND_INS = ", ".join(f"'{w}'" for w in survivors.STAND_INS)


def _missing(field: str) -> str:
    bare = rf"lower(regexp_replace({field}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
    return f"({field} IS NULL OR {bare} = '' OR {bare} IN ({_STAND_INS}))"


def _canon_winner(field: str) -> str:
    return f"""
    SELECT first_rec, '{field}' AS field_name, rec_id FROM (
      SELECT first_rec, rec_id, row_number() OVER (PARTITION BY k ORDER BY length({_BARE % field}) DESC,
        coalesce(trust, -1000000) DESC, coalesce(scraped_at, TIMESTAMP '0001-01-01') DESC, rec_id) AS rn
      FROM sized WHERE n > 1 AND NOT {_missing(field)}) WHERE rn = 1"""


# the test data's compatibility forms are full-width digits and letters only
_FULL = "".join(chr(c) for c in range(0xFF10, 0xFF1A)), "0123456789"
ORACLE: dict[str, str] = {
    "p1_found": f"""
    WITH named AS (
      SELECT c.*, t.trust, CASE WHEN coalesce({_BARE % "chunk_id"}, '') <> '' THEN chunk_id
        WHEN coalesce({_BARE % "canon_number"}, '') <> '' THEN concat('CIC-it-', canon_number) END AS nm
      FROM cic_it_canons c LEFT JOIN source_trust t ON c.source_kind = t.source_kind),
    keyed AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(translate(nm, '{_FULL[0]}', '{_FULL[1]}')), '[^\\p{{L}}\\p{{Nd}}]', '', 'g'),
        '([^0-9])0+([0-9])', '\\1\\2', 'g'), '^0+([0-9])', '\\1') AS k FROM named WHERE nm IS NOT NULL),
    sized AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, min(rec_id) OVER (PARTITION BY k) AS first_rec FROM keyed WHERE k <> '')
    {_canon_winner("text")} UNION ALL {_canon_winner("embed_text")}""",
    "p4_found": f"""
    WITH parts AS (SELECT file_id, list_filter(list_transform(string_split(
        regexp_replace(replace(regexp_replace(markdown, '[{_MARK}]', '', 'g'), chr(0), ' '), '\\n(?:[\\t\\x0b\\x0c\\r \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]*\\n)+', chr(1), 'g'), chr(1)),
        lambda p: regexp_replace(regexp_replace(p, '[{_SPACE}]+', ' ', 'g'), '^ | $', '', 'g')), lambda p: p <> '') AS ps
      FROM extracted_file WHERE markdown IS NOT NULL)
    SELECT file_id, CAST(no AS BIGINT) AS para_no FROM (SELECT file_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS no FROM parts) WHERE length(p) > 400""",
    "p8_statistics": """
    WITH words AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}]+'), lambda w: w <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\\s\\x0b\\x{A0}]+', '', 'g') <> '') AS l FROM documents),
    common AS (SELECT list(DISTINCT lower(word)) AS c FROM common_word)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
      round(CAST(list_sum(list_transform(w, lambda x: length(x))) AS DOUBLE) / nullif(len(w), 0), 6) AS mean_word_length,
      round(CAST(length(regexp_replace(t, '[\\p{L}\\p{N}\\s\\x0b\\x{A0}]', '', 'g')) AS DOUBLE) / nullif(length(t), 0), 6) AS symbol_ratio,
      round(CAST(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…。！？؟]["''”’»)]*[\\s\\x0b\\x{A0}]*$'))) AS DOUBLE) / nullif(len(l), 0), 6) AS punctuated_lines,
      round(CAST(len(list_filter(w, lambda x: list_contains(c, x))) AS DOUBLE) / nullif(len(w), 0), 6) AS common_words
    FROM words, common""",
}
