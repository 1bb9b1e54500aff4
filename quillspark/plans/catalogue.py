"""The core's queries over the tables, each with its SQL twin where SQL can say the same.

``SURVEY`` identifiers in the comments name the operators that a query runs. Lists are joined by U+001F in results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import models
from quillspark.functions import quality as q
from quillspark.functions import text as t
from quillspark.operators import crawl, ledger, ocr, outline, records, retrieval, timestamps, vectors
from quillspark.sinks import office
from quillspark.sources import files
from quillspark.util import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SEP = "\x1f"
SITE = "אתר.?הזכויות"
S = t.SPACE


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{S}]+'), lambda w: w <> '')"


def _sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])[{S}]+([{t.SENTENCE_START}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"


_EMPTY = "{'done': []::VARCHAR[], 'now': ''}"


def _hard(x: str, most: int) -> str:
    fold = (
        f"list_reduce({_words(x)}, lambda a, w: CASE WHEN a.now = '' THEN {{'done': a.done, 'now': w}} WHEN length(a.now) + 1 + length(w) <= {most} "
        f"THEN {{'done': a.done, 'now': a.now || ' ' || w}} ELSE {{'done': list_append(a.done, a.now), 'now': w}} END, {_EMPTY})"
    )
    return f"CASE WHEN length({x}) <= {most} THEN [{x}] WHEN len({_words(x)}) = 0 THEN []::VARCHAR[] ELSE list_append(({fold}).done, ({fold}).now) END"


# ---- cleaning, sentences, chunks -------------------------------------------------------------------------------------


@query(f"SELECT file_id, md5(regexp_replace(regexp_replace(markdown, '[{t.MARKS}]', '', 'g'), '[{t.OCR_MATTER}]', '', 'g')) AS clean FROM extracted_file")
def clean_text(spark, d):  # T1 T2
    return table(spark, d, "extracted_file").select("file_id", F.md5(t.strip_ocr_matter(t.strip_marks(F.col("markdown"))).cast("binary")).alias("clean"))


@query(f"SELECT doc_id, CAST(no AS BIGINT) AS no, sentence FROM (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS no FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents WHERE text IS NOT NULL))")
def sentence_split(spark, d):  # T4
    return table(spark, d, "documents").select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("at", "sentence")).select("doc_id", (F.col("at") + 1).cast("bigint").alias("no"), "sentence")


@query(f"SELECT doc_id, CAST(no AS BIGINT) AS no, piece FROM (SELECT doc_id, unnest(s) AS piece, generate_subscripts(s, 1) AS no FROM (SELECT doc_id, {_hard('text', 120)} AS s FROM documents WHERE text IS NOT NULL))")
def hard_split(spark, d):  # T5
    return table(spark, d, "documents").select("doc_id", F.posexplode(t.hard_split(F.col("text"), 120)).alias("at", "piece")).select("doc_id", (F.col("at") + 1).cast("bigint").alias("no"), "piece")


_CHUNKS = f"""
    WITH cleaned AS (SELECT doc_id, lang, regexp_replace(regexp_replace(text, '[{t.MARKS}]', '', 'g'), '[{t.OCR_MATTER}]', '', 'g') AS x FROM documents WHERE text IS NOT NULL),
    paras AS (SELECT doc_id, lang, list_filter(list_transform(string_split(x, chr(10) || chr(10)), lambda p: {_strip('p')}), lambda p: p <> '') AS ps FROM cleaned),
    units AS (SELECT doc_id, lang, flatten(list_transform(ps, lambda p: CASE WHEN length(p) <= 400 THEN [p] ELSE {_sentences('p')} END)) AS us FROM paras),
    pieces AS (SELECT doc_id, lang, flatten(list_transform(us, lambda u: {_hard('u', 400)})) AS ps FROM units),
    packed AS (SELECT doc_id, lang, list_reduce(ps, lambda a, p: CASE WHEN a.now <> '' AND length(a.now) + length(p) > 400
        THEN {{'done': list_append(a.done, {_strip('a.now')}), 'now': p || ' '}} ELSE {{'done': a.done, 'now': a.now || p || ' '}} END, {_EMPTY}) AS r FROM pieces WHERE len(ps) > 0),
    chunked AS (SELECT doc_id, lang, list_append(r.done, {_strip('r.now')}) AS c FROM packed),
    chunks AS (SELECT doc_id, lang, unnest(c) AS chunk, CAST(generate_subscripts(c, 1) - 1 AS BIGINT) AS chunk_idx FROM chunked)"""


def _chunked(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", t.strip_ocr_matter(t.strip_marks(F.col("text"))).alias("x"))
    return docs.select("doc_id", "lang", F.posexplode(t.chunks(F.col("x"))).alias("at", "chunk")).withColumn("chunk_idx", F.col("at").cast("bigint")).drop("at")


@query(_CHUNKS + " SELECT doc_id, chunk_idx, chunk FROM chunks")
def chunk_documents(spark, d):  # T6 D5
    return _chunked(spark, d).select("doc_id", "chunk_idx", "chunk")


@query(_CHUNKS + " SELECT coalesce(lang, '?') AS language, CAST(count(*) AS BIGINT) AS n_chunks, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, round(avg(length(chunk)), 3) AS mean_chars FROM chunks GROUP BY 1")
def chunk_stats(spark, d):  # T6 A6
    return _chunked(spark, d).groupBy(F.coalesce("lang", F.lit("?")).alias("language")).agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg(F.length("chunk")), 3).alias("mean_chars"))


@query(r"SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_replace(x, '^[%s]+', '') <> '' THEN chr(8207) || x ELSE x END), chr(10)) AS anchored FROM documents" % S)
def anchor_lines(spark, d):  # T11
    return table(spark, d, "documents").select("doc_id", t.anchor_lines(F.col("text")).alias("anchored"))


# ---- quality gates ---------------------------------------------------------------------------------------------------

_LOOPED = "CASE WHEN doc_id % 7 = 0 THEN text || repeat(' abc1 abc2 abc3', 12) ELSE text END"


@query(f"""
    WITH x AS (SELECT doc_id, {_LOOPED} AS t FROM documents), w AS (SELECT doc_id, {_words('t')} AS w, list_transform(list_filter(string_split_regex(t, '[\\s\\x0b.\\x{{A0}}]+'), lambda s: length(s) >= 3), lambda s: left(s, 3)) AS h FROM x),
    r AS (SELECT doc_id, w, CASE WHEN len(h) = 0 THEN 1 ELSE (list_reduce(h, lambda a, s: {{'head': s, 'run': CASE WHEN a.head = s THEN a.run + 1 ELSE 1 END,
        'best': greatest(a.best, CASE WHEN a.head = s THEN a.run + 1 ELSE 1 END)}}, {{'head': '', 'run': 0, 'best': 1}})).best END AS best FROM w)
    SELECT doc_id, CASE WHEN w IS NULL THEN NULL ELSE round(len(list_distinct(w)) / nullif(len(w), 0), 6) END AS unique_ratio, CASE WHEN w IS NULL THEN NULL ELSE CAST(best AS INTEGER) END AS longest_run,
      coalesce(len(w) >= 40 AND (len(list_distinct(w)) / len(w) < 0.3 OR best >= 5), false) AS degenerate FROM r""")
def degenerate_flags(spark, d):  # T7 A8 A9 W2
    x = table(spark, d, "documents").select("doc_id", F.expr(_LOOPED).alias("x"))
    w = x.select("doc_id", t.words(F.col("x")).alias("w"), q.prefix_run(F.col("x")).alias("longest_run"))
    w = w.select("doc_id", "w", "longest_run", F.size(F.array_distinct("w")).alias("different"))  # split once: each of these is used by what follows
    ratio = F.col("different") / F.nullif(F.size("w"), F.lit(0))
    return w.select("doc_id", F.round(F.when(F.col("w").isNotNull(), ratio), 6).alias("unique_ratio"), "longest_run", q.is_degenerate(F.col("doc_id"), F.col("w"), F.col("longest_run")).alias("degenerate"))


def _ratio(block: str) -> str:
    letters = r"regexp_replace(x, '[^\p{L}]', '', 'g')"
    return f"length(regexp_replace({letters}, '[^{block}]', '', 'g')) / nullif(length({letters}), 0)"


@query(rf"SELECT file_id, round({_ratio(r'\x{0590}-\x{05FF}')}, 6) AS hebrew_ratio, coalesce({_ratio(r'\x{0590}-\x{06FF}')} >= 0.3, false) AS rtl FROM (SELECT file_id, markdown AS x FROM extracted_file)")
def script_profile(spark, d):  # P4 T10
    return table(spark, d, "extracted_file").select("file_id", F.round(q.hebrew_ratio(F.col("markdown")), 6).alias("hebrew_ratio"), q.is_rtl(F.col("markdown")).alias("rtl"))


@query(f"""
    WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda w: w <> '')) AS word FROM documents),
    n AS (SELECT doc_id, lang, count(*) AS n FROM w JOIN common_word USING (word) GROUP BY 1, 2)
    SELECT doc_id, lang AS detected, CAST(n AS BIGINT) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS r FROM n) WHERE r = 1""")
def detect_language(spark, d):  # T9
    return _detected(table(spark, d, "documents"), table(spark, d, "common_word"), "doc_id", "text")


def _detected(docs, common, key, text):
    """Language by frequent words: a document's own words are counted first, the small list is broadcast."""
    words = docs.select(key, F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")).alias("word"))
    counted = words.join(F.broadcast(common.select("word", F.col("lang").alias("__lang"))), "word").groupBy(key, "__lang").agg(F.count("*").alias("n"))
    best = counted.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "__lang")).alias("b"))
    return best.select(key, F.col("b.__lang").alias("detected"), (-F.col("b.m")).alias("hits"))


@query(f"""
    WITH w AS (SELECT file_id, unnest(list_filter(string_split_regex(lower(markdown), '[^\\p{{L}}]+'), lambda w: w <> '')) AS word FROM extracted_file),
    n AS (SELECT file_id, lang, count(*) AS n FROM w JOIN common_word USING (word) GROUP BY 1, 2),
    best AS (SELECT file_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, lang) AS r FROM n) WHERE r = 1)
    SELECT f.file_id, coalesce(len({_words('markdown')}) >= 6 AND NOT coalesce(b.lang = f.detected_lang OR (f.detected_lang = 'he' AND b.lang IN ('he', 'yi')) OR (f.detected_lang = 'ar' AND b.lang IN ('ar', 'fa', 'ur', 'ps')), false), false) AS wrong
    FROM extracted_file f LEFT JOIN best b ON f.file_id = b.file_id""")
def wrong_language(spark, d):  # T8 J4
    files = table(spark, d, "extracted_file")
    found = _detected(files, table(spark, d, "common_word"), "file_id", "markdown")
    return files.join(found, "file_id", "left").select("file_id", q.wrong_language(F.col("markdown"), F.col("detected"), F.col("detected_lang")).alias("wrong"))


_SUFFIX = r"lower(regexp_extract(path, '[^./]*(\.[^./]+)$', 1))"


@query(rf"""SELECT file_id, CASE WHEN coalesce(hebrew_ocr_used, false) THEN true WHEN {_SUFFIX} NOT IN ('.pdf', '.png', '.jpg', '.jpeg', '.tif', '.tiff', '.bmp') THEN false
      WHEN {_ratio(r'\x{0590}-\x{05FF}')} >= 0.15 THEN true ELSE coalesce(detected_lang = 'he', false) END AS hebrew,
      coalesce(length(x) >= 200 AND {_ratio(r'\x{0590}-\x{05FF}')} IS NOT NULL, false) AS native_text FROM (SELECT *, markdown AS x FROM extracted_file)""")
def hebrew_resolve(spark, d):  # P1 P3 S3 P5
    f = table(spark, d, "extracted_file")
    return f.select("file_id", q.resolve_hebrew(F.col("hebrew_ocr_used"), t.suffix_of(F.col("path")), q.hebrew_ratio(F.col("markdown")), F.col("detected_lang") == "he").alias("hebrew"), q.native_text_serves(F.col("markdown"), F.lit(False)).alias("native_text"))


@query("SELECT file_id, path, CAST(row_number() OVER (ORDER BY path NULLS FIRST, file_id) - 1 AS BIGINT) AS place FROM extracted_file")
def files_in_order(spark, d):  # O1
    return files.in_order(table(spark, d, "extracted_file").select("file_id", "path"), "path", "file_id")


@query(rf"""SELECT path, CASE WHEN path IS NULL THEN 'Please upload a ZIP or PDF file first.' WHEN s = '.zip' THEN 'That file doesn''t look like a valid ZIP archive.' WHEN s <> '.pdf' THEN concat('Unsupported file type ', chr(39), s, chr(39), '. Upload a .zip or a .pdf.') END AS message
    FROM (SELECT path, coalesce({_SUFFIX}, '') AS s FROM extracted_file)""")
def batch_status(spark, d):  # P23
    return files.batch_status(table(spark, d, "extracted_file").select("path", F.col("markdown").cast("binary").alias("content")))


@query(rf"""SELECT file_id, CASE WHEN s IN ('.png', '.jpg', '.jpeg', '.gif', '.bmp', '.tif', '.tiff', '.webp') THEN 'image' WHEN s = '.pdf' THEN CASE WHEN length_ > 20971520 THEN 'too_large' ELSE 'inline' END
      WHEN trim(coalesce(markdown, '')) = '' THEN 'placeholder' ELSE 'text' END AS route FROM (SELECT file_id, markdown, "length" AS length_, {_SUFFIX} AS s FROM extracted_file)""")
def preview_route(spark, d):  # P2
    return table(spark, d, "extracted_file").select("file_id", q.preview_route(t.suffix_of(F.col("path")), F.col("length"), F.col("markdown")).alias("route"))


# ---- answers ---------------------------------------------------------------------------------------------------------


@query(f"""
    WITH a AS (SELECT conv_id, turn, content, {_strip("regexp_replace(content, '(?is)<think>.*?</think>', '', 'g')")} AS c FROM chat_turn),
    b AS (SELECT *, {_strip("regexp_replace(c, '(?is)<think>.*', '', 'g')")} AS u FROM a)
    SELECT conv_id, turn, CASE WHEN NOT contains(lower(c), '<think>') THEN c WHEN u = '' THEN '_(The model ran out of space while reasoning and never reached an answer. Try a shorter question or a smaller attached document.)_' ELSE u END AS answer FROM b""")
def strip_thinking(spark, d):  # T12
    return table(spark, d, "chat_turn").select("conv_id", "turn", t.strip_thinking(F.col("content")).alias("answer"))


# Fixed value: how citations read, written out here so that the SQL doesn't share the code's constant.
_CITES = r"(?i)(סעיף\s*\d+|תקנה\s*\d+|חוק\s+\S+|פסק\s*דין|בג\"?ץ|ע\"?א\s*\d+|\bsection\s+\d+|\bregulation\s+\d+|\barticle\s+\d+|\blaw\s*(\(|,)?\s*(19|20|5[6-9])\d{2}\b|\bhcj\b|\bbasic\s+law\b)"


@query(f"""
    WITH p AS (SELECT conv_id, turn, sent_at, role, content, list_filter(list_transform(string_split_regex(regexp_replace(content, '([.!?])[{S}]+', '\\1' || chr(10), 'g'), '\\n+'),
      lambda s: regexp_replace(s, '^[ \\-•\\t\\n]+|[ \\-•\\t\\n]+$', '', 'g')), lambda s: s <> '' AND regexp_matches(s, '{_CITES}')) AS c FROM chat_turn)
    SELECT conv_id, turn, CASE WHEN content IS NULL THEN NULL ELSE array_to_string(list_filter(c, lambda s, i: list_position(c, s) = i), chr(31)) END AS cited, CASE WHEN content IS NULL THEN NULL ELSE len(c) = 0 END AS uncited FROM p""")
def extract_citations(spark, d):  # T14 T15 U3 P17 D20
    c = t.citations(F.col("content"))
    return table(spark, d, "chat_turn").select("conv_id", "turn", F.array_join(c, SEP).alias("cited"), (F.length(t.warn_uncited(F.col("content"))) > F.length("content")).alias("uncited"))


_ASKED = "CASE WHEN turn % 3 = 0 THEN concat('please make me a slide deck about ', coalesce(content, '')) WHEN turn % 3 = 1 THEN concat('my presentation tomorrow: ', coalesce(content, '')) ELSE content END"


@query(rf"SELECT conv_id, turn, regexp_matches(coalesce(x, ''), '(?i)\b(power ?point|pptx|slide ?deck|slides?|presentation)\b') AND regexp_matches(coalesce(x, ''), '(?i)\b(make|create|generate|build|write|prepare|put together|draft|produce)\b') AS slides FROM (SELECT conv_id, turn, {_ASKED} AS x FROM chat_turn)")
def pptx_intent(spark, d):  # P16
    return table(spark, d, "chat_turn").select("conv_id", "turn", t.asks_for_slides(F.expr(_ASKED)).alias("slides"))


@query("SELECT turn % 4 AS kind, CAST(greatest(coalesce(nullif(CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 4096 ELSE 16384 END, 0), 8192), 2048 * (turn % 4 + 1) + 2048) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS n FROM chat_turn GROUP BY ALL")
def num_ctx(spark, d):  # P20
    turns = table(spark, d, "chat_turn").select((F.col("turn") % 4).alias("kind"), F.expr("CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 4096 ELSE 16384 END").alias("wanted"), (2048 * (F.col("turn") % 4 + 1)).alias("predict"))
    return turns.groupBy("kind", t.window_tokens(F.col("wanted"), F.col("predict")).cast("bigint").alias("tokens")).agg(F.count("*").alias("n"))


@query("""
    WITH q AS (SELECT conv_id, min(coalesce(content, '')) AS a FROM chat_turn GROUP BY 1), x AS (SELECT conv_id, CASE WHEN length(a) > 6000 THEN left(a, 6000) || chr(10) || '[...truncated, file is longer...]' ELSE a END AS docs FROM q)
    SELECT conv_id, part, turn, role, content FROM (
      SELECT conv_id, 1 AS part, turn, role, content FROM chat_turn WHERE content IS NOT NULL UNION ALL
      SELECT conv_id, 0, 0, 'system', 'Answer from the documents.' FROM x UNION ALL
      SELECT conv_id, 2, 0, 'user', CASE WHEN docs <> '' THEN 'The user attached the following document(s):' || chr(10) || chr(10) || docs || chr(10) || chr(10) || 'User question: What follows?' ELSE 'What follows?' END FROM x)""")
def chat_messages(spark, d):  # U4 P15 T22 L3 D12
    turns = table(spark, d, "chat_turn")
    asked = turns.groupBy("conv_id").agg(F.min(F.coalesce("content", F.lit(""))).alias("a"))
    asked = asked.select("conv_id", retrieval.user_message(F.lit("What follows?"), t.truncate(F.col("a"), retrieval.MOST_CONTEXT, retrieval.CUT_MARK)).alias("content"))
    return retrieval.messages(turns, asked, "Answer from the documents.")


@query("SELECT conv_id, turn, coalesce(json_extract_string('{\"detail\": ' || to_json(content) || '}', '$.detail'), '') AS detail, 'Summarize this in 3-5 bullet points:' || chr(10) || chr(10) || content AS prompt FROM chat_turn")
def error_and_summary(spark, d):  # N4 T29
    turns = table(spark, d, "chat_turn")
    body = F.to_json(F.struct(F.col("content").alias("detail")))
    detail = F.coalesce(F.get_json_object(body, "$.detail"), F.when(F.col("content").isNotNull(), body), F.lit(""))
    return turns.select("conv_id", "turn", detail.alias("detail"), retrieval.summary_prompt(F.col("content"), F.lit("Italian"))["user"].alias("prompt"))


# ---- canons, retrieval -----------------------------------------------------------------------------------------------

_ID = "coalesce(nullif(chunk_id, ''), concat('CIC-it-', coalesce(canon_number, 'None')))"
_EMBED = "coalesce(nullif(embed_text, ''), text, '')"


@query(f"""SELECT key, rec_id, CAST(first_seen AS BIGINT) AS first_seen, CAST(n_records AS BIGINT) AS n_records, CAST(length(e) AS BIGINT) AS size FROM (
      SELECT {_ID} AS key, rec_id, {_EMBED} AS e, min(rec_id) OVER (PARTITION BY {_ID}) AS first_seen, count(*) OVER (PARTITION BY {_ID}) AS n_records,
        row_number() OVER (PARTITION BY {_ID} ORDER BY length({_EMBED}) DESC, rec_id) AS r FROM cic_it_canons) WHERE r = 1""")
def dedupe_longest(spark, d):  # A3 W1 P11 P12
    rows = table(spark, d, "cic_it_canons").withColumn("e", records.text_to_embed())
    return records.keep_longest(rows, records.canon_id(), F.length("e"), "rec_id").select("key", "rec_id", "first_seen", "n_records", F.length("e").cast("bigint").alias("size"))


_META = ", ".join(f"coalesce({c}, '')" for c in records.CANON_METADATA)


@query(f"SELECT rec_id, {_ID} AS id, concat_ws('|', {_META}) AS metadata, 'search_document: ' || {_EMBED} AS to_embed, text AS document FROM cic_it_canons WHERE {_EMBED} <> ''")
def vector_records(spark, d):  # P10 P11 P12 T19 D10
    rows = records.sanitise(table(spark, d, "cic_it_canons").withColumns({"id": records.canon_id(), "e": records.text_to_embed()}).where("e <> ''"))
    return rows.select("rec_id", "id", F.concat_ws("|", *records.CANON_METADATA).alias("metadata"), F.concat(F.lit("search_document: "), "e").alias("to_embed"), F.col("text").alias("document"))


@query(f"""SELECT key, source_url FROM (SELECT {_ID} AS key, source_url, row_number() OVER (PARTITION BY {_ID} ORDER BY CASE WHEN rec_id % 2 = 0 THEN 0 ELSE 1 END, rec_id DESC) AS r FROM cic_it_canons) WHERE r = 1""")
def vector_upsert(spark, d):  # K1
    rows = table(spark, d, "cic_it_canons").select(records.canon_id().alias("key"), "rec_id", "source_url")
    old, new = rows.where("rec_id % 2 = 1"), rows.where("rec_id % 2 = 0")
    return records.upsert(records.keep_one(old, "key"), new, "key").select("key", "source_url")


_KNN = """
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    far AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_distance(q.v, e.v), 9) AS distance FROM e q, e WHERE q.vec_id % 20 = 0),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM far)"""


@query(_KNN + " SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 4) + 0.0 AS distance FROM best WHERE rank <= 5")
def knn_topk(spark, d):  # J5 L1 D11
    e = table(spark, d, "embeddings")
    return vectors.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding").withColumn("distance", F.round("distance", 4) + 0.0)


@query(_KNN + """, hit AS (SELECT b.query_id, b.rank, c.* FROM best b JOIN cic_it_canons c ON c.rec_id = b.id + 1 WHERE b.rank <= 5)
    SELECT query_id, string_agg('[Can. ' || coalesce(canon_number, '?') || '] (' || coalesce(hierarchy_path, '') || ')' || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context,
      string_agg('- **Can. ' || coalesce(canon_number, '?') || '** — ' || coalesce(hierarchy_path, '') || CASE WHEN coalesce(source_url, '') <> '' THEN '  ' || chr(10) || '  [' || source_url || '](' || source_url || ')' ELSE '' END
        || CASE WHEN coalesce(in_force_note, '') <> '' THEN '  ' || chr(10) || '  ⚠️ ' || in_force_note ELSE '' END, chr(10) || chr(10) ORDER BY rank) AS panel FROM hit GROUP BY 1""")
def rag_context(spark, d):  # L1 T20 K9 J2
    e = table(spark, d, "embeddings")
    hits = vectors.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding")
    canons = table(spark, d, "cic_it_canons")
    return retrieval.context(hits.join(canons, hits["id"] + 1 == canons["rec_id"]).drop("id"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, count(*) > 0 AS ready FROM embeddings")
def collection_health(spark, d):  # S8 S9 A11
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"), (F.count("*") > 0).alias("ready"))


# ---- recognised words ------------------------------------------------------------------------------------------------


@query(f"""
    WITH l AS (SELECT file_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS ln FROM extracted_file WHERE markdown IS NOT NULL),
    w AS (SELECT file_id, ln, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) - 1 AS pos FROM l),
    k AS (SELECT file_id, ln // 5 AS b, (ln // 2) % 2 AS p, ln, pos, regexp_replace(word, '^[\\s\\x0b\\x{{A0}}]+|[\\s\\x0b\\x{{A0}}]+$', '', 'g') AS word, (pos * 37 + file_id) % 100 AS conf FROM w),
    g AS (SELECT * FROM k WHERE word <> '' AND conf >= 40 AND pos % 11 <> 10),
    li AS (SELECT file_id, b, p, ln, string_agg(word, ' ' ORDER BY pos) AS t FROM g GROUP BY ALL), pa AS (SELECT file_id, b, p, string_agg(t, chr(10) ORDER BY ln) AS t FROM li GROUP BY ALL)
    SELECT file_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY b, p)) AS text FROM pa GROUP BY 1""")
def ocr_regroup(spark, d):  # A1 P6 O2 D4
    lines = table(spark, d, "extracted_file").select("file_id", F.posexplode(F.split("markdown", "\n")).alias("ln", "line"))
    words = lines.select("file_id", "ln", F.posexplode(F.split("line", " ")).alias("pos", "text"))
    conf = F.when(F.col("pos") % 11 == 10, F.lit("bad")).otherwise(((F.col("pos") * 37 + F.col("file_id")) % 100).cast("string"))
    placed = words.select("file_id", F.floor(F.col("ln") / 5).alias("block_num"), (F.floor(F.col("ln") / 2) % 2).alias("par_num"), F.col("ln").alias("line_num"), "pos", "text", conf.alias("conf"))
    return ocr.regroup(placed, ["file_id"]).select("file_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query("SELECT conv_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY turn, content)) AS text FROM (SELECT DISTINCT conv_id, turn, content FROM chat_turn WHERE coalesce(content, '') <> '') GROUP BY 1")
def page_concat(spark, d):  # A2 A10 D3
    pages = table(spark, d, "chat_turn").select("conv_id", "turn", "content").distinct()
    return ocr.join_pages(pages, "conv_id", "turn", "content").select("conv_id", F.md5(F.col("text").cast("binary")).alias("text"))


# ---- ledger ----------------------------------------------------------------------------------------------------------

_RAW = f"CASE WHEN starts_with({_strip('raw')}, '```') THEN {_strip(f"regexp_replace(regexp_replace({_strip('raw')}, '^```[a-zA-Z]*\\n?', ''), '```[{S}]*$', '')")} ELSE {_strip('raw')} END"
_LEDGER = f"""
    WITH r AS (SELECT invoice_id, filename, {_RAW} AS x FROM invoice_json), j AS (SELECT invoice_id, filename, CASE WHEN json_valid(x) AND json_type(x) = 'OBJECT' THEN x END AS x FROM r),
    l AS (SELECT invoice_id, filename, CASE WHEN json_extract_string(x, '$.document_type') IN ('sales', 'expense', 'unrecognized') THEN json_extract_string(x, '$.document_type') ELSE 'unrecognized' END AS document_type,
      coalesce(json_extract_string(x, '$.party_name'), '') AS party_name, coalesce(json_extract_string(x, '$.invoice_number'), '') AS invoice_number, coalesce(json_extract_string(x, '$.date'), '') AS date,
      coalesce(json_extract_string(x, '$.currency'), '') AS currency,
      CASE WHEN json_type(x, '$.amount') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN CAST(json_extract_string(x, '$.amount') AS DOUBLE) WHEN json_type(x, '$.amount') = 'BOOLEAN' THEN CASE WHEN json_extract_string(x, '$.amount') = 'true' THEN 1 ELSE 0 END END AS amount,
      CASE WHEN json_type(x, '$.vat') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN CAST(json_extract_string(x, '$.vat') AS DOUBLE) WHEN json_type(x, '$.vat') = 'BOOLEAN' THEN CASE WHEN json_extract_string(x, '$.vat') = 'true' THEN 1 ELSE 0 END END AS vat FROM j)"""


def _ledger(spark, d):
    return ledger.decode(table(spark, d, "invoice_json"))


@query(_LEDGER + " SELECT CASE document_type WHEN 'sales' THEN 'Sales' WHEN 'expense' THEN 'Expenses' ELSE 'Unrecognized' END AS sheet, invoice_id, date, invoice_number, party_name, amount, vat, currency, filename FROM l")
def ledger_rows(spark, d):  # N3 S20 P13 P14 D13 D14 K5 T13
    return ledger.ledger_rows(_ledger(spark, d))


@query(_LEDGER + " SELECT document_type, CAST(count(*) AS BIGINT) AS n, round(coalesce(sum(amount), 0), 2) AS amount, round(coalesce(sum(vat), 0), 2) AS vat FROM l GROUP BY 1")
def ledger_totals(spark, d):  # A4 A5
    return ledger.totals(_ledger(spark, d), "document_type")


@query(_LEDGER + " SELECT document_type, currency, CAST(count(*) AS BIGINT) AS n, round(coalesce(sum(amount), 0), 2) AS amount, round(coalesce(sum(vat), 0), 2) AS vat FROM l GROUP BY 1, 2")
def ledger_by_currency(spark, d):  # A5, currencies apart
    return ledger.totals(_ledger(spark, d), "document_type", "currency")


@query(_LEDGER + """, s AS (SELECT document_type, count(*) AS n, round(coalesce(sum(amount), 0), 2) AS amount, round(coalesce(sum(vat), 0), 2) AS vat FROM l GROUP BY 1),
    o AS (SELECT sum(n) AS n, coalesce(sum(n) FILTER (document_type = 'sales'), 0) AS sn, coalesce(sum(n) FILTER (document_type = 'expense'), 0) AS en, coalesce(sum(n) FILTER (document_type = 'unrecognized'), 0) AS un,
      coalesce(sum(amount) FILTER (document_type = 'sales'), 0) AS sa, coalesce(sum(vat) FILTER (document_type = 'sales'), 0) AS sv, coalesce(sum(amount) FILTER (document_type = 'expense'), 0) AS ea, coalesce(sum(vat) FILTER (document_type = 'expense'), 0) AS ev FROM s)
    SELECT format('Processed {} page(s)/file(s): {} sales, {} expenses, {} unrecognized.', n, sn, en, un) || chr(10) || format('Total sales: {:.2f} (VAT: {:.2f}) | Total expenses: {:.2f} (VAT: {:.2f})', sa, sv, ea, ev) AS summary FROM o""")
def batch_summary(spark, d):  # T28
    return ledger.summary_line(ledger.totals(_ledger(spark, d), "document_type"))


@query(_LEDGER + """, s AS (SELECT coalesce(filename, '') AS n FROM l WHERE document_type = 'unrecognized'), o AS (SELECT count(*) AS n, count(*) FILTER (document_type = 'sales') AS sn, count(*) FILTER (document_type = 'expense') AS en, count(*) FILTER (document_type = 'unrecognized') AS un,
      round(coalesce(sum(amount) FILTER (document_type = 'sales'), 0), 2) AS sa, round(coalesce(sum(vat) FILTER (document_type = 'sales'), 0), 2) AS sv, round(coalesce(sum(amount) FILTER (document_type = 'expense'), 0), 2) AS ea, round(coalesce(sum(vat) FILTER (document_type = 'expense'), 0), 2) AS ev FROM l)
    SELECT 0 AS part, '' AS place, format('Processed {} page(s)/file(s): {} sales, {} expenses, {} unrecognized.', n, sn, en, un) || chr(10) || format('Total sales: {:.2f} (VAT: {:.2f}) | Total expenses: {:.2f} (VAT: {:.2f})', sa, sv, ea, ev) AS line FROM o
    UNION ALL SELECT 1, '', chr(10) || 'Not recognized (check these manually):' FROM o WHERE un > 0 UNION ALL SELECT 2, n, '- ' || n FROM s""")
def batch_report(spark, d):  # T28
    return ledger.batch_report(_ledger(spark, d))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS bucket, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_props(spark, d):  # N3
    e = table(spark, d, "events").withColumn("bucket", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint") % 10)
    return e.groupBy("event_type", "bucket").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


# ---- outlines --------------------------------------------------------------------------------------------------------

@query(f"""
    WITH r AS (SELECT conv_id, turn, {_strip("coalesce(content, '')")} AS c FROM chat_turn)
    SELECT conv_id, turn, CASE WHEN turn % 5 >= 3 THEN NULL WHEN turn % 2 = 0 THEN 'Deck' ELSE 'Untitled Presentation' END AS title, CASE WHEN turn % 5 >= 3 THEN NULL ELSE 'Untitled: a' || CASE WHEN c <> '' THEN ';' || c ELSE '' END || chr(10) || 'H' || turn || ': ' END AS slides FROM r""")
def outline_normalize(spark, d):  # N1 T13 D15: the whole content as a bullet of a deck made for it
    return _outlines(table(spark, d, "chat_turn"), F.coalesce("content", F.lit("")))


def _outlines(turns, bullet):
    item = F.regexp_extract(F.to_json(F.struct(bullet.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    good = F.concat(
        F.lit('```json\n{"title": '), F.when(F.col("turn") % 2 == 0, '" Deck "').otherwise('""'), F.lit(', "slides": [{"heading": " ", "bullets": [" a ", "", '), item,
        F.lit(']}, {"heading": "", "bullets": []}, 3, {"heading": "H'), F.col("turn").cast("string"), F.lit('"}]}\n```'),
    )
    raw = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("not json: "), F.coalesce("content", F.lit("")))).when(F.col("turn") % 5 == 3, '{"title": "x", "slides": []}').otherwise(good)
    found = turns.select("conv_id", "turn", outline.normalise(raw).alias("o"))
    line = F.transform("o.slides", lambda s: F.concat(s["heading"], F.lit(": "), F.array_join(s["bullets"], ";")))
    return found.select("conv_id", "turn", F.col("o.title").alias("title"), F.array_join(line, "\n").alias("slides"))


# ---- crawl -----------------------------------------------------------------------------------------------------------

_GOOD = "(status = 200 AND robots_ok AND transport_error IS NULL)"


_CHANGES = f"""
    WITH f AS (SELECT * REPLACE (CASE WHEN {_GOOD} THEN coalesce(sha256, '-') ELSE sha256 END AS sha256) FROM pdf_fetch WHERE pdf_url IS NOT NULL AND ts IS NOT NULL),
    p AS (SELECT *, last_value(CASE WHEN {_GOOD} THEN sha256 END IGNORE NULLS) OVER before AS prior, coalesce(bool_or(coalesce(status IN (200, 304) AND robots_ok AND transport_error IS NULL, false)) OVER before, false) AS known, row_number() OVER ordered AS place
      FROM f WINDOW ordered AS (PARTITION BY pdf_url ORDER BY ts, arrived_at NULLS FIRST, status NULLS FIRST, sha256 NULLS FIRST, etag NULLS FIRST, last_modified NULLS FIRST, robots_ok NULLS FIRST, transport_error NULLS FIRST),
        before AS (PARTITION BY pdf_url ORDER BY ts, arrived_at NULLS FIRST, status NULLS FIRST, sha256 NULLS FIRST, etag NULLS FIRST, last_modified NULLS FIRST, robots_ok NULLS FIRST, transport_error NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, CASE WHEN NOT coalesce(robots_ok, false) OR transport_error IS NOT NULL THEN 'error' WHEN status = 304 THEN 'unchanged' WHEN coalesce(status, 0) <> 200 THEN 'error'
      WHEN coalesce(sha256 = prior, false) THEN 'unchanged' WHEN known THEN 'updated' ELSE 'new' END AS outcome FROM p)"""


@query(_CHANGES + " SELECT pdf_url, outcome, CAST(count(*) AS BIGINT) AS n, CAST(min(ts) AS VARCHAR) AS first_at FROM c GROUP BY 1, 2")
def manifest_changes(spark, d):  # I1 W3 D18
    c = crawl.manifest_changes(table(spark, d, "pdf_fetch"))
    return c.groupBy("pdf_url", "outcome").agg(F.count("*").alias("n"), F.min("ts").cast("string").alias("first_at"))


@query(_CHANGES + """ SELECT CAST(date_trunc('month', ts) AS DATE) AS month, CAST(count(*) AS BIGINT) AS pdfs_seen, CAST(count(*) FILTER (outcome = 'new') AS BIGINT) AS pdfs_new, CAST(count(*) FILTER (outcome = 'updated') AS BIGINT) AS pdfs_updated,
    CAST(count(*) FILTER (outcome = 'unchanged') AS BIGINT) AS pdfs_unchanged, CAST(count(*) FILTER (outcome = 'error') AS BIGINT) AS pdfs_error, CAST(count(*) FILTER (outcome = 'error' AND coalesce(robots_ok, false)) AS BIGINT) AS errors FROM c GROUP BY 1""")
def crawl_stats(spark, d):  # A7 D17
    c = crawl.manifest_changes(table(spark, d, "pdf_fetch")).withColumn("month", F.trunc(F.to_date("ts"), "month"))
    return crawl.crawl_stats(c, "month")


@query(_CHANGES + """ SELECT pdf_url, ts, pdf_url || ': ' || coalesce(transport_error, 'HTTP ' || coalesce(CAST(status AS VARCHAR), 'None')) AS message FROM c WHERE outcome = 'error' AND coalesce(robots_ok, false)""")
def crawl_errors(spark, d):  # A7 D17
    return crawl.crawl_errors(crawl.manifest_changes(table(spark, d, "pdf_fetch")))


_LAW = r"\s*\((?:חוק|תקנות|חקיקה)\)\s*[-–]\s*אתר.?הזכויות\s*$"
_NAME = rf"""coalesce(nullif(left(regexp_replace(trim(regexp_replace(regexp_replace(coalesce(source_title, ''), '{_LAW}', ''), '[<>:"/\\|?*\x00-\x1f]', ' ', 'g')), '\s+', ' ', 'g'), 150), ''), 'document')"""


@query(_CHANGES + rf""", told AS (SELECT pdf_url, min_by(source_title, (coalesce(source_page_url, ''), coalesce(source_title, ''))) AS source_title, min(source_page_url) AS source_page_url FROM manifest GROUP BY 1),
    g AS (SELECT pdf_url, max(place) FILTER (outcome IN ('new', 'updated')) AS replaced, arg_max(sha256, place) FILTER (outcome IN ('new', 'updated')) AS sha256, min(ts) FILTER (outcome IN ('new', 'updated')) AS first_at, max(ts) AS checked FROM c WHERE outcome <> 'error' GROUP BY 1),
    v AS (SELECT pdf_url, arg_max(etag, place) FILTER (etag IS NOT NULL) AS etag, arg_max(last_modified, place) FILTER (last_modified IS NOT NULL) AS last_modified FROM c JOIN g USING (pdf_url) WHERE outcome <> 'error' AND status = 200 AND place >= coalesce(replaced, 0) GROUP BY 1)
    SELECT pdf_url, etag, last_modified, sha256, CASE WHEN replaced IS NOT NULL THEN {_NAME} || ' -- ' || coalesce(nullif(regexp_extract(regexp_extract(pdf_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1), ''), 'document.pdf') END AS local_filename,
      CASE WHEN replaced IS NOT NULL THEN source_page_url END AS source_page_url, CASE WHEN replaced IS NOT NULL THEN source_title END AS source_title,
      strftime(first_at, '%Y-%m-%dT%H:%M:%SZ') AS first_seen, strftime(checked, '%Y-%m-%dT%H:%M:%SZ') AS last_checked FROM g LEFT JOIN v USING (pdf_url) LEFT JOIN told USING (pdf_url)""")
def manifest_state(spark, d):  # I1 K7 T17: entries made by the fetches alone
    changes = crawl.manifest_changes(table(spark, d, "pdf_fetch"))
    return crawl.manifest_state(changes, table(spark, d, "manifest").select("pdf_url", "source_page_url", "source_title"), SITE)


@query("SELECT f.pdf_url, nullif(m.etag, '') AS if_none_match, nullif(m.last_modified, '') AS if_modified_since, m.pdf_url IS NOT NULL AS known FROM (SELECT DISTINCT pdf_url FROM pdf_fetch) f LEFT JOIN manifest m ON f.pdf_url = m.pdf_url")
def conditional_headers(spark, d):  # I2 J1 S19
    return crawl.conditional_headers(table(spark, d, "pdf_fetch"), table(spark, d, "manifest"))


_PATH = r"regexp_extract(pdf_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(rf"""
    WITH x AS (SELECT pdf_url, source_title, regexp_replace(coalesce(source_title, ''), '[{S}]*\((?:{t.LAW_KINDS})\)[{S}]*[-–][{S}]*{SITE}[{S}]*$', '') AS title, coalesce(nullif(regexp_extract({_PATH}, '([^/]+)/*$', 1), ''), 'document.pdf') AS base FROM manifest)
    SELECT pdf_url, coalesce(regexp_matches(source_title, '\((?:{t.LAW_KINDS})\)[{S}]*[-–][{S}]*{SITE}'), false) AS is_law,
      coalesce(nullif(left(regexp_replace({_strip("regexp_replace(title, '[<>:\"/\\\\|?*\\x00-\\x1f]', ' ', 'g')")}, '[{S}]+', ' ', 'g'), 150), ''), 'document') || ' -- ' || base AS filename FROM x""")
def safe_filenames(spark, d):  # T16 T17 T18 P7 K7
    title = t.drop_title_suffix(F.coalesce("source_title", F.lit("")), SITE)
    return table(spark, d, "manifest").select("pdf_url", F.coalesce(t.is_law_title(F.col("source_title"), SITE), F.lit(False)).alias("is_law"), F.concat(t.safe_filename(title), F.lit(" -- "), t.url_basename(F.col("pdf_url"))).alias("filename"))


@query(r"""
    WITH h AS (SELECT pdf_url, lower(regexp_extract(pdf_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM manifest)
    SELECT host, CAST(count(*) AS BIGINT) AS n, bool_and(host = 'zchuyot.example' OR ends_with(host, '.zchuyot.example')) AS inside FROM h GROUP BY 1""")
def domain_filter(spark, d):  # P8 P9
    m = table(spark, d, "manifest").select(t.url_host(F.col("pdf_url")).alias("host"), t.in_domain(F.col("pdf_url"), "zchuyot.example").alias("inside"))
    return m.groupBy("host").agg(F.count("*").alias("n"), F.every("inside").alias("inside"))


@query("SELECT source_page_url AS page_url, pdf_url FROM manifest WHERE source_page_url IS NOT NULL AND regexp_matches(pdf_url, '(?i)\\.pdf(?:[?#]|$)')")
def link_scan(spark, d):  # S18 P8 D16 U1
    m = table(spark, d, "manifest").where("source_page_url IS NOT NULL")
    page = F.concat(F.lit("<html><head><title>Law &amp; order</title></head><body><a class=x href='"), F.replace("pdf_url", F.lit("&"), F.lit("&amp;")), F.lit("'>pdf</a><a href='/he/other'>no</a><p>unclosed</body>"))
    return crawl.discover_pdfs(m.select(F.col("source_page_url").alias("page_url"), page.alias("html"))).select("page_url", "pdf_url")


@query("SELECT source_page_url, pdf_url FROM (SELECT source_page_url, pdf_url, row_number() OVER (PARTITION BY source_page_url ORDER BY pdf_url) AS r FROM manifest WHERE source_page_url IS NOT NULL) WHERE r = 1")
def distinct_first(spark, d):  # U2
    m = table(spark, d, "manifest").where("source_page_url IS NOT NULL").select("source_page_url", "pdf_url")
    return records.keep_first(m, ["source_page_url"], ["pdf_url"])


@query(r"""
    WITH u AS (SELECT DISTINCT source_page_url AS url FROM documents WHERE source_page_url IS NOT NULL), h AS (SELECT url, regexp_extract(url, '^[a-z]+://[^/]+', 0) AS host FROM u)
    SELECT url, 2 AS depth FROM h WHERE starts_with(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/he/')""")
def sitemap_walk(spark, d):  # S13 J6 L2 D19
    u = table(spark, d, "documents").where("source_page_url IS NOT NULL").select(F.col("source_page_url").alias("url")).distinct()
    h = u.withColumn("host", F.regexp_extract("url", "^[a-z]+://[^/]+", 0))
    top = h.select(F.lit("root").alias("parent"), F.concat("host", F.lit("/sitemap.xml")).alias("child"), F.lit(True).alias("is_index")).distinct()
    leaves = h.select(F.concat("host", F.lit("/sitemap.xml")).alias("parent"), F.col("url").alias("child"), F.lit(False).alias("is_index"))
    back = h.select(F.concat("host", F.lit("/sitemap.xml")).alias("parent"), F.lit("root").alias("child"), F.lit(True).alias("is_index")).distinct()
    return crawl.walk_sitemaps(top.unionByName(leaves).unionByName(back), "root")


@query("SELECT pdf_url, coalesce(source_page_url, 'none') AS link, 'https://zchuyot.example/w/he/index.php?title=%D7%9E%D7%99%D7%95%D7%97%D7%93%3A%D7%A9%D7%99%D7%A0%D7%95%D7%99%D7%99%D7%9D_%D7%90%D7%97%D7%A8%D7%95%D7%A0%D7%99%D7%9D&feed=atom&days=1&limit=500' AS feed FROM manifest")
def recent_changes(spark, d):  # S14 S15
    m = table(spark, d, "manifest")
    xml = F.concat(F.lit("<feed><entry><link href='"), F.coalesce("source_page_url", F.lit("none")), F.lit("'/><link href='x'/></entry></feed>"))
    return m.select("pdf_url", F.get(crawl.feed_links(xml), F.lit(0)).alias("link"), crawl.feed_url(F.lit("https://zchuyot.example")).alias("feed"))


_FOUND = r"""SELECT '%s' AS mode, source_page_url AS page_url, source_title AS title, pdf_url FROM manifest WHERE source_page_url IS NOT NULL AND regexp_matches(source_title, '\((?:חוק|תקנות|חקיקה)\)\s*[-–]\s*אתר.?הזכויות')
    AND regexp_matches(pdf_url, '(?i)\.pdf(?:[?#]|$)') AND (pdf_url LIKE 'https://zchuyot.example/%%' OR pdf_url LIKE 'https://%%.zchuyot.example/%%')"""


@query(r"""SELECT url, 1 AS depth FROM (SELECT DISTINCT source_page_url AS url FROM documents WHERE starts_with(regexp_extract(source_page_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/he/')) ORDER BY url LIMIT 100""")
def sitemap_first(spark, d):  # L2 S13: the bound on pages is the feature
    urls = table(spark, d, "documents").where("source_page_url IS NOT NULL").select(F.lit("root").alias("parent"), F.col("source_page_url").alias("child"), F.lit(False).alias("is_index"))
    return crawl.walk_sitemaps(urls, "root", most=100)


@query(r"""WITH u AS (SELECT DISTINCT pdf_url, lower(regexp_extract(pdf_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, regexp_extract(pdf_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM manifest),
    r AS (SELECT host, left(min(path), length(min(path)) - 6) AS bar FROM u WHERE length(path) > 6 GROUP BY 1)
    SELECT pdf_url FROM u JOIN r USING (host) WHERE NOT starts_with(path, bar)""")
def robots_gate(spark, d):  # S17: rules made of the addresses, hosts without any are barred
    u = table(spark, d, "manifest").select("pdf_url", t.url_host(F.col("pdf_url")).alias("host"), t.url_path(F.col("pdf_url")).alias("path")).distinct()
    rules = u.where("length(path) > 6").groupBy("host").agg(F.min("path").alias("least")).select("host", F.expr("left(least, length(least) - 6)").alias("path_prefix"))
    return crawl.robots_allow(u.select("pdf_url"), rules, "pdf_url")


@query(_FOUND % "full" + r" AND starts_with(regexp_extract(source_page_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/he/') UNION ALL " + _FOUND % "incremental")
def discover_modes(spark, d):  # I3 S13 S14 P7 P8 P9 U1 L2
    m = table(spark, d, "manifest").where("source_page_url IS NOT NULL")
    html = F.concat(F.lit("<html><head><title>"), _escaped("source_title"), F.lit("</title></head><body><a href='"), _escaped("pdf_url"), F.lit("'>pdf</a></body>"))
    pages = m.select(F.col("source_page_url").alias("page_url"), html.alias("html"), "pdf_url")
    urls = m.select(F.col("source_page_url").alias("url")).distinct()
    edges = urls.select(F.lit("https://zchuyot.example/sitemap.xml").alias("parent"), F.col("url").alias("child"), F.lit(False).alias("is_index"))
    feeds = urls.select(F.concat(F.lit("<feed><entry><link href='"), _escaped("url"), F.lit("'/></entry></feed>")).alias("xml"))
    law = t.is_law_title(F.col("title"), SITE)
    both = [crawl.discover(mode, pages, edges, "https://zchuyot.example/sitemap.xml", feeds, most=2**31 - 1, title_filter=law, domain="zchuyot.example").select(F.lit(mode).alias("mode"), "page_url", "title", "pdf_url") for mode in ("full", "incremental")]
    return both[0].unionByName(both[1])


def _escaped(column):
    return F.replace(F.replace(F.replace(F.coalesce(column, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("'"), F.lit("&#39;"))


@query("SELECT file_id, sha256(markdown) AS digest, strftime(extracted_at, '%Y-%m-%dT%H:%M:%SZ') AS at FROM extracted_file")
def digests(spark, d):  # T25 T26: the bytes are those of the text
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', extracted_at)")
    return table(spark, d, "extracted_file").select("file_id", F.sha2(F.col("markdown").cast("binary"), 256).alias("digest"), timestamps.instant_text(us).alias("at"))


@query("SELECT file_id, 'data:application/pdf;base64,' || to_base64(encode(coalesce(markdown, ''))) AS uri, '--- Content of ' || path || ' ---' || chr(10) || coalesce(markdown, '') AS block FROM extracted_file WHERE path IS NOT NULL")
def data_uris(spark, d):  # T27 T21: the table has no bytes but those of its text
    f = table(spark, d, "extracted_file").where("path IS NOT NULL").select("file_id", "path", F.coalesce("markdown", F.lit("")).alias("markdown"))
    return f.select("file_id", t.data_uri(F.col("markdown").cast("binary")).alias("uri"), retrieval.attached(F.col("path"), F.col("markdown")).alias("block"))


# ---- languages and models --------------------------------------------------------------------------------------------

_NAMED = "CASE doc_id % 4 WHEN 0 THEN 'Italian' WHEN 1 THEN ' HEBREW ' WHEN 2 THEN 'german' ELSE 'Arabic' END"


@query(f"SELECT x.doc_id, l.code, '<2' || l.code || '> ' || text AS tagged, l.name IN ('arabic', 'hebrew') AS rtl, lower(x.n) = 'hebrew' AS hebrew_ocr FROM (SELECT doc_id, text, trim({_NAMED}) AS n FROM documents) x JOIN language_dim l ON lower(x.n) = lower(l.name)")
def language_lookup(spark, d):  # P22 J3 T24 P18 P19 D7
    docs = table(spark, d, "documents").select("doc_id", "text", F.expr(_NAMED).alias("name"))
    coded = records.lookup_code(docs, table(spark, d, "language_dim"), "name")
    return coded.select("doc_id", "code", F.concat(F.lit("<2"), "code", F.lit("> "), "text").alias("tagged"), q.is_rtl_language(F.col("name")).alias("rtl"), q.hebrew_from_language(F.col("name")).alias("hebrew_ocr"))


@query()
def translate_retry(spark, d):  # I6 I7 I9 P21 A6 T23
    """A stand-in model that refuses long pieces; its sections are put together again with failures marked."""

    def short_only(text: str, code: str) -> str:
        if len(text) > 120:
            raise ValueError("too long")
        return f"[{code}] {text}"

    pieces = _chunked(spark, d).where("chunk IS NOT NULL").select("doc_id", "chunk_idx", models.translate(F.col("chunk"), F.lit("it"), short_only).alias("r"))
    return retrieval.assemble(pieces.select("doc_id", "chunk_idx", F.col("r.text").alias("t"), F.col("r.ok").alias("ok")), "doc_id", "chunk_idx", "t", "ok")


@query("""WITH p AS (SELECT conv_id, turn, content, turn % 3 > 0 AS ok FROM (SELECT DISTINCT conv_id, turn, content FROM chat_turn WHERE content IS NOT NULL)),
    m AS (SELECT *, CASE WHEN ok THEN content ELSE '>>> COULD NOT TRANSLATE THIS SECTION (shown untranslated below) >>>' || chr(10) || content || chr(10) || '<<< END UNTRANSLATED SECTION <<<' END AS t FROM p),
    a AS (SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY turn, t) AS body, count(*) FILTER (NOT ok) AS failed, count(*) AS total FROM m GROUP BY 1)
    SELECT conv_id, CASE WHEN failed > 0 THEN '⚠️ ' || failed || ' of ' || total || ' section(s) could not be translated and are shown in their ORIGINAL form below (marked with >>> / <<<).' || chr(10) || chr(10) || body ELSE body END AS text, CAST(failed AS BIGINT) AS failed, CAST(total AS BIGINT) AS total FROM a""")
def assemble_sections(spark, d):  # A6 A10 T23
    pieces = table(spark, d, "chat_turn").where("content IS NOT NULL").select("conv_id", "turn", "content").distinct().withColumn("ok", F.col("turn") % 3 > 0)
    return retrieval.assemble(pieces, "conv_id", "turn", "content", "ok")


_CODE = "CAST('0x' || left(md5(w), 8) AS UBIGINT)"


@query(f"""
    WITH e AS (SELECT rec_id, {_words("lower('search_document: ' || " + _EMBED + ")")} AS ws FROM cic_it_canons WHERE {_strip(_EMBED)} <> ''),
    c AS (SELECT rec_id, list_transform(ws, lambda w: {_CODE}) AS cs FROM e),
    v AS (SELECT rec_id, list_transform(range(16), lambda k: coalesce(list_sum(list_transform(list_filter(cs, lambda c: c % 16 = k), lambda c: CASE WHEN (c // 16) % 2 = 1 THEN 1.0 ELSE -1.0 END)), 0.0)) AS v FROM c),
    n AS (SELECT rec_id, v, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))) AS size FROM v)
    SELECT rec_id, array_to_string(list_transform(v, lambda x: printf('%.6f', round(CAST(x AS DOUBLE) / CASE WHEN size = 0 THEN 1 ELSE size END, 6) + 0.0)), ' ') AS vector FROM n""")
def embed_batch(spark, d):  # I8 T19
    rows = table(spark, d, "cic_it_canons").withColumn("e", records.text_to_embed())  # blank ones have no vector
    made = rows.select("rec_id", models.embed(F.col("e"), models.MODELS["embed"], "search_document: ").alias("vector")).where("vector IS NOT NULL")
    return made.select("rec_id", F.array_join(F.transform("vector", lambda x: F.format_string("%.6f", F.round(x, 6) + 0.0)), " ").alias("vector"))


_LINES = f"""
    WITH t AS (SELECT concat_ws('-', conv_id, turn) AS deck, {_strip('role')} AS role, {_strip('content')} AS c FROM chat_turn WHERE content IS NOT NULL), o AS (SELECT * FROM t WHERE c <> '')
    SELECT *, {_ratio(r'\x{0590}-\x{06FF}')} AS share FROM (
      SELECT deck, 0 AS slide_no, 0 AS line_no, coalesce(nullif(role, ''), 'Untitled Presentation') AS x FROM o UNION ALL SELECT deck, 1, 0, c FROM o UNION ALL SELECT deck, 1, 1, c FROM o)"""


@query(f"SELECT deck, slide_no, line_no, x AS text, coalesce(share >= 0.3, false) AS is_rtl FROM ({_LINES})")
def slide_rows(spark, d):  # K4
    turns = table(spark, d, "chat_turn").where("content IS NOT NULL")
    deck = F.to_json(F.struct(F.col("role").alias("title"), F.array(F.struct(F.col("content").alias("heading"), F.array(F.col("content")).alias("bullets"))).alias("slides")))
    return outline.slide_rows(turns.select(F.concat_ws("-", "conv_id", "turn").alias("deck"), outline.normalise(deck).alias("o")), "deck", "o")


def _sometimes(messages):
    """A stand-in that gives an outline at once, after a correction, or not at all, by the number that the prompt ends in."""
    kind = int(messages[0]["content"].rsplit(" ", 1)[-1]) % 3
    if kind == 0 or kind == 1 and len(messages) == 2:
        return '```json\n{"title": "Deck", "slides": [{"heading": "H", "bullets": []}]}\n```'
    return "Sorry, no."


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 1 ELSE 2 END AS tries, CASE WHEN turn % 3 < 2 THEN 'Deck' END AS title,
    CASE WHEN turn % 3 = 2 THEN 'Could not parse a slide outline from the model''s response.' END AS error FROM chat_turn""")
def outline_retry(spark, d):  # N2
    asked = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.coalesce("content", F.lit("")), F.lit(" "), F.col("turn").cast("string")).alias("content")))
    got = table(spark, d, "chat_turn").select("conv_id", "turn", models.ask_outline(asked, _sometimes).alias("a"))
    return got.select("conv_id", "turn", "a.tries", outline.normalise(F.col("a.raw"))["title"].alias("title"), "a.error")


@query("""SELECT conv_id, turn, content AS answer FROM chat_turn WHERE content IS NOT NULL""")
def chat_answers(spark, d):  # D12, the chat slot
    asked = F.array(F.struct(F.lit("system").alias("role"), F.lit("Answer.").alias("content")), F.struct(F.lit("user").alias("role"), F.col("content").alias("content")))
    return table(spark, d, "chat_turn").where("content IS NOT NULL").select("conv_id", "turn", models.chat(asked, models.MODELS["chat"])["text"].alias("answer"))


@query("""SELECT file_id, CASE length(left(coalesce(markdown, ''), 4000)) % 3 WHEN 1 THEN 'sales' WHEN 2 THEN 'expense' ELSE 'unrecognized' END AS document_type,
    CASE WHEN length(left(coalesce(markdown, ''), 4000)) % 3 > 0 THEN CAST(length(left(markdown, 4000)) AS DOUBLE) END AS amount FROM extracted_file""")
def invoice_slot(spark, d):  # S20 L3 N3, the invoice slot: production shows a model the first 4000 characters
    answers = table(spark, d, "extracted_file").select("file_id", models.classify(F.col("markdown"), models.MODELS["invoice"]).alias("raw"))
    return ledger.decode(answers, "raw", ("file_id",)).select("file_id", "document_type", ledger.number("amount").alias("amount"))


@query(r"""WITH f AS (SELECT doc_id, regexp_replace(text, '[^\p{L}]', '', 'g') AS l, left(regexp_replace(text, '[^\p{L}]|[A-Za-z]', '', 'g'), 1) AS c FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN l = '' THEN NULL WHEN unicode(c) BETWEEN 1424 AND 1535 AND c <> '' THEN 'he' WHEN unicode(c) BETWEEN 1536 AND 1791 AND c <> '' THEN 'ar' ELSE 'en' END AS code FROM f""")
def language_slot(spark, d):  # T9, the language slot
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", models.language(F.col("text"), models.MODELS["language"]).alias("code"))


@query("SELECT doc_id, md5(text) AS text FROM documents")
def html_entities(spark, d):  # T3: entities of a text that was written with them
    written = F.replace(F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;")), F.lit('"'), F.lit("&quot;"))
    return table(spark, d, "documents").select("doc_id", F.md5(t.unescape(written).cast("binary")).alias("text"))


@query(rf"""SELECT file_id, round({_ratio(r'\x{0590}-\x{05FF}')}, 6) AS hebrew_ratio FROM (SELECT file_id, array_to_string(list_slice(string_split(markdown, chr(10) || chr(10)), 1, 5), '') AS x FROM extracted_file)""")
def first_pages(spark, d):  # L4 P4: what comes between blank lines stands for a page
    pages = q.first_pages(F.split("markdown", "\n\n"))
    return table(spark, d, "extracted_file").select("file_id", F.round(q.hebrew_ratio(pages), 6).alias("hebrew_ratio"))


_BLOCKS = rf"""
    WITH l AS (SELECT file_id, list_transform(string_split(coalesce(markdown, ''), chr(10)), lambda x: {_strip('x')}) AS ls FROM extracted_file),
    m AS (SELECT file_id, list_transform(ls, lambda x: CASE WHEN x = '' THEN chr(1) WHEN regexp_matches(x, '^#{{1,6}}[ \t]') THEN chr(1) || 'h' || length(regexp_extract(x, '^(#{{1,6}})[ \t]', 1)) || chr(2) || {_strip("regexp_replace(x, '^#+', '')")} || chr(1)
      WHEN regexp_matches(x, '^\|.*\|$') THEN CASE WHEN regexp_matches(x, '^[|:\- \t]+$') THEN chr(1) ELSE array_to_string(list_transform(string_split(substr(x, 2, length(x) - 2), '|'), lambda c: chr(1) || 'cell' || chr(2) || {_strip('c')} || chr(1)), '') END
      WHEN regexp_matches(x, '^(?:[-*+]|\d{{1,9}}[.)])[ \t]') THEN chr(1) || 'item' || chr(2) || x || chr(1) ELSE chr(4) || x END) AS ms FROM l),
    p AS (SELECT file_id, list_filter(string_split(array_to_string(ms, ''), chr(1)), lambda p: p <> '') AS ps FROM m),
    b AS (SELECT file_id, generate_subscripts(ps, 1) AS block_no, unnest(ps) AS p FROM p),
    k AS (SELECT file_id, block_no, CASE WHEN starts_with(p, chr(4)) THEN 'p' ELSE split_part(p, chr(2), 1) END AS kind, CASE WHEN starts_with(p, chr(4)) THEN replace(substr(p, 2), chr(4), ' ') ELSE split_part(p, chr(2), 2) END AS x FROM b)"""


@query(_BLOCKS + rf" SELECT file_id, CAST(block_no AS BIGINT) AS block_no, kind, md5(x) AS text, coalesce({_ratio(r'\x{0590}-\x{06FF}')} >= 0.3, false) AS is_rtl FROM k")
def docx_blocks(spark, d):  # K3
    rows = table(spark, d, "extracted_file").select("file_id", F.posexplode(office.blocks(F.col("markdown"))).alias("at", "b"))
    return rows.select("file_id", (F.col("at") + 1).cast("bigint").alias("block_no"), "b.kind", F.md5(F.col("b.text").cast("binary")).alias("text"), "b.is_rtl")


_TEXT = f"regexp_replace(coalesce(markdown, ''), '[{t.MARKS}]', '', 'g')"


@query()
def document_markdown(spark, d):  # S2 S2a S3 S5 S6 P3 P5 A1 A2 K8: the texts stand for files, read by the stand-in models
    m = models.MODELS
    files_ = table(spark, d, "extracted_file").select(F.concat(F.coalesce("path", F.lit("none")), F.lit("#"), F.col("file_id").cast("string"), F.coalesce(t.suffix_of(F.col("path")), F.lit(""))).alias("path"), F.coalesce("markdown", F.lit("")).cast("binary").alias("content"), "hebrew_ocr_used")
    done = files.extract(files_, F.col("hebrew_ocr_used"), m["document_markdown"], m["page_texts"], m["page_words"], m["image_script"])
    return done.select("path", F.md5(F.col("markdown").cast("binary")).alias("markdown"), "used_ocr", "error")


# ---- timestamps ------------------------------------------------------------------------------------------------------


@query()
def p2_found(spark, d):
    return timestamps.normalise_timestamps(table(spark, d, "invoice_json"), table(spark, d, "office"), "invoice_id", "date", "office_code", "received_at")[0]


@query()
def p2_zones(spark, d):
    return timestamps.normalise_timestamps(table(spark, d, "invoice_json"), table(spark, d, "office"), "invoice_id", "date", "office_code", "received_at")[1]
