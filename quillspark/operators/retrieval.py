"""Prompts: retrieved context, attached documents, chat messages, failure notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much attached text goes into a prompt, and what marks a cut.
MOST_CONTEXT, CUT_MARK = 6000, "\n[...truncated, file is longer...]"
# Fixed value: separates retrieved passages.
BETWEEN = "\n\n---\n\n"


def passage() -> Column:
    """One retrieved canon as text."""
    return F.concat(F.lit("[Can. "), F.coalesce("canon_number", F.lit("?")), F.lit("] ("), F.coalesce("hierarchy_path", F.lit("")), F.lit(")\n"), F.coalesce("text", F.lit("")))


def panel_line() -> Column:
    """K9: one source as a Markdown item, with its address and note where it has them."""
    url, note = F.coalesce("source_url", F.lit("")), F.coalesce("in_force_note", F.lit(""))
    return F.concat(
        F.lit("- **Can. "), F.coalesce("canon_number", F.lit("?")), F.lit("** — "), F.coalesce("hierarchy_path", F.lit("")),
        F.when(url != "", F.concat(F.lit("  \n  ["), url, F.lit("]("), url, F.lit(")"))).otherwise(""), F.when(note != "", F.concat(F.lit("  \n  ⚠️ "), note)).otherwise(""),
    )


def context(hits: DataFrame) -> DataFrame:
    """(query_id, context, panel) from hits (query_id, rank, canon columns); k hits per query bound each group."""
    rows = hits.select("query_id", "rank", passage().alias("passage"), panel_line().alias("line"))
    lined = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "passage", "line"))).alias("hits"))
    return lined.select("query_id", F.array_join(F.transform("hits", lambda h: h["passage"]), BETWEEN).alias("context"), F.array_join(F.transform("hits", lambda h: h["line"]), "\n\n").alias("panel"))


def attached(name: Column, text: Column) -> Column:
    """An attached document as text."""
    return F.concat(F.lit("--- Content of "), name, F.lit(" ---\n"), text)


def user_message(question: Column, documents: Column) -> Column:
    """The question, with the attached documents in front of it where there are any."""
    return F.when(F.coalesce(documents, F.lit("")) != "", F.concat(F.lit("The user attached the following document(s):\n\n"), documents, F.lit("\n\nUser question: "), question)).otherwise(question)


def canon_message(question: Column, found: Column) -> Column:
    """The question with the retrieved canons, or the order to say that there are none."""
    with_canons = F.concat(F.lit("Retrieved canons relevant to the question:\n\n"), found, F.lit("\n\nUser question: "), question)
    without = F.concat(F.lit("No canons were retrieved for this question -- tell the user that plainly instead of guessing.\n\nUser question: "), question)
    return F.when(F.coalesce(found, F.lit("")) != "", with_canons).otherwise(without)


def messages(history: DataFrame, questions: DataFrame, system: str | None = None) -> DataFrame:
    """(conv_id, part, turn, role, content): a system message (part 0) if given, text turns (1), the question (2).

    Rows in place of one array per conversation, so no conversation is gathered; order by (part, turn).
    """
    past = history.where(F.col("content").isNotNull()).select("conv_id", F.lit(1).alias("part"), "turn", "role", "content")
    asked = questions.select("conv_id", F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"), "content")
    out = past.unionByName(asked)
    if system is not None:
        out = out.unionByName(questions.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("turn"), F.lit("system").alias("role"), F.lit(system).alias("content")).distinct())
    return out


def mark_failure(text: Column, ok: Column) -> Column:
    """A section that couldn't be translated, marked as such."""
    return F.when(ok, text).otherwise(F.concat(F.lit(">>> COULD NOT TRANSLATE THIS SECTION (shown untranslated below) >>>\n"), text, F.lit("\n<<< END UNTRANSLATED SECTION <<<")))


def assemble(pieces: DataFrame, key: str, position: str, text: str, ok: str) -> DataFrame:
    """(key, text, failed, total): a document's sections in order, failures marked and counted in front."""
    lined = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(position), mark_failure(F.col(text), F.col(ok)).alias("t")))).alias("s"), F.count_if(~F.col(ok)).alias("failed"), F.count("*").alias("total"))
    body = F.array_join(F.transform("s", lambda x: x["t"]), "\n\n")
    head = F.concat(F.lit("⚠️ "), F.col("failed").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" section(s) could not be translated and are shown in their ORIGINAL form below (marked with >>> / <<<).\n\n"))
    return lined.select(key, F.when(F.col("failed") > 0, F.concat(head, body)).otherwise(body).alias("text"), "failed", "total")


def summary_prompt(text: Column, language: Column) -> Column:
    """Struct (system, user) that asks for a summary in one language."""
    system = F.concat(F.lit("You are a precise document summarizer. Respond ONLY in "), language, F.lit(", matching the language of the text you are given -- never switch to a different language."))
    return F.struct(system.alias("system"), F.concat(F.lit("Summarize this in 3-5 bullet points:\n\n"), text).alias("user"))
