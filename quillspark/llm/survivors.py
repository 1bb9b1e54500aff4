"""One surviving record per group of records that name the same thing, field by field.

Groups are never gathered: every field's winner is a ``max`` over a struct of its criteria, which Spark
combines before the shuffle, so a group that holds a third of all rows costs one row per task.

Currency. For fields without a stated preference the most current value survives. Where a row has no timestamp, its
place in time is reasoned from what timestamped rows show. Per group and field each value is seen over a span of time;
values whose spans follow one another are a transition; the transitions of all groups give a precedence, a partial
order over the values of a field (rare values stand under the kind of source that wrote them, whose transitions are
learned alike). In its group an undated value is as current as the latest dated value that precedes it, and comes after
it; values that nothing dated precedes are ordered by the precedence alone. Values that the precedence doesn't relate
stay unrelated: a date says nothing about them.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.marks import JAVA_UNSEEN

# What stands for a missing text, in lower case, letters and digits only.
STAND_INS = (
    "none", "null", "nil", "nan", "nd", "na", "nv", "vuoto", "vuota", "empty", "blank", "missing", "unknown", "undefined",
    "tbd", "todo", "notavailable", "nottext", "notext", "nodata", "testonondisponibile", "nondisponibile",
    "testomancante", "mancante", "nessuntesto", "senzatesto", "textnotavailable",
)


def name_key(name: Column) -> Column:
    """What two names must share to name the same thing: letters and digits, in compatibility form and lower
    case, without the leading zeros of numbers; all else is ignored. Null where nothing is left."""
    plain = name.rlike(r"^[\x00-\x7f]*$")

    @F.pandas_udf("string")
    def folded(names: pd.Series) -> pd.Series:
        def fold(text: str | None) -> str | None:
            if text is None:
                return None
            form = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
            return "".join(c for c in form if c.isalpha() or unicodedata.category(c) == "Nd")

        return names.map(fold, na_action="ignore")

    # only names beyond ASCII go through Python, and once: what isn't deterministic is neither repeated nor moved
    other = folded.asNondeterministic()(F.when(~plain, name))
    key = F.regexp_replace(F.when(plain, F.regexp_replace(F.lower(name), "[^a-z0-9]", "")).otherwise(other), r"(?<!\p{Nd})0+(?=\p{Nd})", "")
    return F.when(key != "", key)


def unseen(text: Column) -> Column:
    """``text`` without white space and invisible characters."""
    return F.regexp_replace(text, JAVA_UNSEEN, "")


def is_missing(text: Column) -> Column:
    """Null, blank, nothing but punctuation, or a value that only stands for a missing text."""
    bare = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return text.isNull() | (bare == "") | bare.isin(*STAND_INS)


#: A value is a class of its own at this share of its field's values and so often, so a field has at most 1 / share.
LEAST_SHARE, LEAST_COUNT = 1e-3, 3
#: A transition is learned at this share of its field's transitions, so at most 1 / share of them reach the driver.
LEAST_TRANSITIONS = 1e-4


def transition_counts(rows: DataFrame, keys: Sequence[str], cls: str, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, earlier, later, n): in how many groups (by, keys) the class ``later`` follows ``earlier`` in time.

    Per group and class the first and last time are kept (combined before the shuffle). A group has at most one entry
    per class, and only neighbours in time count, so a group costs its classes, not its rows. Classes whose spans
    overlap, or that have the same single time, give no transition.
    """
    spans = rows.where(F.col(ts).isNotNull() & F.col(cls).isNotNull()).groupBy(*by, *keys, cls).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    ordered = spans.groupBy(*by, *keys).agg(F.sort_array(F.collect_list(F.struct("first", "last", cls))).alias("seen"))
    pairs = F.arrays_zip(F.slice("seen", 1, F.size("seen") - 1).alias("a"), F.slice("seen", 2, F.size("seen") - 1).alias("b"))
    steps = ordered.where(F.size("seen") > 1).select(*by, F.explode(pairs).alias("step"))
    counted = steps.where("step.a.last <= step.b.first AND step.a.first < step.b.last").groupBy(*by, F.col(f"step.a.{cls}").alias("earlier"), F.col(f"step.b.{cls}").alias("later")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*(by or [F.lit(1)])))).where(F.col("share") >= LEAST_TRANSITIONS).drop("share")


def ancestors(counts: Sequence[tuple[str, str, int]]) -> dict[str, frozenset[str]]:
    """The classes that precede each class, directly or through others, in the precedence that the transitions show.

    a precedes b if b follows a more often than the reverse. Such pairs are added by their excess, greatest first (ties by
    name), and one that contradicts those before it (b already precedes a) is left out, so the order has no cycle. Classes
    that no chain of pairs joins aren't related.
    """
    weight: dict[tuple[str, str], int] = defaultdict(int)
    for a, b, n in counts:
        weight[a, b] += n
    edges = sorted((weight.get((b, a), 0) - n, a, b) for (a, b), n in list(weight.items()) if a != b and n > weight.get((b, a), 0))
    before: dict[str, set[str]] = defaultdict(set)
    for _, a, b in edges:
        if b in before[a] or a in before[b]:
            continue
        new = before[a] | {a}
        for c in [c for c in before if c == b or b in before[c]] + ([b] if b not in before else []):
            before[c] |= new
    return {c: frozenset(x) for c, x in before.items() if x}


def current_values(rows: DataFrame, key: str, fields: Sequence[str], kind: str, ts: str, trust: str, rec: str) -> DataFrame:
    """(key, *fields): per group the most current value of each field, missing values left out.

    Of dated values the latest counts. An undated one takes the time of the latest dated value of its group that precedes
    it, and comes after that one; between undated ones of a time (or of none) the one with more predecessors wins, which
    no other of the group follows. Then trust, then the smaller record. Groups are kept as one row per class of value
    with its best dated and its best undated record: no raw row is gathered or joined by its group.
    """
    spark = rows.sparkSession
    wide = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    cells = rows.select(key, F.coalesce(F.col(kind), F.lit("?")).alias("kind"), F.col(ts).alias("ts"), F.col(trust).alias("trust"), F.col(rec).alias("rec"), wide.alias("c")).select(key, "kind", "ts", "trust", "rec", "c.*").where(~is_missing(F.col("value")))
    totals = {r["field"]: r["n"] for r in cells.groupBy("field").agg(F.count("*").alias("n")).collect()}
    least = F.create_map(*(F.lit(x) for f in fields for x in (f, max(float(LEAST_COUNT), LEAST_SHARE * totals.get(f, 0)))))
    frequent = cells.groupBy("field", "value").agg(F.count("*").alias("n")).where(F.col("n") >= least[F.col("field")]).select("field", "value").collect()  # at most 1 / LEAST_SHARE a field
    classes = spark.createDataFrame([(r["field"], r["value"], r["value"]) for r in frequent], "field string, value string, cls string")
    cells = cells.join(F.broadcast(classes), ["field", "value"], "left")
    by_field: dict[str, list[tuple[str, str, int]]] = defaultdict(list)
    for r in transition_counts(cells, [key], "cls", "ts", ["field"]).collect():
        by_field[r["field"]].append((r["earlier"], r["later"], r["n"]))
    by_kind = ancestors([(r["earlier"], r["later"], r["n"]) for r in transition_counts(cells, [key], "kind", "ts").collect()])
    of_values = [(f, c, sorted(x)) for f in sorted(by_field) for c, x in sorted(ancestors(by_field[f]).items())]
    value_order = spark.createDataFrame(of_values, "field string, cls string, before array<string>")
    kind_order = spark.createDataFrame([(c, sorted(x)) for c, x in sorted(by_kind.items())], "kind string, kinds_before array<string>")
    dated, record = F.col("ts").isNotNull(), F.struct("trust", (-F.col("rec")).alias("neg"), "value")
    best = cells.groupBy(key, "field", "cls", "kind").agg(F.max("ts").alias("last"), F.max(F.when(dated, F.struct("ts", record.alias("r")))).alias("known"), F.max(F.when(~dated, record)).alias("open"))
    best = best.join(F.broadcast(value_order), ["field", "cls"], "left").join(F.broadcast(kind_order), "kind", "left")
    gathered = best.groupBy(key, "field").agg(F.collect_list(F.struct("cls", "kind", "last", "known", "open", "before", "kinds_before")).alias("all"))
    earliest = F.lit(-(2**63) + 1)
    micros = lambda t: F.coalesce(F.unix_micros(t.cast("timestamp")), earliest)

    def placed(e: Column) -> Column:
        of_value = F.filter("all", lambda x: F.coalesce(F.array_contains(e["before"], x["cls"]), F.lit(False)))
        of_kind = F.filter("all", lambda x: F.coalesce(F.array_contains(e["kinds_before"], x["kind"]), F.lit(False)))
        prior = F.when(e["cls"].isNotNull(), of_value).otherwise(of_kind)
        size = F.coalesce(F.size(F.when(e["cls"].isNotNull(), e["before"]).otherwise(e["kinds_before"])), F.lit(0))
        return F.struct(micros(F.array_max(F.transform(prior, lambda x: x["last"]))).alias("at"), F.greatest(size, F.lit(0)).alias("order"), e["open"].alias("r"))

    known = F.transform(F.filter("all", lambda e: e["known"].isNotNull()), lambda e: F.struct(micros(e["known"]["ts"]).alias("at"), F.lit(-1).alias("order"), e["known"]["r"].alias("r")))
    undated = F.transform(F.filter("all", lambda e: e["open"].isNotNull()), placed)
    won = gathered.select(key, "field", F.array_max(F.concat(known, undated))["r"]["value"].alias("value"))
    return won.groupBy(key).agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))


def keyed_canons(canons: DataFrame) -> DataFrame:
    """``canons`` with ``chunk_key``; records that name no chunk (neither id nor number) are left out."""
    blank = lambda c: F.coalesce(unseen(F.col(c)), F.lit("")) == ""
    name = F.when(~blank("chunk_id"), F.col("chunk_id")).when(~blank("canon_number"), F.concat(F.lit("CIC-it-"), "canon_number"))
    return canons.withColumn("chunk_key", name_key(name)).where(F.col("chunk_key").isNotNull())


def _ranked(keyed: DataFrame, trust: DataFrame) -> DataFrame:
    """``keyed`` with ``trust``; source_trust is a fixed dimension of a few rows, so its side is broadcast."""
    small = trust.select(F.col("source_kind").alias("__kind"), F.col("trust").cast("int").alias("__trust")).where("__kind IS NOT NULL").groupBy("__kind").agg(F.max("__trust").alias("__trust"))
    return keyed.join(F.broadcast(small), keyed["source_kind"] == small["__kind"], "left").withColumn("trust_", F.coalesce("__trust", F.lit(-(2**31) + 1))).drop("__kind", "__trust")


def _winner(value: Column) -> Column:
    """max of (characters, trust, time, -rec_id) over rows whose value isn't missing; null if all are."""
    order = F.struct(
        F.length(unseen(value)).alias("chars"), F.col("trust_").alias("trust"),
        F.coalesce(F.unix_micros(F.col("scraped_at").cast("timestamp")), F.lit(-(2**63) + 1)).alias("at"), (-F.col("rec_id")).alias("neg_id"),
    )
    return F.max(F.when(~is_missing(value), order))


def surviving_values(canons: DataFrame, trust: DataFrame, fields: Sequence[str] = ("text", "embed_text")) -> DataFrame:
    """One row (chunk_key, first_rec, n_records, <field>_rec ...) per chunk: whose value of each field survives.

    Missing values never survive. Of the others the one with the most characters (white space and invisible
    ones not counted) wins, then the higher trust (null or unknown kinds least), then the later scraped_at (null
    earliest), then the smaller rec_id. A null rec_id is no record.
    """
    rows = _ranked(keyed_canons(canons.where("rec_id IS NOT NULL")), trust)
    return rows.groupBy("chunk_key").agg(
        F.min("rec_id").alias("first_rec"), F.count("*").alias("n_records"), *((-_winner(F.col(f))["neg_id"]).alias(f"{f}_rec") for f in fields)
    )


def survivors_found(canons: DataFrame, trust: DataFrame, fields: Sequence[str] = ("text", "embed_text")) -> DataFrame:
    """(first_rec, field_name, rec_id) of groups of two or more records; no row where no value is left."""
    won = surviving_values(canons, trust, fields).where("n_records > 1")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_rec").alias("rec_id")) for f in fields))).alias("won")
    return won.select("first_rec", each).select("first_rec", "won.field_name", "won.rec_id").where("rec_id IS NOT NULL")


def golden_records(canons: DataFrame, trust: DataFrame, current_fields: Sequence[str] = ("canon_number", "libro", "parte", "sezione", "titolo", "capitolo", "articolo", "hierarchy_path", "source_url", "in_force_note")) -> DataFrame:
    """One record per chunk: text and embed_text by :func:`surviving_values`' order, the other fields by currency.

    Columns: chunk_key, first_rec, n_records, text, embed_text, then ``current_fields``. A field whose values are
    all missing is null. Undated rows take part as :func:`current_values` reasons for them.
    """
    rows = _ranked(keyed_canons(canons.where("rec_id IS NOT NULL")), trust)

    def best(field: str) -> Column:
        value = F.col(field)
        order = F.struct(F.length(unseen(value)), F.col("trust_"), F.coalesce(F.unix_micros(F.col("scraped_at").cast("timestamp")), F.lit(-(2**63) + 1)), -F.col("rec_id"))
        return F.max_by(value, F.when(~is_missing(value), order)).alias(field)

    kept = rows.groupBy("chunk_key").agg(F.min("rec_id").alias("first_rec"), F.count("*").alias("n_records"), best("text"), best("embed_text"))
    current = current_values(rows, "chunk_key", current_fields, "source_kind", "scraped_at", "trust_", "rec_id")
    return kept.join(current, "chunk_key", "left").select("chunk_key", "first_rec", "n_records", "text", "embed_text", *current_fields)  # a row per chunk on either side
