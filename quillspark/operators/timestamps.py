"""Mixed timestamp notations and zones to one unambiguous instant.

Three steps. (1) Each text is read once into a wall-clock time and, where the text names one, an offset or a zone; an
Arrow batch function, as the notations need more than a pattern. What was read is written to the checkpoint folder.
(2) For wall-clock times without a zone, the offset history (an IANA zone) of the place that wrote them is estimated. The
rows that state an offset show how long after their instant rows are ingested. Every history that any IANA zone has in
the time of the data then converts each zone-less row: one that would be ingested before it was written, or whose
wall-clock time the history skips, is a violation and costs most; another costs by how rare its delay is. The history of
least cost is used. A zone that the place is documented to use is favoured by fixed odds (``DOCUMENTED``), which enough
rows outweigh. (3) Times convert; those that occur twice or not at all in the history have no instant.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.util import cut, spread

# Month names and abbreviations, January to December, without their dots.
MONTH_NAMES = (
    ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
    ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"),
    ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"),
    ("gen", "febbr", "mar", "apr", "mag", "giu", "lug", "ago", "set", "ott", "nov", "dic"),
    ("januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"),
    ("jänner", "feber", "mär", "apr", "mai", "jun", "jul", "aug", "sept", "okt", "nov", "dez"),
    ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    ("janv", "févr", "mars", "avr", "mai", "juin", "juil", "août", "sept", "oct", "nov", "déc"),
    ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
    ("ינואר", "פברואר", "מרץ", "אפריל", "מאי", "יוני", "יולי", "אוגוסט", "ספטמבר", "אוקטובר", "נובמבר", "דצמבר"),
)
MONTHS = {name: k for names in MONTH_NAMES for k, name in enumerate(names, 1)} | {"ב" + name: k for k, name in enumerate(MONTH_NAMES[-1], 1)}
# Day names and abbreviations, Monday to Sunday.
DAYS = {name: k for names in (("mon", "tue", "wed", "thu", "fri", "sat", "sun"), ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")) for k, name in enumerate(names)}

_CLEAN = re.compile("[​-‏‪-‮⁦-⁩﻿]")
_TIME = (
    r"(?P<h>\d{1,2})(?:(?P<sep>[:.])(?P<mi>\d{2})(?:(?P=sep)(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?|(?:h|H)(?P<hmi>\d{2})(?::(?P<hs>\d{2}))?)"
    r"(?:\s?(?P<ap>[aApP])\.?[mM]\.?)?(?:\s*Uhr)?"
)
_ZONE = (
    r"(?:\s*(?:(?P<off>[+-]\d{2}(?::?\d{2})?)|(?P<z>[zZ]|UTC|GMT)|\[(?P<in>[\w+-]+(?:/[\w+-]+)*)\]|\((?P<par>[\w+-]+(?:/[\w+-]+)*)\))"
    r"|\s+(?P<word>[A-Za-z]+(?:/[\w+-]+)+)|\s*\b(?P<abbr>[A-Z]{3,5}))?"
)
_JOIN = r"(?:\s*[Tt]\s*|\s*,\s*|\s+-\s+|\s+)"
_NAMED_JOIN = r"(?:\s*,\s*|\s+)(?:(?:ore|alle|at|um|à|a las|בשעה)\s+)?"
_SHAPES = tuple(
    re.compile(shape + r"\Z")
    for shape in (
        rf"(?P<y>\d{{4}})(?P<ds>[-/.])(?P<mo>\d{{1,2}})(?P=ds)(?P<d>\d{{1,2}}){_JOIN}{_TIME}{_ZONE}",
        rf"(?P<n1>\d{{1,2}})(?P<ds>[-/.])(?P<n2>\d{{1,2}})(?P=ds)(?P<y>\d{{4}}|\d{{2}}){_JOIN}{_TIME}{_ZONE}",
        rf"{_TIME}{_ZONE},?\s+(?P<n1>\d{{1,2}})(?P<ds>[-/.])(?P<n2>\d{{1,2}})(?P=ds)(?P<y>\d{{4}}|\d{{2}})",
        rf"(?:(?P<dow>[^\W\d_]+)\.?,?\s+)?(?P<d>\d{{1,2}})\.?[\s-](?:di |de )?(?P<mn>[^\W\d_]+)\.?,?[\s-](?:de )?(?P<y>\d{{4}}|\d{{2}}){_NAMED_JOIN}{_TIME}{_ZONE}",
        rf"(?:(?P<dow>[^\W\d_]+)\.?,?\s+)?(?P<mn>[^\W\d_]+)\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}){_NAMED_JOIN}{_TIME}{_ZONE}",
        rf"(?P<y>\d{{4}})-W(?P<wk>\d{{2}})-(?P<wd>\d){_JOIN}{_TIME}{_ZONE}",
        rf"(?P<y>\d{{4}})-(?P<doy>\d{{3}}){_JOIN}{_TIME}{_ZONE}",
        r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})[Tt]?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d+))?" + _ZONE,
    )
)
_EPOCH = re.compile(r"(\d{9,10}|\d{13}|\d{16}|\d{19})(?:\.(\d+))?\Z")
_US = 1_000_000
#: Places (rows of the table of places, and places that rows name) go to every task; more than these are refused.
MOST_PLACES = 10_000
#: Log odds of a documented zone against any other.
DOCUMENTED = 20.0
#: Delays by quarters of an hour for half a day, then by doublings; cost of a violation; rows that the assumed shape of
#: delays (ever rarer) weighs against those that show them.
QUARTER, QUARTERS, DOUBLINGS, VIOLATION, ASSUMED = 900, 48, 14, 12.0, 20.0


@lru_cache(maxsize=1)
def _zones() -> dict[str, str]:
    return {z.lower(): z for z in available_timezones()}


@lru_cache(maxsize=256)
def abbreviations(zone: str) -> dict[str, int]:
    """Abbreviation to offset in seconds, as a zone used them from 2000 to 2037; unclear ones are left out."""
    info, seen = ZoneInfo(zone), {}
    day = dt.datetime(2000, 1, 1, 12)
    while day.year < 2038:
        there = day.replace(tzinfo=info)
        seen.setdefault(there.tzname(), set()).add(int(there.utcoffset().total_seconds()))
        day += dt.timedelta(days=14)
    return {name: next(iter(offsets)) for name, offsets in seen.items() if len(offsets) == 1 and name.isalpha()}


def read_timestamp(text: str | None, day_first: bool | None, zone: str | None) -> tuple[int, int | None, str | None] | None:
    """(wall-clock microseconds, offset in seconds or None, IANA zone or None) that ``text`` states, or None.

    None: no time of day, an impossible day or time, an unreadable or contradictory text. ``day_first`` orders
    numeric day and month (None: only clear ones are read); ``zone`` gives abbreviations their meaning.
    """
    if text is None:
        return None
    line = " ".join(unicodedata.normalize("NFKC", _CLEAN.sub("", text)).split())
    line = "".join(str(unicodedata.decimal(c)) if not c.isascii() and unicodedata.category(c) == "Nd" else c for c in line)
    if line.isdigit() and len(line) == 14 or len(line) == 12 and line.isdigit():
        epoch = None
    else:
        epoch = _EPOCH.match(line)
    if epoch:
        whole = epoch[1]
        micros = {9: _US, 10: _US, 13: 1000, 16: 1}.get(len(whole))
        value = int(whole) // 1000 if micros is None else int(whole) * micros
        if epoch[2] and len(whole) <= 10:
            value += int((epoch[2] + "000000")[:6])
        return value, 0, None
    for shape in _SHAPES:
        if m := shape.match(line):
            g = m.groupdict()
            try:
                return _resolve(g, day_first, zone)
            except (ValueError, OverflowError):
                continue
    return None


def _resolve(g: dict, day_first: bool | None, zone: str | None) -> tuple[int, int | None, str | None]:
    year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
    if g.get("wk"):
        day = dt.date.fromisocalendar(year, int(g["wk"]), int(g["wd"]))
    elif g.get("doy"):
        day = dt.date(year, 1, 1) + dt.timedelta(days=int(g["doy"]) - 1)
        if day.year != year:
            raise ValueError("no such day")
    elif g.get("n1"):
        a, b = int(g["n1"]), int(g["n2"])
        if day_first is None and a != b and max(a, b) <= 12:
            raise ValueError("day and month can't be told apart")
        first = day_first if day_first is not None else a > 12 or b <= 12
        day = dt.date(year, b, a) if first else dt.date(year, a, b)
    else:
        month = MONTHS.get(g["mn"].lower()) if g.get("mn") else int(g["mo"])
        if month is None:
            raise ValueError("no month")
        day = dt.date(year, month, int(g["d"]))
    if g.get("dow") and DAYS.get(g["dow"].lower(), day.weekday()) != day.weekday():
        raise ValueError("another day of the week")
    hour, minute, second = int(g["h"]), int(g.get("mi") or g.get("hmi") or 0), int(g.get("s") or g.get("hs") or 0)
    if g.get("ap"):
        if not 1 <= hour <= 12:
            raise ValueError("no such hour")
        hour = hour % 12 + (12 if g["ap"] in "pP" else 0)
    fraction = int(((g.get("f") or "") + "000000")[:6])
    clock = dt.datetime(day.year, day.month, day.day, hour, minute, second, fraction)
    local = (clock - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    if off := g.get("off"):
        digits = off[1:].replace(":", "").ljust(4, "0")
        hours, minutes = int(digits[:2]), int(digits[2:])
        if hours > 18 or minutes > 59:
            raise ValueError("no such offset")
        return local, (hours * 3600 + minutes * 60) * (-1 if off[0] == "-" else 1), None
    if g.get("z"):
        return local, 0, None
    name = g.get("in") or g.get("par") or g.get("word") or g.get("abbr")
    if name is None:
        return local, None, None
    if name.upper() in ("UTC", "GMT", "Z"):
        return local, 0, None
    if zone and name in (own := abbreviations(zone)):
        return local, own[name], None
    if "/" in name and name.lower() in _zones():
        return local, None, _zones()[name.lower()]
    raise ValueError("unknown zone")


def to_instant(local_us: Column, zone: Column) -> Column:
    """Microseconds UTC of a wall-clock time in a zone; null if it occurs twice or not at all. Independent of
    the session's zone, as the conversions take the microseconds for wall-clock time."""
    wall = F.timestamp_micros(local_us)
    there = F.to_utc_timestamp(wall, zone)
    at = F.unix_micros(there)
    twice = F.lit(False)
    for minutes in (-120, -60, -30, 30, 60, 120):
        twice = twice | (F.from_utc_timestamp(F.timestamp_micros(at + minutes * 60 * _US), zone) == wall)
    return F.when((F.from_utc_timestamp(there, zone) == wall) & ~twice, at)


def instant_text(us: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of microseconds UTC, fractions cut off; independent of the session's zone."""
    seconds = ((us - F.pmod(us, F.lit(_US))) / _US).cast("bigint")
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    left = F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit("T"), two(F.floor(left / 3600)), F.lit(":"), two(F.floor(F.pmod(left, F.lit(3600)) / 60)), F.lit(":"), two(F.pmod(left, F.lit(60))), F.lit("Z"))


def read_times(rows: DataFrame, id_col: str, text_col: str, place_col: str, ingested_col: str, places: DataFrame) -> DataFrame:
    """(id, place, ingested_us, declared, local_us, offset_s, stated_zone) of each row; nulls where unread.

    ``places`` (place_col, zone_name, day_first) is a small dimension (checked: at most ``MOST_PLACES`` rows); its zones go
    with the function. Of repeated places the least row counts.
    """
    listed = places.select(F.col(place_col).cast("string").alias("p"), "zone_name", "day_first").where("p IS NOT NULL").limit(MOST_PLACES + 1).collect()
    if len(listed) > MOST_PLACES:
        raise ValueError("the table of places is too large to send to every worker")
    listed.sort(key=lambda r: (r["p"], r["zone_name"] or "", bool(r["day_first"])), reverse=True)
    table = {r["p"]: (r["day_first"], _zones().get((r["zone_name"] or "").lower())) for r in listed}
    kind = rows.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text, place, us in zip(frame["id"], frame["text"], frame["place"], frame["us"]):
                day_first, zone = table.get(place, (None, None))
                got = read_timestamp(text, day_first, zone) or (None, None, None)
                out.append((key, place, us, zone, *got))
            done = pd.DataFrame(out, columns=["id", "place", "ingested_us", "declared", "local_us", "offset_s", "stated_zone"])
            yield done.astype({"id": frame["id"].dtype, "ingested_us": "Int64", "local_us": "Int64", "offset_s": "Int64"})

    us = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ingested_col}`)")
    picked = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(place_col).cast("string").alias("place"), us.alias("us"))
    return spread(picked, "id").mapInPandas(run, f"id {kind}, place string, ingested_us bigint, declared string, local_us bigint, offset_s bigint, stated_zone string")


class History:
    """An offset history: where wall-clock times change over (in seconds), the offsets between, the zones that have it."""

    def __init__(self, changes: list[tuple[int, int, int]], first: int, zones: list[str]) -> None:
        self.zones, self.offsets = zones, np.array([first, *(after for _, _, after in changes)], dtype=np.int64)
        self.until = np.array([at + max(before, after) for at, before, after in changes], dtype=np.int64)
        self.gaps = [(at + before, at + after) for at, before, after in changes if after > before]

    def instants(self, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(seconds UTC of wall-clock seconds, which of them the history skips); of times that occur twice the first."""
        skipped = np.zeros(len(local), dtype=bool)
        for start, end in self.gaps:
            skipped |= (local >= start) & (local < end)
        return local - self.offsets[np.searchsorted(self.until, local, side="right")], skipped


def histories(start: int, end: int, preferred: Sequence[str] = ()) -> list[History]:
    """Every different history of an IANA zone between two instants (seconds), ``preferred`` zones named first.

    A zone is looked at every week, and a change is found to the second; one that is taken back within the week isn't seen.
    """
    week, found = 7 * 86_400, {}
    points = [*range(max(start, 0) - week, min(end, 2**31) + 2 * week, week)]
    names = sorted((z for z in available_timezones() if "/" in z and not z.startswith(("Etc/", "SystemV/", "posix/", "right/")) or z == "UTC"), key=lambda z: (z not in preferred, z))
    for name in names:
        info = ZoneInfo(name)

        def offset(at: int, info: ZoneInfo = info) -> int:
            return int(dt.datetime.fromtimestamp(at, info).utcoffset().total_seconds())

        seen, changes = [offset(at) for at in points], []
        for a, b, x, y in zip(points, points[1:], seen, seen[1:]):
            if x != y:
                low, high = a, b
                while high - low > 1:
                    middle = (low + high) // 2
                    low, high = (middle, high) if offset(middle) == x else (low, middle)
                changes.append((high, x, offset(high)))
        found.setdefault((seen[0], tuple(changes)), []).append(name)
    return [History(list(changes), first, zones) for (first, changes), zones in found.items()]


def delay_class(seconds: np.ndarray) -> np.ndarray:
    """Class of delays that aren't negative: quarters of an hour, then doublings of half a day."""
    quarters = np.clip(seconds, 0, None) // QUARTER
    doubled = QUARTERS + np.log2(np.maximum(quarters, QUARTERS) / QUARTERS).astype(np.int64)
    return np.minimum(np.where(quarters < QUARTERS, quarters, doubled), QUARTERS + DOUBLINGS - 1)


def delay_costs(counts: dict[int, int]) -> np.ndarray:
    """Cost of each class of delay: minus the log of its density, from counts and an assumed shape (density 1 / delay)."""
    width = np.array([1.0] * QUARTERS + [QUARTERS * 2.0**k for k in range(DOUBLINGS)])
    middle = np.concatenate([np.arange(QUARTERS) + 0.5, QUARTERS * 1.5 * 2.0 ** np.arange(DOUBLINGS)])
    assumed = width / middle
    share = np.array([counts.get(k, 0) for k in range(len(width))]) + ASSUMED * assumed / assumed.sum()
    costs = -np.log(share / share.sum() / width)
    return costs - costs.min()


def zone_costs(read: DataFrame, known: list[History], costs: np.ndarray) -> DataFrame:
    """(place, declared, history, n, bad, cost): per place and history the zone-less rows, those that go against it, and the
    cost of all. Each batch of rows is summed before the shuffle."""
    bare = read.where("local_us IS NOT NULL AND offset_s IS NULL AND stated_zone IS NULL AND ingested_us IS NOT NULL AND place IS NOT NULL").select("place", "declared", "local_us", "ingested_us")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            codes, names = pd.factorize(frame["place"])
            zones = frame.groupby("place", sort=False)["declared"].first().reindex(names)
            local, ingested, out = frame["local_us"].to_numpy(dtype=np.int64) // _US, frame["ingested_us"].to_numpy(dtype=np.int64) // _US, []
            n = np.bincount(codes, minlength=len(names))
            for k, history in enumerate(known):
                at, skipped = history.instants(local)
                bad = skipped | (ingested < at)
                cost = np.where(bad, VIOLATION, costs[delay_class(ingested - at)])
                out.append(pd.DataFrame({"place": names, "declared": zones.to_numpy(), "history": k, "n": n, "bad": np.bincount(codes, weights=bad, minlength=len(names)).astype(np.int64), "cost": np.bincount(codes, weights=cost, minlength=len(names))}))
            yield pd.concat(out)

    summed = bare.mapInPandas(run, "place string, declared string, history int, n bigint, bad bigint, cost double")
    return summed.groupBy("place", "history").agg(F.max("declared").alias("declared"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.round(F.sum("cost"), 3).alias("cost"))


def choose_zones(read: DataFrame, places: DataFrame) -> DataFrame:
    """(place, declared, aligned_zone, zone, n, bad, margin): the zone of least cost by alignment alone, the one used, its
    violations among n zone-less rows, and how much more the best other history costs than the documented one (or than the
    best, where none is documented).

    ``read`` should be cut, as it is read three times. Of zones of one history, which can't be told apart, the documented
    one of the place stands, then one that any place is documented to use, then the first by name. A place of which no
    zone-less row is ingested at a known time has its documented zone.
    """
    spark = read.sparkSession
    bare = (F.col("local_us").isNotNull()) & F.col("offset_s").isNull() & F.col("stated_zone").isNull()
    facts = read.where(bare).agg(F.min("local_us").alias("start"), F.max("local_us").alias("end"), F.countDistinct("place").alias("places")).first()
    if facts["places"] > MOST_PLACES:
        raise ValueError("rows name more places than can be sent to every task")
    seconds = F.floor((F.col("ingested_us") - (F.col("local_us") - F.col("offset_s") * _US)) / _US)
    quarters = F.floor(seconds / QUARTER)
    klass = F.when(quarters < QUARTERS, quarters).otherwise(F.least(F.lit(QUARTERS + DOUBLINGS - 1), F.lit(QUARTERS) + F.floor(F.log2(quarters / QUARTERS))))
    delays = read.where("local_us IS NOT NULL AND offset_s IS NOT NULL AND ingested_us IS NOT NULL").where(seconds >= 0).groupBy(klass.cast("int").alias("k")).agg(F.count("*").alias("n"))
    costs = delay_costs({r["k"]: r["n"] for r in delays.collect()})
    documented = sorted({z for r in places.select("zone_name").distinct().limit(MOST_PLACES).collect() if (z := _zones().get((r["zone_name"] or "").lower()))})
    known = histories(facts["start"] // _US, facts["end"] // _US, documented) if facts["start"] is not None else []
    scores = zone_costs(read, known, costs)
    named = F.broadcast(spark.createDataFrame([(k, h.zones) for k, h in enumerate(known)], "history int, zones array<string>"))  # at most one per IANA zone
    own = F.array_contains("zones", F.col("declared"))
    held = scores.join(named, "history").withColumn("own", F.coalesce(own, F.lit(False))).withColumn("name", F.when(F.col("own"), F.col("declared")).otherwise(F.col("zones")[0]))
    entry = lambda cost: F.struct(cost.alias("cost"), (~F.col("own")).alias("other"), "name", "bad")
    picked = held.groupBy("place").agg(
        F.max("declared").alias("declared"), F.max("n").alias("n"), F.min(entry(F.col("cost"))).alias("aligned"), F.min(entry(F.when(F.col("own"), F.col("cost") - DOCUMENTED).otherwise(F.col("cost")))).alias("used"),
        F.min(F.when(F.col("own"), F.col("cost"))).alias("own_cost"), F.min(F.when(~F.col("own"), F.col("cost"))).alias("other_cost"), F.sort_array(F.collect_list("cost")).alias("all"),
    )
    margin = F.round(F.when(F.col("own_cost").isNotNull(), F.col("other_cost") - F.col("own_cost")).otherwise(F.get(F.col("all"), F.lit(1)) - F.get(F.col("all"), F.lit(0))), 3)
    return picked.select("place", "declared", F.col("aligned.name").alias("aligned_zone"), F.col("used.name").alias("zone"), "n", F.col("used.bad").alias("bad"), margin.alias("margin"))


def normalise_timestamps(rows: DataFrame, places: DataFrame, id_col: str, text_col: str, place_col: str, ingested_col: str) -> tuple[DataFrame, DataFrame]:
    """((id_col, instant_utc) of each row whose text denotes exactly one instant, the zones used).

    Null, blank and unreadable texts, texts without a time of day and impossible or ambiguous times give no row;
    rows that repeat an id with the same instant give one. A place that isn't in ``places`` gets an estimated
    zone, and its ambiguous numeric dates aren't read; rows without a place and a zone have no instant.
    """
    read = cut(read_times(rows, id_col, text_col, place_col, ingested_col, places))
    chosen = choose_zones(read, places)
    small = F.broadcast(chosen.select("place", "zone"))  # at most MOST_PLACES rows: checked
    placed = read.where("local_us IS NOT NULL").join(small, "place", "left")
    at = F.when(F.col("offset_s").isNotNull(), F.col("local_us") - F.col("offset_s") * _US).otherwise(to_instant(F.col("local_us"), F.coalesce("stated_zone", "zone", "declared")))
    found = placed.select(F.col("id").alias(id_col), at.alias("us")).where("us IS NOT NULL")
    return found.select(id_col, instant_text(F.col("us")).alias("instant_utc")).distinct(), chosen
