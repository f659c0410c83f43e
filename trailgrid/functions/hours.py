"""Opening hours: the text as open minutes of the week, and whether a visit fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrid import constants as K

DAYS = ("mo", "tu", "we", "th", "fr", "sa", "su")
_DAY, _TIME = f"(?:{'|'.join(DAYS)})", r"\d{1,2}:\d{2}"
#: The grammar's words: a day or range of days, a shift that ends its list entry, a closing word.
TOKEN = rf"{_DAY}(?:\s*-\s*{_DAY})?|(?<=^|[,\sa-z]){_TIME}\s*-\s*{_TIME}(?=\s*(?:,|$))|(?:off|closed)$"
EVERY_DAY = 2 ** len(DAYS) - 1


def _day_bits(token: Column) -> Column:
    """The days of a token as bits, Monday the lowest; a range may run over the week's end."""
    bit = F.create_map(*[F.lit(x) for n, d in enumerate(DAYS) for x in (d, 2 ** n)])
    first, last = bit[F.left(token, F.lit(2))], bit[F.right(token, F.lit(2))]
    through = 2 * last - first
    return F.when(last >= first, through).otherwise(EVERY_DAY + through)


def _shift(token: Column) -> Column:
    """struct(opens, closes) minutes of a shift, past midnight after 1440; null where no clock shows them."""
    n = F.transform(F.regexp_extract_all(token, F.lit(r"(\d+)")), lambda x: x.cast("int"))
    opens, closes = 60 * n[0] + n[1], 60 * n[2] + n[3]
    shown = (F.greatest(n[0], n[2]) <= 24) & (F.greatest(n[1], n[3]) <= 59) & (opens != closes)
    return F.when(shown, F.struct(opens.alias("opens"), (closes + F.when(closes < opens, K.DAY_MIN).otherwise(0)).alias("closes")))


def read_rules(texts: DataFrame, column: str) -> DataFrame:
    """(column, n, days, shifts): every readable rule of each text, ``days`` as bits, no shifts for closed.

    A rule is cut into tokens in one pass. It is readable if nothing but separators stands between
    them ahead of its first time, and if it has a shift or ends in a closing word; a rule without
    days is for all of them.
    """
    entry = rf";|,(?=\s*{_DAY}\b)"
    plain = F.trim(F.lower(F.translate(F.col(column), K.DASHES, "-" * len(K.DASHES))))
    rules = texts.select(column, F.posexplode(F.split(plain, entry)).alias("n", "rule")).withColumn("rule", F.regexp_replace("rule", r"^\s+|\s+$", ""))
    tokens = rules.withColumn("tokens", F.regexp_extract_all("rule", F.lit(TOKEN), F.lit(0)))
    named = F.filter("tokens", lambda t: F.substring(t, 1, 2).isin(*DAYS))
    timed = F.filter(F.transform(F.filter("tokens", lambda t: t.rlike(r"^\d")), _shift), lambda s: s.isNotNull())
    ahead = F.regexp_replace(F.regexp_replace("rule", rf"{_TIME}.*$|(off|closed)$", ""), rf"{_DAY}(\s*-\s*{_DAY})?(?![a-z])|[,\s]", "")
    closed = F.element_at("tokens", -1).isin("off", "closed") & ~F.rlike("rule", F.lit(_TIME))
    bits = F.when(F.size(named) == 0, EVERY_DAY).otherwise(F.aggregate(named, F.lit(0), lambda acc, t: acc.bitwiseOR(_day_bits(t))))
    return tokens.where("size(tokens) > 0").where((ahead == "") & ((F.size(timed) > 0) | closed)).select(
        column, "n", bits.alias("days"), timed.alias("shifts")
    )


def parse_hours(texts: DataFrame, column: str = "opening_hours") -> DataFrame:
    """Distinct texts with ``open``: sorted array of struct(opens, closes) minutes of the week.

    Later rules replace the days of earlier ones, unreadable rules are skipped, and a text
    without a readable rule has a null ``open``: nobody knows.
    """
    distinct = texts.select(column).where(F.col(column).isNotNull()).distinct()
    by_day = (
        read_rules(distinct, column).withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(len(DAYS) - 1))))
        .where(F.getbit(F.col("days"), F.col("day")) == 1)
        .groupBy(column, "day").agg(F.max_by("shifts", "n").alias("shifts"))
    )
    moved = F.transform("shifts", lambda s: F.struct(*[(F.col("day") * K.DAY_MIN + s[x]).alias(x) for x in ("opens", "closes")]))
    weeks = by_day.groupBy(column).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(moved)))).alias("week"))
    always = F.array(F.struct(F.lit(0).alias("opens"), F.lit(K.WEEK_MIN).alias("closes")))
    plain = F.trim(F.lower(F.translate(F.col(column), K.DASHES, "-" * len(K.DASHES))))
    return distinct.join(weeks, column, "left").select(column, F.when(plain.isin(*K.ALWAYS_OPEN), always).otherwise(F.col("week")).alias("open"))


def with_hours(rows: DataFrame, column: str = "opening_hours", *, runs: bool = False) -> DataFrame:
    """``rows`` with the parsed ``open`` array of their text; each distinct text is read once.

    With ``runs`` the array is also merged once per text, as ``merge_runs`` does it, into ``runs``. Rows
    without a text, usually the most, are not joined: they would all be one key.
    """
    parsed = parse_hours(rows, column)
    if runs:
        parsed = parsed.withColumn("runs", merge_runs(F.col("open")))
    told = [c for c in parsed.columns if c != column]
    known = rows.where(F.col(column).isNotNull()).join(parsed, column, "left").select(*rows.columns, *told)
    absent = {c: F.lit(None).cast(parsed.schema[c].dataType) for c in told}
    return known.unionByName(rows.where(F.col(column).isNull()).withColumns(absent))


def merge_runs(intervals: Column) -> Column:
    """Overlapping or touching open intervals joined, the week repeated once for wrap-around."""
    moved = F.sort_array(F.concat(
        F.transform(intervals, lambda s: F.struct(s["opens"].alias("opens"), s["closes"].alias("closes"))),
        F.transform(intervals, lambda s: F.struct((s["opens"] + K.WEEK_MIN).alias("opens"), (s["closes"] + K.WEEK_MIN).alias("closes"))),
        F.transform(
            F.filter(intervals, lambda s: s["closes"] > K.WEEK_MIN),
            lambda s: F.struct(F.lit(0).alias("opens"), (s["closes"] - K.WEEK_MIN).alias("closes")),
        ),
    ))
    return F.aggregate(
        moved,
        F.array().cast("array<struct<opens:int,closes:int>>"),
        lambda done, s: F.when(
            F.coalesce(F.try_element_at(done, F.lit(-1))["closes"] >= s["opens"], F.lit(False)),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(
                    F.try_element_at(done, F.lit(-1))["opens"].alias("opens"),
                    F.greatest(F.try_element_at(done, F.lit(-1))["closes"], s["closes"]).alias("closes"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["opens"].alias("opens"), s["closes"].alias("closes"))))),
    )


def visit_state(open_: Column, start: Column, stop: Column, runs: Column | None = None) -> Column:
    """abierto when the whole visit lies in open time, cerrado when not, desconocido without hours.

    ``start`` and ``stop`` are minutes of the week; ``open_`` comes from ``parse_hours``, ``runs`` is its
    ``merge_runs`` if that is known already.
    """
    covered = F.exists(merge_runs(open_) if runs is None else runs, lambda s: (s["opens"] <= start) & (s["closes"] >= stop))
    known = open_.isNotNull() & start.isNotNull()
    return F.when(~known, "desconocido").when((F.size(open_) > 0) & covered, "abierto").otherwise("cerrado")
