"""Names: folding, trigrams, display forms, labels and phrases as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions.geo import literal_map


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _latin_marks() -> tuple[str, str]:
    """Accented Latin letters and their plain letters, by Unicode decomposition."""
    marked, plain = [], []
    for code in (*range(0xAA, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalnum():
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _latin_marks()


def fold(text) -> Column:
    """Lower case through the short accent map used to compare names."""
    return F.translate(F.lower(_c(text)), K.ACCENTED, K.UNACCENTED)


def without_marks(text) -> Column:
    """Lower case without diacritics; punctuation stays."""
    bare = F.regexp_replace(F.translate(_c(text), _MARKED, _PLAIN), r"\p{M}+", "")
    return F.lower(bare)


def collapse(text) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def normalise(text) -> Column:
    """Letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(without_marks(text), r"[^a-z0-9]+", " "))


def plain_phrase(text) -> Column:
    """No diacritics, no capitals, single spaces."""
    return collapse(without_marks(text))


def significant_words(text) -> Column:
    """The set of words of a name without articles and prepositions."""
    words = F.split(F.trim(F.regexp_replace(without_marks(text), r"[^\p{L}\p{N}]+", " ")), " ")
    empty = F.array(F.lit(""), *[F.lit(w) for w in K.EMPTY_WORDS])
    return F.array_except(words, empty)


def trigrams(text) -> Column:
    """Trigrams of every word, in order: two blanks before each word and one after."""
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(0))
    return F.flatten(
        F.transform(
            words,
            lambda w: F.transform(
                F.sequence(F.lit(1), F.length(w) + 1),
                lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
            ),
        )
    )


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of two trigram arrays; 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), F.nullif(either, F.lit(0))), F.lit(0.0))


def shared_positions(wanted: Column, target: Column) -> Column:
    """Positions of ``target`` that hold a trigram of ``wanted``."""
    return F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(target), F.lit(1))),
        lambda i: F.array_contains(wanted, F.try_element_at(target, i)),
    )


def fit(wanted: Column, target: Column, positions: Column) -> Column:
    """Best Jaccard of the distinct trigrams ``wanted`` with a contiguous run of ``target``.

    Only runs that start and end on a shared trigram can be best, so only those are tried.
    Give the three as columns of their own: a lambda evaluates its outer expressions each time.
    """

    def score(start: Column, stop: Column) -> Column:
        run = F.slice(target, start, stop - start + 1)
        shared = F.size(F.array_intersect(wanted, run))
        return shared.cast("double") / F.size(F.array_union(wanted, run))

    best = F.array_max(
        F.transform(
            positions,
            lambda a: F.array_max(F.transform(F.filter(positions, lambda b: b >= a), lambda b: score(a, b))),
        )
    )
    return F.coalesce(best, F.lit(0.0))


def with_scores(pairs: DataFrame, asked: str, name: str, *, with_fit: bool, at_least: float = 0.0) -> DataFrame:
    """``similarity`` (and ``fit``) of two text columns, in six decimals.

    Pairs that share too few of the asked trigrams to reach ``at_least`` on either score are
    dropped before anything is scored.
    """
    scored = pairs.withColumns({"_a": F.array_distinct(trigrams(asked)), "_b": trigrams(name)})
    if at_least > 0:
        needed = F.ceil(F.size("_a") * at_least - 1e-5)
        scored = scored.where(F.size(F.array_intersect("_a", "_b")) >= needed)
    scored = scored.withColumn("similarity", F.round(similarity(F.col("_a"), F.col("_b")), 6))
    if with_fit:
        scored = scored.withColumn("_at", shared_positions(F.col("_a"), F.col("_b")))
        scored = scored.withColumn("fit", F.round(fit(F.col("_a"), F.col("_b"), F.col("_at")), 6))
    return scored.drop("_a", "_b", "_at")


def display_name(name) -> Column:
    """A name as it is shown: no stray blanks or closing punctuation, no shouting."""
    name = _c(name)
    clean = F.regexp_replace(collapse(name), r"[.,;:]+$", "")
    words = F.split(clean, " ")

    def calm(word: Column, i: Column) -> Column:
        acronym = word.rlike(r"^\p{L}{2,3}$") & ~word.rlike("[AEIOU]")
        capital = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1_000)))
        return (
            F.when((i > 0) & F.lower(word).isin(*K.CONNECTORS), F.lower(word))
            .when((i > 0) & acronym, word)
            .otherwise(capital)
        )

    shouted = (F.size(words) > 1) & (clean == F.upper(clean))
    shown = F.when(shouted, F.array_join(F.transform(words, calm), " ")).otherwise(clean)
    return F.coalesce(F.nullif(shown, F.lit("")), name)


def is_vague_name(name) -> Column:
    """A generic word and a number of one or two digits."""
    words = F.split(F.lower(collapse(name)), " ")
    return (
        (F.size(words) == 2)
        & F.try_element_at(words, F.lit(1)).isin(*K.GENERIC_HEADS)
        & F.coalesce(F.try_element_at(words, F.lit(2)).rlike(r"^\d{1,2}$"), F.lit(False))
    )


def same_site_key(name, same_place_as) -> Column:
    group = _c(same_place_as).cast("string")
    return F.coalesce(F.concat(F.lit("grupo:"), group), F.lower(collapse(name)))


def _cuisine_parts(raw) -> Column:
    parts = F.split(F.replace(_c(raw), F.lit(","), F.lit(";")), ";")
    return F.transform(parts, lambda p: F.replace(F.lower(F.trim(p)), F.lit(" "), F.lit("_")))


def cuisine_label(raw, preferred: Column | None = None) -> Column:
    """One readable label: the preferred cuisine if served, the first specific, else a generic one."""
    parts = _cuisine_parts(raw)
    labels = literal_map(K.CUISINES)
    specific = [c for c in K.CUISINES if c not in K.GENERIC_CUISINES]
    chosen = [
        F.try_element_at(F.filter(parts, lambda p: p.isin(*specific)), F.lit(1)),
        F.try_element_at(F.filter(parts, lambda p: p.isin(*K.GENERIC_CUISINES)), F.lit(1)),
    ]
    if preferred is not None:
        served = F.array_contains(parts, preferred) & preferred.isin(*K.CUISINES)
        chosen.insert(0, F.when(served, preferred))
    key = F.coalesce(*chosen)
    return F.when(key.isNotNull(), F.try_element_at(labels, key))


def serves_cuisine(raw, wanted: Column) -> Column:
    return F.coalesce(F.array_contains(_cuisine_parts(raw), wanted), F.lit(False))


def contact(value, prefixed, *, phone: bool) -> Column:
    """The first of the listed phones or sites, with or without the contact: prefix."""
    raw = F.coalesce(F.nullif(_c(value), F.lit("")), F.nullif(_c(prefixed), F.lit("")))
    if phone:
        raw = F.replace(raw, F.lit(","), F.lit(";"))
    return F.nullif(F.trim(F.element_at(F.split(raw, ";"), 1)), F.lit(""))


def elevation_m(raw) -> Column:
    number = F.trim(F.regexp_replace(F.lower(F.trim(_c(raw))), "m$", ""))
    metres = F.bround(F.replace(number, F.lit(","), F.lit(".")).try_cast("double"), 0)
    return F.when(metres.between(0, K.MAX_ELEVATION_M), metres.cast("int"))


def list_phrase(items: Column) -> Column:
    """a / a y b / a, b y c."""
    n = F.size(items)
    many = F.concat(
        F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" y "), F.try_element_at(items, F.lit(-1))
    )
    return F.when(n == 1, F.try_element_at(items, F.lit(1))).when(n > 1, many)


def hour_phrases(runs: Column) -> Column:
    """Runs of hours (struct first, last) in words."""

    def clock(hour: Column) -> Column:
        return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))

    def words(run: Column) -> Column:
        first, last = run["first"], run["last"]
        return (
            F.when(first == last, F.concat(F.lit("a las "), clock(first)))
            .when(last >= 23, F.concat(F.lit("desde las "), clock(first)))
            .otherwise(F.concat(F.lit("de "), clock(first), F.lit(" a "), clock(last + 1)))
        )

    return list_phrase(F.transform(runs, words))


def date_words(date) -> Column:
    """weekday day de month."""
    date = _c(date)
    weekday = F.element_at(F.array(*[F.lit(w) for w in K.WEEKDAYS_ES]), F.weekday(date) + 1)
    month = F.element_at(F.array(*[F.lit(m) for m in K.MONTHS_ES]), F.month(date))
    return F.concat(weekday, F.lit(" "), F.dayofmonth(date).cast("string"), F.lit(" de "), month)


def zone_of(phrase) -> Column:
    """struct(zone_order, zone, zone_name) named by a ``plain_phrase`` column.

    Words that mean a zone only on their own come first; otherwise the longest name or alias
    found inside the phrase, earlier zones first.
    """
    phrase = _c(phrase)
    options = []
    for order, (_, name, _, _, _, aliases, whole) in enumerate(K.ZONES):
        key = K.ZONES[order][0]
        options += [F.when(phrase == alias, _zone_rank(0, 0, order)) for alias in whole]
        options += [
            F.when(F.contains(phrase, F.lit(alias)), _zone_rank(1, -len(alias), order))
            for alias in dict.fromkeys((name.lower(), key.replace("-", " "), *aliases))
        ]
    zones = F.array(
        *[
            F.struct(F.lit(i).alias("zone_order"), F.lit(z[0]).alias("zone"), F.lit(z[1]).alias("zone_name"))
            for i, z in enumerate(K.ZONES)
        ]
    )
    return F.try_element_at(zones, F.least(*options)["zone_order"] + 1)


def _zone_rank(kind: int, length: int, order: int) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(length).alias("length"), F.lit(order).alias("zone_order"))


def without_zone(base) -> Column:
    """A ``without_marks`` column less the longest zone name in it, if four letters or more stay."""
    base = _c(base)
    options = []
    for name in sorted((z[1].lower() for z in K.ZONES), key=len, reverse=True):
        rest = F.regexp_replace(F.replace(base, F.lit(name), F.lit(" ")), r"\s+", " ")
        rest = F.trim(F.regexp_replace(rest, r"^[ ,.\-]+|[ ,.\-]+$", ""))
        found = F.contains(base, F.lit(name)) & (F.length(base) > len(name) + 2) & (F.length(rest) >= 4)
        options.append(F.when(found, rest))
    return F.coalesce(*options)
