"""Dates written out in several languages, and in the usual orders of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The months' names by language, in order; the first three letters and those listed are short forms.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
}
SHORT = {"en": {"sept": 9}, "de": {"jän": 1, "jänner": 1, "maerz": 3, "sept": 9}, "fr": {"janv": 1, "fevrier": 2, "févr": 2, "avr": 4, "juil": 7, "aout": 8, "sept": 9, "decembre": 12}, "es": {"setiembre": 9, "sept": 9}, "it": {"sett": 9}, "nl": {"mrt": 3, "sept": 9}}


def month_numbers(languages: tuple[str, ...]) -> dict[str, int]:
    """The number of each name and short form; a form of two months in the languages given goes to the first language."""
    out: dict[str, int] = {}
    for language in languages:
        names = MONTHS[language].split()
        forms = {n: i for i, n in enumerate(names, 1)} | SHORT[language]
        starts = [n[:3] for n in names]
        forms |= {s: i for i, s in enumerate(starts, 1) if starts.count(s) == 1}
        for form, number in forms.items():
            out.setdefault(form, number)
    return out


def free_date(text: Column, languages: tuple[str, ...] = ("en", "de", "fr", "es", "it", "nl"), day_first: bool = False) -> Column:
    """The first date that a text names, null if none is whole and in the calendar.

    Read are 2021-03-05 (also with / or .), 5.3.2021, 3/5/2021 (month first unless
    `day_first`, or unless the month would be over twelve), and with the month's name
    5 March 2021, 5. März 2021, 1er mars 2021, 5 de marzo de 2021, March 5th, 2021.
    """
    low = F.lower(text)
    number = F.create_map(*[F.lit(x) for kv in month_numbers(languages).items() for x in kv])
    part = lambda p, i: F.regexp_extract(low, p, i)

    def made(fits: str, year: Column, month: Column, day: Column) -> Column:
        joined = F.concat_ws("-", year, month.cast("int").cast("string"), day.cast("int").cast("string"))
        return F.when(low.rlike(fits) & month.isNotNull(), F.try_to_date(joined, "y-M-d"))

    iso, dotted, slashed = r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)", r"(?<!\d)(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})(?!\d)", r"(?<!\d)(\d{1,2})[-/](\d{1,2})[-/](\d{4})(?!\d)"
    named = r"(?<!\d)(\d{1,2})(?:st|nd|rd|th|er|º|°|\.)?\s*(?:of\s+|de\s+)?(?<![\p{L}])([\p{L}]{3,})\.?,?\s+(?:de\s+|del\s+)?(\d{4})(?!\d)"
    leading = r"(?<![\p{L}])([\p{L}]{3,})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?!\d)"
    one, two = F.nullif(part(slashed, 1), F.lit("")).cast("int"), F.nullif(part(slashed, 2), F.lit("")).cast("int")
    swap = (two <= 12) if day_first else (one > 12)
    whole = lambda p, i: F.nullif(part(p, i), F.lit(""))
    return F.coalesce(
        made(iso, part(iso, 1), whole(iso, 2), whole(iso, 3)), made(dotted, part(dotted, 3), whole(dotted, 2), whole(dotted, 1)),
        made(slashed, part(slashed, 3), F.when(swap, two).otherwise(one), F.when(swap, one).otherwise(two)),
        made(named, part(named, 3), F.try_element_at(number, part(named, 2)), whole(named, 1)), made(leading, part(leading, 3), F.try_element_at(number, part(leading, 1)), whole(leading, 2)),
    )


_NAMES = {language: MONTHS[language].split() for language in MONTHS}


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' days, written in ten ways, in four languages and as numbers."""
    name = lambda language: f"element_at(array({', '.join(repr(n) for n in _NAMES[language])}), m)"
    ways = [
        "concat('issued ', y, '-', m, '-', d)", "concat(m, '/', d, '/', y)", "concat(d, '.', m, '.', y)", f"concat(d, ' ', initcap({name('en')}), ' ', y)",
        f"concat(upper({name('en')}), ' ', d, 'th, ', y)", f"concat('am ', d, '. ', {name('de')}, ' ', y)", f"concat('le ', d, 'er ', {name('fr')}, ' ', y)",
        f"concat(d, ' de ', {name('es')}, ' de ', y)", f"concat(substr({name('en')}, 1, 3), '. ', d, ', ', y)", f"concat(d, ' brumaire ', y, ' or 31 {_NAMES['en'][1]} ', y)",
    ]
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey k", "year(o_orderdate) y", "month(o_orderdate) m", "day(o_orderdate) d")
    text = F.expr("CASE k % 10 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(ways)) + " END")
    return o.select("k", free_date(text).alias("day"))


QUERIES = {"written_dates": written_dates}
ORACLE_SQL = {"written_dates": "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 < 9 THEN o_orderdate::DATE END AS day FROM orders"}
