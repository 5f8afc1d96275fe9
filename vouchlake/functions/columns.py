"""Column functions: keys, links, versions, levels, platform names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest16(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def sanitize_link(link: Column) -> Column:
    """Default port away, spaces encoded, https throughout; empty is null."""
    return F.nullif(F.regexp_replace(F.replace(F.replace(link, F.lit(":443"), F.lit("")), F.lit(" "), F.lit("%20")), "^http://", "https://"), F.lit(""))


def plain_name(text: Column) -> Column:
    """Lower case without trademark signs; other characters become spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[®™]", ""), "[^a-zA-Z0-9 \\n.]", " "))


def versions(name: Column) -> Column:
    """Dotted numbers anywhere in a name, each once in order; else its whole integers; else '-'."""
    found = lambda p: F.array_distinct(F.regexp_extract_all(name, F.lit(p), F.lit(1)))
    dotted, bare = found(r"(\d{1,5}(?:\.\d{1,5})+)"), found(r"\b(\d+)\b")
    return F.when(F.size(dotted) > 0, dotted).when(F.size(bare) > 0, bare).otherwise(F.array(F.lit("-")))


def lowest_level(levels: Column) -> Column:
    """Lowest assurance level named in an array's strings: by number, then without plus; null if none."""
    named = F.filter(F.transform(levels, lambda s: F.regexp_extract(s, r"(EAL\d+\+?)", 1)), lambda s: s != "")
    ranked = F.transform(named, lambda s: F.struct(F.regexp_extract(s, r"(\d+)", 1).cast("int").alias("n"), s.endswith("+").alias("plus"), s.alias("s")))
    return F.array_min(ranked)["s"]


def cpe_part(uri: Column, at: int) -> Column:
    """Part `at` of a CPE 2.3 name; escaped colons do not separate, escaped backslashes do not escape."""
    parts = F.regexp_extract_all(uri, F.lit(r"(?:^|:)((?:\\.|[^:\\])*)"), F.lit(1))
    return F.regexp_replace(F.get(parts, F.lit(at)), r"\\(.)", "$1")


def cpe_name(uri: Column, at: int) -> Column:
    """Vendor (3) or item (4) in plain words."""
    return F.replace(cpe_part(uri, at), F.lit("_"), F.lit(" "))


def cpe_version(uri: Column) -> Column:
    v = cpe_part(uri, 5)
    return F.when(v.isin("", "*"), "-").otherwise(v)


def pdf_date(text: Column) -> Column:
    """`D:YYYYMMDDHHMMSS+HH'MM'` as a UTC timestamp; missing parts count as the least."""
    p = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:Z|([+-])(\d{2})'?(\d{2})?'?)?"
    g = lambda i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    part = lambda i, least: F.coalesce(g(i), F.lit(least))
    stamp = F.concat(g(1), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit(" "), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), part(7, "+"), part(8, "00"), F.lit(":"), part(9, "00"))
    return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ssXXX"))


def plain_contact(text: Column) -> Column:
    """A mail address with `[at]` and `[dot]` (any brackets or spaces) made plain."""
    at = F.regexp_replace(text, r"(?i)\s*[\[({<]\s*at\s*[\])}>]\s*", "@")
    return F.regexp_replace(at, r"(?i)\s*[\[({<]\s*dot\s*[\])}>]\s*", ".")


def type_and_number(text: Column) -> Column:
    """Algorithm name and number, as in `AES 123`; null where either is missing."""
    p = r"^\s*(\D*[A-Za-z]\D*?)[\s#]*(\d+)\s*$"
    return F.when(text.rlike(p), F.struct(F.trim(F.regexp_extract(text, p, 1)).alias("type"), F.regexp_extract(text, p, 2).alias("number")))


def valid_until(issued: Column, years: int = 5) -> Column:
    return F.add_months(issued, 12 * years)


def softmax(scores: Column) -> Column:
    """Softmax of an array, steady for large scores."""
    e = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


#: Platforms and their patterns.
PLATFORMS = {"linux": r"(?i)linux", "mac_os": r"(?i)mac\s?os\s?x?", "windows": r"(?i)windows", "android": r"(?i)android", "ios": r"(?i)(ios|iphone os)"}


def platforms(text: Column) -> Column:
    """The platforms a text names."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in PLATFORMS.items()]))


def platform_fits(title: Column, hardware: Column, entry_title: Column) -> Column:
    """Whether a dictionary entry (its hardware and title) can belong to a product's title.

    Free hardware (`*`) fits a title without platforms, and one with platforms if the
    entry's title names one of them; bound hardware needs a title with platforms, one of
    them named by the entry, and none other as the hardware.
    """
    wanted = platforms(title)
    some, named = F.size(wanted) > 0, F.coalesce(entry_title, F.lit(""))
    bound = platforms(hardware)
    hit = F.arrays_overlap(wanted, platforms(F.concat(hardware, named)))
    return F.when(hardware == "*", ~some | F.arrays_overlap(wanted, platforms(named))).otherwise(some & hit & ((F.size(bound) == 0) | F.array_contains(wanted, F.get(bound, F.lit(0)))))


def version_fits(entry_version: Column, wanted: Column) -> Column:
    """Whether a dictionary version belongs to one of a product's versions (an array).

    One starts the other, not in the middle of a number; a wanted version of three or
    more characters asks for as many; where it starts the entry's, that must be dotted.
    """
    begins = lambda x, y: (x == y) | (y.startswith(x) & ~F.substr(y, F.length(x) + 1, F.lit(1)).rlike("[0-9]"))
    dotted, long = entry_version.rlike(r"\d\.\d"), F.length(entry_version) >= 3
    short_only = (F.size(wanted) == 1) & (F.length(F.get(wanted, F.lit(0))) >= 3) & ~long
    fits = F.exists(wanted, lambda v: ((begins(v, entry_version) & dotted) | begins(entry_version, v)) & ((F.length(v) < 3) | long))
    return F.coalesce((entry_version != "") & ~short_only & fits, F.lit(False))


def service_pack(text: Column) -> Column:
    """Least number of a `sp` or `service pack` mention; null if none."""
    return _least(text, r"(?i)(?:sp|service pack)\s?(\d{1,2})")


def release(text: Column) -> Column:
    """Least number of an `r` or `release` mention; null if none."""
    return _least(text, r"(?i)(?:r|release)\s?(\d{1,2})")


def _least(text: Column, pattern: str) -> Column:
    return F.array_min(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: n.cast("int")))


def vendor_candidates(maker: Column) -> Column:
    """Names under which a dictionary may list a maker, from its lower-case name.

    Parts between commas and slashes each give themselves, their first word, their
    first two words joined and known aliases; a leading `the` is passed over.
    """
    #: Words of a maker's name and what the dictionary calls it.
    aliases = {"hewlett": ["hp"], "hewlett-packard": ["hp"], "thales": ["thalesesecurity", "thalesgroup"], "stmicroelectronics": ["st"]}

    def of(part: Column) -> Column:
        words = F.split(part, r"\s+")
        first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
        known = [F.when(F.array_contains(words, w), F.array(*map(F.lit, names))) for w, names in aliases.items()]
        known.append(F.when(F.array_contains(words, "athena") & F.array_contains(words, "smartcard"), F.array(F.lit("athena-scs"))))
        return F.flatten(F.array_compact(F.array(F.array_compact(F.array(part, first, F.concat(first, second))), *known)))

    parts = F.transform(F.split(maker, "[,/]"), lambda p: F.regexp_replace(F.trim(p), r"^the\s+", ""))
    return F.array_distinct(F.flatten(F.transform(F.filter(parts, lambda p: p != ""), of)))


def html_plain(text: Column) -> Column:
    """Soft hyphens away, hard and repeated spaces to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\u00ad", ""), "[\\s\u00a0]+", " "))


def match_plain(text: Column) -> Column:
    """A keyword match without trailing separators, double spaces and unprintable characters."""
    body = F.regexp_replace(F.trim(F.regexp_replace(text, r"[\]\[,;\"\"')(.]+$", "")), "  ", " ")
    return F.regexp_replace(body, r"[\p{C}\p{Zl}\p{Zp}]", "")


def fips_vendor(text: Column) -> Column:
    """The first four words, without marks and commas, dashes and plus signs as spaces."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(text, r"\(R\)|,|®", ""), r"[-+\s]+", " ")), " ")
    return F.array_join(F.slice(words, 1, 4), " ")


def only_words(text: Column, keywords: list[str]) -> Column:
    """The words of a text that are keywords, whatever their case, in order."""
    return F.array_join(F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.lower(w).isin(*keywords)), " ")


def archived_on(valid_from: Column, valid_to: Column, days: int = 1827, first: str = "2019-06-01") -> Column:
    """Day of archival: the end of validity, capped at `days` from its start, not before `first`."""
    return F.when(F.datediff(valid_to, valid_from) > days, F.greatest(F.lit(first).cast("date"), F.date_add(valid_from, days))).otherwise(valid_to)


def validity_years(valid_from: Column, valid_to: Column) -> Column:
    return F.datediff(valid_to, valid_from) / 365


def status_line(text: Column) -> Column:
    """(status, since) of a queue line such as `In Review  (5/3/2021)`."""
    p = r"^\s*(.*?)\s*\((\d{1,2}/\d{1,2}/\d{4})\)\s*$"
    return F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("status"), F.try_to_date(F.regexp_extract(text, p, 2), "M/d/yyyy").alias("since"))).otherwise(
        F.struct(F.trim(text).alias("status"), F.lit(None).cast("date").alias("since"))
    )


def parsed_date(text: Column, *formats: str) -> Column:
    """The date by the first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_date(text, f) for f in formats or ("yyyy-MM-dd", "MM/dd/yyyy")])


#: Phrases of composite evaluations.
COMPOSITE = (
    "composite product evaluation",
    "L’évaluation en composition",
    "Composite product evaluation for Smart Cards and similar devices",
    r"\[COMP\]",
    "is the composite product",
    "valuation en composition",
)


def is_composite(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(COMPOSITE)), F.lit(False))


def assurance(text: Column) -> Column:
    """(family, level) of an assurance requirement such as `ALC_FLR.2`; null if there is no level."""
    #: Assurance classes.
    p = r"^((?:APE|ACE|ASE|ADV|AGD|ALC|ATE|AVA|ACO)(?:_[A-Z]{3,4}){1,2})\.([0-9])"
    return F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("family"), F.regexp_extract(text, p, 2).cast("int").alias("level")))


def one_spaced(text: Column) -> Column:
    """Line ends and runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_maker_and_version(name: Column, makers: Column, found: Column) -> Column:
    """A plain name without its makers and versions (arrays of plain strings), in that order."""
    gone = F.concat(F.coalesce(makers, F.array()), F.coalesce(found, F.array()))
    return F.trim(F.aggregate(gone, name, lambda text, part: F.when(part == "", text).otherwise(F.replace(text, part, F.lit("")))))


def level_package(text: Column) -> Column:
    """(level, augmented_by) of a package such as `EAL4 augmented by ALC_FLR.2 and AVA_VAN.5`."""
    level = F.nullif(F.regexp_extract(text, r"(EAL\s?[1-7]\+?)", 1), F.lit(""))
    parts = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Z]{3}_[A-Z]{3}\.[0-9])"), F.lit(1)))
    return F.when(level.isNotNull(), F.struct(F.replace(level, F.lit(" "), F.lit("")).alias("level"), parts.alias("augmented_by")))


def named_host(link: Column, address: str, host: str) -> Column:
    """A link whose host is the bare address, with the host's name."""
    return F.when(F.parse_url(link, F.lit("HOST")) == address, F.replace(link, F.lit(f"//{address}"), F.lit(f"//{host}"))).otherwise(link)


def expanded(text: Column, acronyms: dict[str, str]) -> Column:
    """Whole-word acronyms written out; the longer ones first."""
    for short, full in sorted(acronyms.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        text = F.regexp_replace(text, rf"\b\Q{short}\E\b", full.replace("\\", r"\\").replace("$", r"\$"))
    return text


def cited(text: Column, ids: Column) -> Column:
    """Citations `[n]` as the n-th of the ids (an array), where there is one."""
    numbered = F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda name, i: F.struct(F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]")).alias("mark"), name.alias("name")))
    return F.aggregate(numbered, text, lambda t, c: F.replace(t, c["mark"], c["name"]))


def long_sentences(sentences: Column, keywords: Column, more: int = 20) -> Column:
    """The sentences at least `more` characters longer than the shortest keyword."""
    least = F.array_min(F.transform(keywords, lambda k: F.length(k))) + more
    return F.filter(sentences, lambda s: F.length(s) >= least)


def module_type(text: Column) -> Column:
    """A module's type; every part between hyphens has only its first letter large."""
    part = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))
    return F.array_join(F.transform(F.split(F.trim(text), "-"), part), "-")


#: Spellings of embodiments and the form they take.
EMBODIMENTS = {
    "Multi-chip embedded": "Multi-Chip Embedded",
    "Multi-chip Standalone": "Multi-Chip Stand Alone",
    "Multi-chip standalone": "Multi-Chip Stand Alone",
    "Single-chip": "Single Chip",
}


def embodiment(text: Column) -> Column:
    """A module's embodiment in one spelling; others stay, with single blanks."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in EMBODIMENTS.items() for x in pair])[plain], plain)


#: Words before a number that then names no certificate.
NO_CERTIFICATES = ("rsa", "shs", "dsa", "pkcs", "aes")


def mentioned_certificates(caveat: Column) -> Column:
    """Map of the certificate numbers a caveat names to how often it does; null stays null."""
    #: Fixed value: how a caveat names a certificate.
    p = r"(\w+)?\s?(?:#\s?|Cert\.?(?!.\s)\s?|Certificate\s?)+(\d+)"
    found = F.arrays_zip(F.regexp_extract_all(caveat, F.lit(p), F.lit(1)).alias("word"), F.regexp_extract_all(caveat, F.lit(p), F.lit(2)).alias("id"))
    ids = F.transform(F.filter(found, lambda m: ~F.lower(m["word"]).isin(*NO_CERTIFICATES)), lambda m: m["id"])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(ids)), lambda i: F.struct(i, F.size(F.filter(ids, lambda x: x == i)))))


#: Fixed value: how policies write an algorithm's number.
ALGORITHM_NUMBER = r"(?:#[CcAa]?\s?|(?:Cert)\.?[^. ]*?\s?)(?:[CcAa]\s)?(\d+)"


def algorithm_numbers(text: Column) -> Column:
    """References to algorithm certificates as written (`#123`, `Cert. A 45`), each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ALGORITHM_NUMBER), F.lit(0)))


def pages_with_tables(text: Column) -> Column:
    """Numbers of the pages of a policy that may hold tables of algorithms.

    Where the policy has a list of tables, the pages that it gives for tables of functions
    or algorithms; otherwise the pages of lines that begin with `Table ` or `Exhibit`, each
    with its neighbours (page 1 not as a neighbour), without the first one at or after the last page.
    """
    #: How a policy lists its tables, and those of functions or algorithms.
    listed = F.regexp_extract(text, r"(?m)^(?:[Tt]able\s|[Ll]ist\s)[Oo]f\s[Tt]ables[\s\S]+?\f", 0)
    given = F.regexp_extract_all(listed, F.lit(r"(?m)^.+?(?:[Ff]unction|[Aa]lgorithm|[Ss]ecurity [Ff]unctions?).+?(\d+)$"), F.lit(1))
    begin = F.struct(F.lit(1).alias("page"), F.array().cast("array<int>").alias("hits"))

    def line(seen: Column, one: Column) -> Column:
        page = seen["page"] + F.contains(one, F.lit("\f")).cast("int")
        near = F.when(page > 2, F.array(page - 1, page, page + 1)).otherwise(F.array(page, page + 1))
        hit = F.startswith(one, F.lit("Table ")) | F.startswith(one, F.lit("Exhibit"))
        return F.struct(page.alias("page"), F.when(hit, F.concat(seen["hits"], near)).otherwise(seen["hits"]).alias("hits"))

    read = F.aggregate(F.split(text, "\n"), begin, line)
    pages = F.array_sort(F.array_distinct(read["hits"]))
    beyond = F.get(F.filter(pages, lambda n: n >= read["page"]), F.lit(0))
    found = F.filter(pages, lambda n: beyond.isNull() | (n != beyond))
    return F.when(listed != "", F.array_sort(F.array_distinct(F.transform(given, lambda n: n.cast("int"))))).otherwise(found)


def first_level(text: Column) -> Column:
    """The first `EAL` with its number; empty where there is none, also for null."""
    return F.coalesce(F.regexp_extract(text, r"EAL\d+", 0), F.lit(""))


def first_link(text: Column) -> Column:
    """The first web address of a text; empty where there is none, also for null."""
    #: Fixed value: a web address.
    return F.coalesce(F.regexp_extract(text, r"https?://[a-zA-Z0-9./\-_]+", 0), F.lit(""))


def packages(text: Column) -> Column:
    """Map of each level of a text to the components named after it, up to the next level;
    of a level that comes twice the last counts."""
    #: A level, and below a component.
    level = r"\bEAL\s*\d+\b"
    names = F.transform(F.regexp_extract_all(text, F.lit(level), F.lit(0)), lambda n: F.replace(n, F.lit(" "), F.lit("")))
    after = F.slice(F.split(text, level), F.lit(2), F.size(names))
    parts = F.transform(after, lambda a: F.regexp_extract_all(a, F.lit(r"\b[A-Z]{3,4}_[A-Z]{3,4}(?:\.\d+)?\b"), F.lit(0)))
    pairs = F.arrays_zip(names.alias("name"), parts.alias("parts"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["name"]))
    return F.map_from_entries(last)


def scheme_of(cert_id: Column, patterns: dict[str, list[str]]) -> Column:
    """The first scheme one of whose patterns fits the whole id; null where none does."""
    fits = lambda p: cert_id.rlike(rf"^(?:{p})$")
    return F.coalesce(*[F.when(fits(p), F.lit(scheme)) for scheme, some in patterns.items() for p in some])


def front_page(text: Column, rules: list[tuple[str, dict[str, int]]], first: int | None = None) -> Column:
    """Struct of the fields that the rules name, from the first rule that fits the text.

    A rule is a pattern and the number of the group of each field; white space around values
    goes and inside them becomes one blank. Null where no rule fits. `first` looks at that
    many leading characters only, where a front page ends before the text does.
    """
    page = text if first is None else F.substring(text, 1, first)
    names = list(dict.fromkeys(n for _, groups in rules for n in groups))
    got = lambda p, at: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(page, p, at), r"\s+", " ")), F.lit(""))
    one = lambda p, groups: F.when(page.rlike(p), F.struct(*[(got(p, groups[n]) if n in groups else F.lit(None).cast("string")).alias(n) for n in names]))
    return F.coalesce(*[one(p, groups) for p, groups in rules])
