"""Product, profile, module, algorithm and queue pages as tables.

`rows` turns saved pages into one record a row (`tr`, or a `div` of class padrow or
col-md-12) with its cells; it is the only Python here and runs in Arrow batches, page by
page. What each kind of page means is said in column expressions. Null and empty pages
have no rows. A page that breaks the rules of its kind raises where the docstring says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vouchlake.functions import columns

#: Table ids of the register's pages and the categories they hold.
CATEGORIES = {
    "tblAC": "Access Control Devices and Systems",
    "tblBD": "Biometric Systems and Devices",
    "tblBP": "Boundary Protection Devices and Systems",
    "tblDP": "Data Protection",
    "tblDB": "Databases",
    "tblDD": "Detection Devices and Systems",
    "tblIC": "ICs, Smart Cards and Smart Card-Related Devices and Systems",
    "tblKM": "Key Management Systems",
    "tblMD": "Mobility",
    "tblMF": "Multi-Function Devices",
    "tblNS": "Network and Network-Related Devices and Systems",
    "tblOS": "Operating Systems",
    "tblOD": "Other Devices and Systems",
    "tblDG": "Products for Digital Signatures",
    "tblTC": "Trusted Computing",
}

#: Labels of a module page and the columns they become.
MODULE_LABELS = {
    "Module Name": "module_name",
    "Standard": "standard",
    "Status": "status",
    "Sunset Date": "date_sunset",
    "Validation Dates": "date_validation",
    "Overall Level": "level",
    "Caveat": "caveat",
    "Security Level Exceptions": "exceptions",
    "Module Type": "module_type",
    "Embodiment": "embodiment",
    "Approved Algorithms": "algorithms",
    "Tested Configuration(s)": "tested_conf",
    "Description": "description",
    "Historical Reason": "historical_reason",
    "Hardware Versions": "hw_versions",
    "Firmware Versions": "fw_versions",
    "Revoked Reason": "revoked_reason",
    "Revoked Link": "revoked_link",
    "Software Versions": "sw_versions",
    "Product URL": "product_url",
}

#: States of the modules in process, in the order of the oldest pages' last four cells.
PROCESS_STATES = ["In Review", "Review Pending", "Coordination", "Finalization"]

_LINK = "struct<href:string,title:string,id:string,text:string>"
_CELL = f"struct<classes:string,inner_id:string,strings:array<string>,own:string,links:array<{_LINK}>,items:array<struct<text:string,strings:array<string>,links:array<{_LINK}>>>>"
_ROWS = f"key string, kind string, panel int, table_id string, nth int, part string, part_id string, row int, heading string, cells array<{_CELL}>"
_VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "col", "source"}

_W = r"[ \t\n\r\f]"
_ATTR = r'[A-Za-z][A-Za-z0-9-]*+="[^"<>&]*+(?:&(?:amp|lt|gt|quot);[^"<>&]*+)*+"'
_TAG = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9]*+)((?:{_W}++{_ATTR})*+){_W}*+>")
#: Pages of plain tags alone, whose text means the same to any parser; most are, and go about twice as fast.
_PLAIN = re.compile(rf"(?:[^<]++|<(?!/?(?i:script|style|textarea|title|xmp|iframe|no|plaintext|svg|math))(?:/[A-Za-z][A-Za-z0-9]*+|[A-Za-z][A-Za-z0-9]*+(?:{_W}++{_ATTR})*+){_W}*+>)*+")
_PAIRS = re.compile(r'([A-Za-z][A-Za-z0-9-]*)="([^"]*)"')
#: A row of a table, and one of its cells, with no more in them than text and links and divisions without a class; most are so, and need no stack.
_BARE = rf"(?:{_W}++(?![Cc][Ll][Aa][Ss][Ss]=){_ATTR})*+{_W}*+>[^<]*+"
_INNER = rf"<(?:a{_BARE}</a|div{_BARE}</div)>"
_CELL_TAGS = rf"(?:{_W}++{_ATTR})*+{_W}*+>(?:[^<]++|{_INNER})*+"
_ROW = re.compile(rf"<tr>((?:{_W}*+(?:<td{_CELL_TAGS}</td>|<th{_CELL_TAGS}</th>))++){_W}*+</tr>")
_CELLS = re.compile(rf"<t[dh]((?:{_W}++{_ATTR})*+){_W}*+>((?:[^<]++|{_INNER})*+)</t[dh]>")
_INNERS = re.compile(rf"<(a|div)((?:{_W}++{_ATTR})*+){_W}*+>([^<]*+)</(?:a|div)>")
#: Rows that are handed on at once.
_HELD = 1000


def _attributes(text: str) -> list[tuple[str, str]]:
    """Names and values of a plain tag's attributes."""
    return [(k.lower(), unescape(v)) for k, v in _PAIRS.findall(text)] if text else []


class _Rows(HTMLParser):
    """Collects the rows of a page; a padrow's cells are its divs of class col-*."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.n = 0  # rows so far, with those handed on
        self.stack: list[tuple[str, str]] = []  # open tags: (tag, what ends with it)
        self.tables: list[dict] = []
        self.seen: dict[str, int] = {}
        self.panel, self.heading, self.in_heading = -1, "", False
        self.row: dict | None = None
        self.cell: dict | None = None
        self.link: dict | None = None
        self.item: dict | None = None
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        have = {k: v or "" for k, v in attrs}
        classes, ends = have.get("class", "").split(), ""
        if tag == "table":
            name = have.get("id", "")
            self.seen[name] = self.seen.get(name, -1) + 1
            self.tables.append({"id": name, "nth": self.seen[name], "part": "", "part_id": "", "n": 0, "outer": (self.row, self.cell, self.depth)})
            self.row = self.cell = None
        elif tag in ("thead", "tbody", "tfoot") and self.tables:
            self.tables[-1].update(part=tag, part_id=have.get("id", ""))
        elif tag == "tr" and self.tables:
            self._end_row()
            self.row = {"kind": "tr", "cells": []}
        elif tag == "div" and "panel-default" in classes:
            self.panel += 1
        elif tag == "div" and {"padrow", "col-md-12"} & set(classes) and not self.tables and self.row is None:
            self.row, ends = {"kind": "div", "cells": []}, "row"
        elif tag == "h4":
            self.heading, self.in_heading = "", True
        new = (tag in ("td", "th") and self.row and self.row["kind"] == "tr") or (tag == "div" and self.row and self.row["kind"] == "div" and ends == "" and self.cell is None and any(c.startswith("col-") for c in classes))
        if new:
            self.cell = {"classes": " ".join(classes), "inner_id": None, "strings": [], "own": [], "links": [], "items": []}
            self.row["cells"].append(self.cell)
            self.depth, ends = 0, "cell"
        elif self.cell is not None:
            self.depth += tag not in _VOID
            if tag == "div" and self.cell["inner_id"] is None:
                self.cell["inner_id"] = have.get("id")
            if tag == "a":
                self.link = {"href": have.get("href"), "title": have.get("title"), "id": have.get("id"), "text": ""}
                self.cell["links"].append(self.link)
                if self.item is not None:
                    self.item["links"].append(self.link)
            if tag == "li" or "col-md-12" in classes:
                ends = "item" if tag == "div" else ends
                self.item = {"text": "", "strings": [], "links": []}
                self.cell["items"].append(self.item)
        if tag not in _VOID:
            self.stack.append((tag, ends))

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        if not text:
            return
        if self.in_heading:
            self.heading = f"{self.heading} {text}".strip()
        if self.cell is not None:
            self.cell["strings"].append(text)
            if self.depth == 0:
                self.cell["own"].append(text)
            for held in (self.link, self.item):
                if held is not None:
                    held["text"] = f"{held['text']} {text}".strip()
            if self.item is not None:
                self.item["strings"].append(text)

    def handle_endtag(self, tag: str) -> None:
        at = len(self.stack) - 1
        while at >= 0 and self.stack[at][0] != tag:
            at -= 1
        if at < 0:
            return
        ended = {e for _, e in self.stack[at:]}
        self.depth = max(0, self.depth - sum(t not in ("td", "th") for t, _ in self.stack[at:]))
        del self.stack[at:]
        self.in_heading &= tag != "h4"
        if tag == "a":
            self.link = None
        if tag == "li" or "item" in ended:
            self.item = None
        if "cell" in ended:
            self.cell = self.link = self.item = None
        if "row" in ended or (tag in ("tr", "table", "tbody", "tfoot", "thead") and self.row and self.row["kind"] == "tr"):
            self._end_row()
        if tag == "table" and self.tables:
            self.row, self.cell, self.depth = self.tables.pop()["outer"]

    def close(self) -> None:
        super().close()
        self._end_row()

    def read(self, text: str) -> Iterator[list[tuple]]:
        """The rows of a whole page; of plain pages a bounded list at a time."""
        for _ in self._plain(text) if _PLAIN.fullmatch(text) else [self.feed(text)]:
            if len(self.out) >= _HELD:
                yield self.out
                self.out = []
        self.close()
        yield self.out

    def _plain(self, text: str) -> Iterator[None]:
        """Makes the calls that feeding a page of plain tags makes."""
        end = 0
        while m := _TAG.search(text, end):
            if m.start() > end:
                self.handle_data(unescape(text[end : m.start()]))
            end = m.end()
            if m[0] == "<tr>" and self.tables and not self.in_heading and (whole := _ROW.match(text, m.start())):
                end = whole.end()
                yield self._whole_row(whole[1])
            elif m[1]:
                yield self.handle_endtag(m[2].lower())
            else:
                self.handle_starttag(m[2].lower(), _attributes(m[3]))
        if end < len(text):
            self.handle_data(unescape(text[end:]))

    def _whole_row(self, text: str) -> None:
        """Does what the calls for a row's tags and data do, from its start to its end."""
        self._end_row()
        cells = []
        for own_attrs, body in _CELLS.findall(text):
            cell = {"classes": " ".join(dict(_attributes(own_attrs)).get("class", "").split()) if own_attrs else "", "inner_id": None, "strings": [], "own": [], "links": [], "items": []}
            cells.append(cell)
            if "<" not in body:
                if said := " ".join(unescape(body).split()):
                    cell["strings"], cell["own"] = [said], [said]
                continue
            parts = _INNERS.split(body)  # text, then tag, attributes and content of what is inside, and text again
            for i in range(0, len(parts), 4):
                if said := " ".join(unescape(parts[i]).split()):
                    cell["strings"].append(said)
                    cell["own"].append(said)
                if i + 1 == len(parts):
                    break
                have, said = dict(_attributes(parts[i + 2])), " ".join(unescape(parts[i + 3]).split())
                if said:
                    cell["strings"].append(said)
                if parts[i + 1] == "a":
                    cell["links"].append({"href": have.get("href"), "title": have.get("title"), "id": have.get("id"), "text": said})
                elif cell["inner_id"] is None:
                    cell["inner_id"] = have.get("id")
        self.row = {"kind": "tr", "cells": cells}
        self._end_row()

    def _end_row(self) -> None:
        if self.row and self.row["cells"]:
            t = self.tables[-1] if self.tables else {"id": "", "nth": 0, "part": "", "part_id": "", "n": self.n}
            cells = [(c["classes"], c["inner_id"], c["strings"], " ".join(c["own"]), c["links"], c["items"]) for c in self.row["cells"]]
            self.out.append((self.row["kind"], self.panel, t["id"], t["nth"], t["part"], t["part_id"], t["n"], self.heading, cells))
            t["n"] += 1
            self.n += 1
        self.row = self.cell = self.link = self.item = None


def rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One record a row of each page, in the page's order: see the schema `_ROWS`."""

    schema = to_arrow_schema(StructType.fromDDL(_ROWS))
    batch_of = lambda held: pa.RecordBatch.from_struct_array(pa.array(held, pa.struct(list(schema))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for k, text in zip(batch["key"], batch["html"], strict=True):
                for found in _Rows().read(text.as_py() or ""):
                    held += [(k.as_py(), *r) for r in found]
                    if len(held) >= _HELD:
                        yield batch_of(held)
                        held = []
        if held:
            yield batch_of(held)

    return pages.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html")).mapInArrow(run, _ROWS)


def _cell(i: int) -> Column:
    return F.get("cells", F.lit(i)) if i >= 0 else F.element_at("cells", i)


def _text(cell: Column) -> Column:
    return F.nullif(F.array_join(cell.strings, " "), F.lit(""))


def _first(cell: Column) -> Column:
    return F.get(cell.strings, F.lit(0))


def _href(links: Column, test, base: str = "") -> Column:
    """The last link that passes the test, below `base`; null where none does."""
    return F.concat(F.lit(base), F.try_element_at(F.filter(links, test), F.lit(-1)).href)


def _checked(test: Column, message: Column | str, value: Column) -> Column:
    return F.when(test, value).otherwise(F.raise_error(message))


def _updates(cell: Column, base: str) -> Column:
    """Maintenance reports listed in a cell: date, title, links of report and target."""
    starts = lambda word: lambda link: F.coalesce(link.title.startswith(word), F.lit(False))
    one = lambda u: F.struct(
        F.try_to_date(F.substring(u.text, 1, 10), "yyyy-MM-dd").alias("date"), F.trim(F.regexp_extract(F.get(F.split(u.text, "– "), F.lit(1)), r"^(.*?)\s*(?:Maintenance (?:Report|ST).*)?$", 1)).alias("title"),
        _href(u.links, starts("Maintenance Report:"), base).alias("report_link"), _href(u.links, starts("Maintenance ST"), base).alias("st_link"),
    )
    return F.when(F.array_contains(cell.strings, "Maintenance Report(s)"), F.transform(cell["items"], one)).otherwise(F.array().cast("array<struct<date:date,title:string,report_link:string,st_link:string>>"))


def products(found: DataFrame, base: str = "", status: str = "active") -> DataFrame:
    """Products of the register's pages, from `rows`: two head rows a table, seven cells a row.

    Raises on a row of other width and on a second table of the same id.
    """
    of = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    body = found.where(F.col("table_id").isin(*CATEGORIES) & (F.col("row") >= 2))
    ok = (F.size("cells") == 7) & (F.col("nth") == 0)
    links = _cell(0).links
    titled = lambda word: lambda link: F.coalesce(link.title.startswith(word), F.lit(False))
    site = lambda link: (link.title == "Vendor's web site") & (link.href != "http://")
    profile = lambda link: F.coalesce(link.href.contains("/ppfiles/"), F.lit(False))
    return body.select(
        "key", F.lit(status).alias("status"), _checked(ok, F.concat(F.lit("bad row or table in page "), "key"), of[F.col("table_id")]).alias("category"),
        _first(_cell(0)).alias("name"), _first(_cell(1)).alias("manufacturer"), F.get(F.filter(_cell(1).links, site), F.lit(0)).href.alias("manufacturer_web"),
        _first(_cell(6)).alias("scheme"), F.array_sort(F.array_distinct(_cell(5).strings)).alias("security_level"),
        F.array_sort(F.array_distinct(F.transform(F.filter(links, profile), lambda link: F.concat(F.lit(base), link.href)))).alias("profile_links"),
        F.try_to_date(_text(_cell(3)), "yyyy-MM-dd").alias("not_valid_before"), F.try_to_date(_text(_cell(4)), "yyyy-MM-dd").alias("not_valid_after"),
        _href(links, titled("Certification Report"), base).alias("report_link"), _href(links, titled("Security Target"), base).alias("st_link"),
        F.concat(F.lit(base), F.get(_cell(2).links, F.lit(0)).href).alias("cert_link"), _updates(_cell(0), base).alias("maintenance"),
    )


def profiles(found: DataFrame, base: str = "", status: str = "active", collaborative: bool = False) -> DataFrame:
    """Protection profiles, from `rows`: six cells where active, seven where archived, five
    where collaborative; rows of other width or without a profile's link go."""
    ids = {f"{t}1" if collaborative else t: c for t, c in CATEGORIES.items()}
    of = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    width = 5 if collaborative else 6 if status == "active" else 7
    links = _cell(0).links
    link = F.get(F.filter(links, lambda x: x.text == "Protection Profile") if collaborative else links, F.lit(0))
    none = F.lit(None).cast("string")
    kept = found.where(F.col("table_id").isin(*ids) & (F.col("row") >= 1) & (F.size("cells") == width)).where(F.length(link.href) > 0)
    return kept.select(
        "key", of[F.col("table_id")].alias("category"), F.lit("active" if collaborative else status).alias("status"), F.lit(collaborative).alias("is_collaborative"),
        (_first(_cell(0)) if collaborative else link.text).alias("name"), _text(_cell(1)).alias("version"), F.array_sort(F.array_distinct(_cell(2).strings)).alias("security_level"),
        F.try_to_date(_text(_cell(3)), "yyyy-MM-dd").alias("not_valid_before"), (F.try_to_date(_text(_cell(4)), "yyyy-MM-dd") if width == 7 else none.cast("date")).alias("not_valid_after"),
        F.concat(F.lit(base), F.get(_cell(-1).links, F.lit(0)).href).alias("report_link"), F.concat(F.lit(base), link.href).alias("pp_link"), (none if collaborative else _first(_cell(-2))).alias("scheme"),
    )


def algorithm_list(found: DataFrame) -> DataFrame:
    """Validated algorithms of list pages, from `rows`: short rows continue the vendor and
    the implementation above them; rows without a validation link go."""
    wide = F.size("cells") >= 4
    named = F.get(F.filter(_cell(1).links, lambda x: F.coalesce(x.id.startswith("product-name-"), F.lit(False))), F.lit(0))
    above = Window.partitionBy("key", "table_id", "nth").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(wide, F.struct(F.coalesce(_text(_cell(0)), F.lit("")).alias("vendor"), F.coalesce(named.text, _text(_cell(1)), F.lit("")).alias("name"), F.nullif(F.regexp_extract(named.href, r"[?&]product=([^&#]+)", 1), F.lit("")).alias("pid")))
    at = F.when(wide, 2).otherwise(0)
    proof = F.get(F.filter(F.get("cells", at).links, lambda x: F.coalesce(x.id.startswith("validation-number-"), F.lit(False))), F.lit(0))
    day = columns.parsed_date(_text(F.get("cells", at + 1)), "MM/dd/yyyy", "yyyy-MM-dd")
    body = found.where((F.col("part") == "tbody") & (F.size("cells") >= 2))
    # the cells stay behind: only what is read from them is sorted
    body = body.select("key", "table_id", "nth", "row", own.alias("own"), columns.type_and_number(proof.text).alias("alg"), day.alias("validated")).withColumn("head", F.last("own", ignorenulls=True).over(above))
    return body.where("alg IS NOT NULL").select(
        "key", F.col("alg.type").alias("algorithm_type"), F.col("alg.number").alias("alg_number"), F.coalesce("head.vendor", F.lit("")).alias("vendor"), F.coalesce("head.name", F.lit("")).alias("implementation_name"),
        F.col("head.pid").alias("product_id"), "validated",
    ).distinct()


def capabilities(found: DataFrame) -> DataFrame:
    """(key, algorithm_type, alg_number, capability, environment) of product pages, from
    `rows`: a heading names the validation, a row its environment and capabilities."""
    alg = columns.type_and_number(F.col("heading"))
    oe = F.trim(F.regexp_replace(F.array_join(_cell(0).strings, " "), r"\s*Expand\s*$", ""))
    noted = F.filter(_cell(1).links, lambda x: F.coalesce(x.href.contains("Validation-Notes#"), F.lit(False)))
    pairs = found.where((F.col("kind") == "tr") & (F.size("cells") >= 2)).select("key", alg.alias("alg"), F.when(~oe.isin("", "N/A"), oe).alias("environment"), F.explode(F.transform(noted, lambda x: F.rtrim(x.text, F.lit(":")))).alias("capability"))
    return pairs.where("alg IS NOT NULL AND capability <> ''").select("key", F.col("alg.type").alias("algorithm_type"), F.col("alg.number").alias("alg_number"), "capability", "environment")


def modules(found: DataFrame, base: str = "") -> DataFrame:
    """One row a module page, from `rows`: labelled details of the first panel as columns,
    the vendor of the second, the certificate of the third, the history of the fourth."""
    of = F.create_map(*[F.lit(x) for pair in MODULE_LABELS.items() for x in pair])
    value, whole = _cell(1), F.array_join(_cell(0).strings, " ")
    # label and value of a detail are worked out once a row, not once a column
    detail = (F.col("panel") == 0) & (F.col("kind") == "div")
    found = found.withColumn("label", F.when(detail, of[whole])).withColumn("plain", F.when(F.col("label").isNotNull(), F.array_join(value.strings, " ")))
    found = found.withColumn("listed", F.when(F.col("label").isin("exceptions", "tested_conf"), F.transform(value["items"], lambda i: i.text)))
    label, listed, mine = F.col("label"), F.col("listed"), F.col("label").isNotNull()
    text = lambda name: F.max(F.when(label == name, F.col("plain"))).alias(name)
    many = lambda name: F.max(F.when((label == name) & ~((F.size(listed) == 1) & F.array_contains(listed, "N/A")), listed)).alias(name)
    certificate = F.get(F.filter(F.flatten(F.transform("cells", lambda c: c.links)), lambda x: x.text.contains("Certificate")), F.lit(0)).href
    maker = F.get(F.flatten(F.transform("cells", lambda c: c.links)), F.lit(0))
    # algorithms are rows of a table, numbers in their second cell, or divisions of name and number
    numbers = F.transform(columns.algorithm_numbers(F.array_join(value.strings, " ")), lambda n: F.concat(F.array_join(_cell(0).strings, " "), n))
    divided = F.transform(value["items"], lambda i: F.concat(F.get(i.strings, F.lit(0)), F.get(i.strings, F.lit(1))))
    algorithms = F.when((F.col("panel") == 0) & (F.col("part") == "tbody"), numbers).when(mine & (label == "algorithms"), divided)
    done = F.struct(F.col("row"), columns.parsed_date(_text(_cell(0)), "M/d/yyyy", "yyyy-MM-dd").alias("date"), _text(_cell(1)).alias("type"), _text(_cell(2)).alias("lab"))
    special = {"exceptions", "tested_conf", "algorithms"}
    page = found.groupBy("key").agg(
        *[text(c) for c in MODULE_LABELS.values() if c not in special], many("exceptions"), many("tested_conf"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(algorithms)))).alias("algorithms"),
        F.max(F.when(F.col("panel") == 1, F.coalesce(maker.text, _first(_cell(0))))).alias("vendor"), F.max(F.when(F.col("panel") == 1, maker.href)).alias("vendor_url"),
        F.max(F.when(F.col("panel") == 2, F.concat(F.lit(base), certificate))).alias("certificate_pdf_url"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("panel") == 3) & (F.col("part") == "tbody"), done))), lambda h: F.struct(h.date, h.type, h.lab)).alias("history"),
    )
    fixed = {
        "status": F.lower("status"), "level": F.expr("try_cast(level AS int)"), "date_sunset": columns.parsed_date(F.col("date_sunset"), "M/d/yyyy", "yyyy-MM-dd"),
        "module_type": columns.module_type(F.col("module_type")), "embodiment": columns.embodiment(F.col("embodiment")), "mentioned_certs": columns.mentioned_certificates(F.col("caveat")),
    }
    return page.withColumns(fixed)


def queue(found: DataFrame) -> DataFrame:
    """Modules under test, from `rows`: name, vendor, standard and the day they were listed.
    Raises on a page of more than one table."""
    one = _checked(F.col("nth") == 0, F.concat(F.lit("more than one table in page "), "key"), _text(_cell(0)))
    body = found.where((F.col("part") == "tbody") & (F.size("cells") >= 4))
    return body.select("key", one.alias("module"), _text(_cell(1)).alias("vendor"), _text(_cell(2)).alias("standard"), F.try_to_date(_text(_cell(3)), "M/d/yyyy").alias("listed")).distinct()


def in_process(found: DataFrame, taken: str = "taken_at") -> DataFrame:
    """Modules in process, from `rows` with the time of each page in `taken`.

    Five layouts: the state is the highlighted one of the last four cells (to 2020-10-28), a
    word (to 2021-04-20), a word beside a vendor with further lines (to 2022-03-23), a state
    with its day (to 2026-03-05), and that with a submission's id. Raises on unknown states.
    """
    at = F.to_date(taken)
    marked = F.array_position(F.transform(F.slice("cells", -4, 4), lambda c: F.array_contains(F.split(c.classes, " "), "mip-highlight")), True)
    line = F.col("line")
    oldest, dated = F.col(taken) <= F.lit("2020-10-28").cast("timestamp"), F.col(taken) > F.lit("2022-03-23").cast("timestamp")
    state = F.when(oldest, F.get(F.array(*map(F.lit, PROCESS_STATES)), (marked - 1).cast("int"))).when(dated & line.since.isNull(), None).otherwise(line.status)
    vendor = F.when(F.col(taken) <= F.lit("2021-04-20").cast("timestamp"), _text(_cell(1))).otherwise(F.nullif(_cell(1).own, F.lit("")))
    body = found.where((F.col("part") == "tbody") & (F.size("cells") >= 4))
    # a line and its state are worked out once a row, not wherever they are used
    body, state = body.withColumn("line", columns.status_line(_text(_cell(3)))).withColumn("state", state), F.col("state")
    return body.select(
        "key", at.alias("snapshot"), _text(_cell(0)).alias("module"), vendor.alias("vendor"), _text(_cell(2)).alias("standard"), _checked(state.isin(PROCESS_STATES), F.concat(F.lit("unknown state in page "), "key"), state).alias("status"),
        F.when(dated, line.since).alias("since"), F.when(F.col(taken) > F.lit("2026-03-05").cast("timestamp"), F.substr(_cell(1).inner_id, F.lit(2))).alias("submission_id"),
    ).distinct()


def footer_counts(found: DataFrame, footer: str) -> DataFrame:
    """(key, displayed, not_displayed, total) from the three rows of a page's footer."""
    n = lambda i, name: F.max(F.when(F.col("i") == i, F.expr("try_cast(n AS int)"))).alias(name)
    foot = found.where(F.col("part_id") == footer)
    ranked = foot.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("row")) - 1).alias("i"), _text(_cell(1)).alias("n"))
    return ranked.groupBy("key").agg(n(0, "displayed"), n(1, "not_displayed"), n(2, "total"))


def last_updated(html: Column) -> Column:
    """The day a page says it was last updated."""
    return F.try_to_date(F.regexp_extract(html, r"Last Updated:\s*(\d{1,2}/\d{1,2}/\d{4})", 1), "M/d/yyyy")


def key_values(found: DataFrame, names: dict[str, str]) -> DataFrame:
    """(key, one column a name) from two-cell rows whose first cell is a known label; the
    first row of a label counts."""
    label = F.rtrim(F.array_join(_cell(0).strings, " "), F.lit(": "))
    known = found.where((F.size("cells") == 2) & label.isin(*names))
    value = F.struct(F.col("row"), _text(_cell(1)).alias("v"))
    return known.groupBy("key").agg(*[F.min(F.when(label == k, value)).v.alias(c) for k, c in names.items()])
