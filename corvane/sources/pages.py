"""HTML pages as tables: whole files are dealt out by Spark, each is parsed where it is read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: A course's code in its link: what follows /predmet/, without slashes around it and what a question mark begins.
_CODE = re.compile(r"(?s)(?:.*/predmet/)?/*([^?]*?)/*(?:\?.*)?$")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of each file below path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def listed(spark: SparkSession, folder: str, files: dict[str, str]) -> DataFrame:
    """(path, html, kind) of the named files of a folder, by name their kind; a file that isn't there fails the read."""
    rows = None
    for name, kind in files.items():
        part = spark.read.option("ignoreMissingFiles", "false").text(f"{folder}/{name}", wholetext=True)
        part = part.select(F.input_file_name().alias("path"), F.col("value").alias("html"), F.lit(kind).alias("kind"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


class _Cells(HTMLParser):
    """The cells of the body rows of tables of a class; a line break in a cell is a new line."""

    def __init__(self, wanted: set[str]):
        super().__init__()
        self.wanted, self.rows, self.open, self.in_body, self.cell, self.found = wanted, [], 0, False, None, False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            if self.open or self.wanted <= set((dict(attrs).get("class") or "").split()):
                self.open += 1
                self.found = True
        elif self.open and tag == "tbody":
            self.in_body = True
        elif self.in_body and tag == "tr":
            self.rows.append([])
        elif self.in_body and tag == "td" and self.rows:
            self.cell = []
        elif self.cell is not None:
            self.cell.append("\n")

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open -= 1
            self.in_body = self.in_body and self.open > 0
        elif tag == "td" and self.cell is not None:
            pieces = (" ".join(p.split()) for p in "".join(self.cell).split("\n"))
            self.rows[-1].append("\n".join(filter(None, pieces)))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data.replace("\n", " "))


class _Sections(HTMLParser):
    """Headings with the text that follows each of them."""

    def __init__(self):
        super().__init__()
        self.sections: list[list[str]] = []
        self.heading, self.skip = False, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "h2", "h3", "h4"):
            self.sections.append(["", ""])
            self.heading = True
        elif tag in ("script", "style"):
            self.skip += 1
        elif self.sections and tag not in _VOID:
            self.sections[-1][not self.heading] += " "

    def handle_endtag(self, tag):
        if tag in ("h1", "h2", "h3", "h4"):
            self.heading = False
        elif tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)

    def handle_data(self, data):
        if self.sections and not self.skip:
            self.sections[-1][not self.heading] += data


class _Programme(HTMLParser):
    """The courses of a programme's page: sections of semesters, in them titles of groups and boxes of courses.

    A section counts if a link to its id is titled 'N. semestar'; the link may stand anywhere on the page.
    """

    def __init__(self):
        super().__init__()
        self.name, self.semesters, self.boxes = "", {}, []
        self.open: list[tuple[str, str]] = []  # the tags that are open, each with what it is to us
        self.sections: list[str] = []
        self.text: list[str] = []
        self.title, self.box, self.link = None, None, None

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        kinds = given.get("class", "").split()
        role = ""
        if tag == "h1" and not self.name:
            role = "name"
        elif "grouptitle" in kinds and self.sections:
            role = "title"
        elif "coursebox-content" in kinds and self.sections:
            role = "box"
            self.box = {"section": self.sections[-1], "href": None, "name": "", "left": "", "text": ""}
        elif self.box is not None and tag == "a" and self.box["href"] is None and given.get("href", "").startswith("/predmet/"):
            role = "course"
            self.box["href"] = given["href"]
        elif self.box is not None and "leftcont" in kinds:
            role = "left"
        elif tag == "a" and re.match(r"#\S+$", given.get("href", "")):
            role = f"nav:{given['href'][1:]}:{given.get('title', '')}"
        elif tag == "div" and given.get("id"):
            role = f"section:{given['id']}"
            self.sections.append(given["id"])
        if role and not role.startswith("section"):
            self.text.append("")
        if tag not in _VOID:
            self.open.append((tag, role))
        elif self.text:
            self.text[-1] += " "

    def handle_data(self, data):
        if self.text:
            self.text[-1] += f" {data}"

    def handle_endtag(self, tag):
        while any(t == tag for t, _ in self.open):
            last, role = self.open.pop()
            self._ended(role)
            if last == tag:
                break

    def _ended(self, role: str) -> None:
        kind, _, rest = role.partition(":")
        if kind == "section":
            self.sections.pop()
        elif role:
            said = " ".join(self.text.pop().split())
            if self.text:
                self.text[-1] += f" {said}"
            if kind == "name":
                self.name = said
            elif kind == "nav":
                target, _, title = rest.partition(":")
                found = re.match(r"\s*(\d+)\.\s*semestar", title or said)
                if found:
                    self.semesters.setdefault(target, int(found[1]))
            elif kind == "title":
                self.boxes.append({"section": self.sections[-1], "group": said})
            elif kind == "course":
                self.box["name"] = said
            elif kind == "left":
                self.box["left"] = self.box["left"] or said
            elif kind == "box":
                self.boxes.append(self.box | {"text": said})
                self.box = None

    def rows(self) -> Iterator[tuple]:
        """(state, code, name, credits as said, semester, group as said, text) in order of the page."""
        group: dict[str, str] = {}
        for box in self.boxes:
            semester = self.semesters.get(box["section"])
            if semester is None:
                continue
            if "group" in box:
                group[box["section"]] = box["group"]
                continue
            code = _CODE.match(box["href"] or "")[1]
            state = "row" if code else "no link"
            yield state, code, box["name"], box["left"], semester, group.get(box["section"], ""), box["text"]


def programme_courses(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, programme, place, state, code, name, credits, semester, is_elective, elective_group, text) of programmes' pages.

    state: "row"; or why a box gives none: "no link", "transversal" (skipped with a warning), "repeated" (a course of a semester
    that stood before). Pages are parsed where they are read; what groups and credits mean are column expressions.
    """
    from pyspark.sql import Window

    kind = pages.schema[key].dataType.simpleString()
    names = [key, "programme", "place", "state", "code", "name", "left", "semester", "group", "text"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = _Programme()
                parser.feed(html or "")
                rows += [(page, parser.name, i, *row) for i, row in enumerate(parser.rows())]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            kinds = [batch.schema.field(0).type, pa.string(), pa.int32(), *[pa.string()] * 4, pa.int32(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = f"{key} {kind}, programme string, place int, state string, code string, name string, left string, semester int, `group` string, text string"
    found = pages.select(key, "html").mapInArrow(parse, schema)
    skipped = group_kind(F.col("group")) == "skip"
    state = F.when(skipped, "transversal").otherwise(F.col("state"))
    rows = found.withColumn("state", state)
    before = F.row_number().over(Window.partitionBy(key, "semester", "code", "state").orderBy("place"))
    rows = rows.withColumn("state", F.when((F.col("state") == "row") & (before > 1), "repeated").otherwise(F.col("state")))
    elective = group_kind(F.col("group")) == "elective"
    return rows.select(key, "programme", "place", "state", "code", "name", number(F.col("left")).alias("credits"), "semester", elective.alias("is_elective"), F.when(elective, group_name(F.col("group"))).alias("elective_group"), "text")


def labelled(sections: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """(key, heading, text): of each page the section under the first of the labels that heads one."""
    from pyspark.sql import Window

    rank = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("heading"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(rank, "place"))
    return sections.where(rank > 0).withColumn("_n", first).where("_n = 1").select(key, "heading", "text")


def leaf_links(pages: DataFrame, pattern: str, areas: dict[str, str]) -> DataFrame:
    """(link, area) of the distinct links that match a pattern whose first group is the area; areas without a name in capitals."""
    found = links(pages, pattern)
    part = F.regexp_extract("link", pattern, 1)
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in areas.items() for x in pair]), part) if areas else F.lit(None)
    return found.select("link", F.coalesce(named, F.upper(part)).alias("area"))


def table_rows(pages: DataFrame, classes: str, key: str = "path") -> DataFrame:
    """(key, row, cells) of the body rows of the tables that have all of the classes; a page without such a table gives row -1."""
    wanted = set(classes.split())
    kind = pages.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, cells = [], [], []
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = _Cells(wanted)
                parser.feed(html or "")
                for i, row in enumerate(parser.rows) if parser.found else [(-1, [])]:
                    keys.append(name)
                    numbers.append(i)
                    cells.append(row)
            yield pa.record_batch([pa.array(keys, batch.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(cells, pa.list_(pa.string()))], [key, "row", "cells"])

    return pages.select(key, "html").mapInArrow(parse, f"{key} {kind}, row int, cells array<string>")


def sections(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, place, heading, text) of every headed section of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = _Sections()
                parser.feed(html or "")
                rows += [(name, i, " ".join(h.split()), " ".join(t.split())) for i, (h, t) in enumerate(parser.sections)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], [key, "place", "heading", "text"])

    return pages.select(key, "html").mapInArrow(parse, f"{key} {kind}, place int, heading string, text string")


def schedule(pages: DataFrame, classes: str, year: int) -> DataFrame:
    """Items of a schedule's rows (programme, student, title, supervisor ...), with the reason of each rejected row.

    A supervisor's cell is a name, then a unit's code in brackets.
    """
    from corvane.functions.text import name_parts
    from corvane.operators.tables import content_key

    cell = lambda k: F.try_element_at("cells", F.lit(k))
    rows = table_rows(pages, classes)
    unit = F.nullif(F.regexp_extract(cell(4), r"\(([^()]*)\)\s*$", 1), F.lit(""))
    name = name_parts(F.regexp_replace(cell(4), r"\([^()]*\)\s*$", ""))
    reason = F.when(F.col("row") < 0, "no table").when(F.size("cells") < 4, "too few cells").when(F.btrim(cell(3)).isin("", "-"), "no title").when(name.isNull(), "no supervisor")
    return rows.select(
        "path", "row", reason.alias("rejected"), cell(1).alias("programme"), cell(2).alias("student"), cell(3).alias("title"),
        name["family"].alias("family"), name["given"].alias("given"), unit.alias("unit"), F.lit(year).alias("year"), content_key(cell(1), cell(2), cell(3)).alias("ext_id"),
    )


def links(pages: DataFrame, pattern: str) -> DataFrame:
    """The distinct links of all pages that match a pattern."""
    found = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"href=\"([^\"]+)\""), F.lit(1))).alias("link"))
    return found.where(F.regexp_like("link", F.lit(pattern))).distinct()


def number(text):
    """The first number of a text, with a comma or a point."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)", 1), ",", "."), F.lit("")).cast("double")


def group_kind(label):
    """What a label says of a group of courses: one that is skipped, electives, or mandatory ones."""
    low = F.lower(label)
    return F.when(low.contains("transverzaln"), "skip").when(low.contains("izborni"), "elective").otherwise("mandatory")


def group_name(label):
    return F.btrim(F.regexp_replace(label, r"\s*\(\d+\)\s*$", ""))


def file_name(url: str) -> str:
    """A safe file name for a fetched page."""
    return re.sub(r"[^A-Za-z0-9]+", "_", url.split("://")[-1]).strip("_") + ".html"
