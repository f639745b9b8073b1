"""The audited ingest of a course catalogue in two passes: what programmes' pages list, then what courses' pages say."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import ingest
from corvane.operators.rounds import saved
from corvane.operators.runs import Entry, RunLog
from corvane.sources import pages

# The headings of a course's page, the first one that heads something wins.
HOLDERS = ["Nositelji", "Nositelj"]
OUTCOMES = ["Ishodi učenja"]
SYLLABUS = ["Opis kolegija", "Opis predmeta", "Sadržaj"]


class Catalogue(NamedTuple):
    """programmes (code, level, area, name), courses (code, name, name_en, credits, url, holder, outcomes, syllabus, embedding_text), offerings."""

    programmes: DataFrame
    courses: DataFrame
    offerings: DataFrame


_COURSE = "code string, name string, name_en string, credits double, url string, holder string, outcomes string, syllabus string, embedding_text string"


def nothing(spark) -> Catalogue:
    """A catalogue without rows."""
    return Catalogue(*(spark.createDataFrame([], s) for s in ("code string, level string, area string, name string", _COURSE, "course_id string, programme_id string, semester int, is_elective boolean, elective_group string")))


def _title(html: str) -> Column:
    found = F.btrim(F.regexp_replace(F.regexp_extract(F.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.nullif(found, F.lit(""))


def _section(sections: DataFrame, labels: list[str], name: str) -> DataFrame:
    return pages.labelled(sections.where("text <> ''"), "code", labels).select("code", F.col("text").alias(name))


def details(course_pages: DataFrame, with_en: bool = False) -> DataFrame:
    """(code, name, name_en, holder, outcomes, syllabus) of courses' pages. course_pages: code, html, html_en (or null)."""
    parts = saved(pages.sections(course_pages.select("code", "html"), "code"))
    rows = course_pages.select("code", _title("html").alias("name"), (_title("html_en") if with_en else F.lit(None).cast("string")).alias("name_en"))
    for labels, name in ((HOLDERS, "holder"), (OUTCOMES, "outcomes"), (SYLLABUS, "syllabus")):
        rows = rows.join(_section(parts, labels, name), "code", "left")
    return rows


def _listed(run: Entry, stored: Catalogue, programme_pages: DataFrame) -> tuple[Catalogue, DataFrame]:
    """The catalogue after the first pass, and the codes that the pages list."""
    rows = saved(pages.programme_courses(programme_pages.select(F.col("code").alias("page"), "html"), "page"))
    good = rows.where("state = 'row'")
    run.tally("parsed", good)
    run.tally("upserted", good)
    where = F.concat(F.lit(" in "), "page", F.lit(": "), "text")
    run.refuse(rows.where("state = 'no link'"), F.concat(F.lit("no link"), where))
    run.remark(rows.where("state = 'transversal'"), F.concat(F.lit("transversal, skipped"), where))
    names = rows.groupBy("page").agg(F.first("programme", ignorenulls=True).alias("name"))
    incoming = programme_pages.select("code", "level", "area").join(names, F.col("code") == F.col("page"), "left").select("code", "level", "area", "name")
    at = F.struct("page", "place")
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", at)).alias(c)
    new = good.groupBy("code").agg(first("name"), first("credits")).withColumn("url", F.concat(F.lit("/predmet/"), "code"))
    offered = good.select(F.col("code").alias("course_id"), F.col("page").alias("programme_id"), "semester", "is_elective", "elective_group")
    rest = stored.courses.select("code", "name_en", "holder", "outcomes", "syllabus", "embedding_text")
    courses = ingest.courses(stored.courses.select("code", "name", "credits", "url"), new).join(rest, "code", "left").select(*stored.courses.columns)
    return Catalogue(saved(ingest.programmes(stored.programmes, incoming)), saved(courses), saved(ingest.offerings(stored.offerings, offered))), good.select("code").distinct()


def _described(run: Entry, stored: Catalogue, course_pages: DataFrame, with_en: bool) -> Catalogue:
    """The catalogue after the second pass."""
    found = saved(details(course_pages, with_en))
    known = stored.courses.select("code", "name", "name_en", "holder", "outcomes", "syllabus")
    merged, unknown = ingest.detailed(known, found)
    run.refuse(unknown, F.concat(F.lit("details without a course: "), "code"))
    text = F.nullif(F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in ("new_name", "new_name_en", "new_outcomes", "new_syllabus")]), F.lit(""))
    texts = found.select("code", *[F.col(c).alias(f"new_{c}") for c in ("name", "name_en", "outcomes", "syllabus")]).select("code", text.alias("new_text"), F.lit(True).alias("read"))
    own = stored.courses.select("code", "credits", "url", "embedding_text").join(texts, "code", "left")
    own = own.select("code", "credits", F.when(F.col("read"), F.concat(F.lit("/predmet/"), "code")).otherwise(F.col("url")).alias("url"), F.when(F.col("read"), F.col("new_text")).otherwise(F.col("embedding_text")).alias("embedding_text"))
    courses = saved(merged.join(own, "code").select(*stored.courses.columns))
    read = found.join(stored.courses.select("code"), "code", "left_semi")
    run.tally("parsed", read)
    run.tally("upserted", read)
    return stored._replace(courses=courses)


def ingest_courses(log: RunLog, stored: Catalogue, programme_pages: DataFrame, course_pages: DataFrame, skip_detail: bool = False, limit: int | None = None, with_en: bool = False) -> Catalogue:
    """stored with what pages say merged into it, as a run of the log.

    programme_pages: code, level, area, html; course_pages: code, html, html_en. skip_detail: only the first pass; limit: of the codes that are listed,
    in order, so many are described; with_en: English names too. A run that fails leaves stored as it was, and says so in the log; one
    that is repeated gives the same catalogue. Pages without a code are left out; of several of one code the least html counts.
    """
    once = lambda df, *more: df.where("code IS NOT NULL").groupBy("code").agg(*[F.min_by(c, F.coalesce("html", F.lit(""))).alias(c) for c in ("html", *more)])
    with log.run("courses") as run:
        with run.step("list"):
            found, codes = _listed(run, stored, once(programme_pages, "level", "area"))
        if not skip_detail:
            with run.step("describe"):
                wanted = codes.orderBy("code").limit(limit) if limit is not None else codes
                found = _described(run, found, once(course_pages, "html_en").join(wanted, "code", "left_semi"), with_en)
        return found
