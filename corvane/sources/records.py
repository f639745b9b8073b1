"""XML harvest pages as a table of item records: one scan, array functions, no Python."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import name_parts

SCHEMA = """header struct<_status:string, identifier:string>,
metadata struct<mods:array<struct<
  _ID:string,
  titleInfo:array<struct<_lang:string,_type:string,title:string>>,
  abstract:array<struct<_VALUE:string,_lang:string,_type:string>>,
  name:array<struct<namePart:array<struct<_VALUE:string,_type:string>>,role:array<struct<roleTerm:array<struct<_VALUE:string,_lang:string,_authority:string>>>>>>,
  genre:array<struct<_VALUE:string,_authority:string,_lang:string>>,
  originInfo:array<struct<dateIssued:array<string>,dateCreated:array<string>,dateOther:array<string>>>,
  recordInfo:array<struct<recordCreationDate:array<struct<_VALUE:string,_encoding:string>>>>,
  extension:array<struct<degree:array<struct<discipline:array<struct<_VALUE:string,_type:string,_lang:string>>>>>>,
  identifier:array<struct<_VALUE:string,_type:string>>,
  subject:array<struct<_authority:string,_lang:string,topic:array<struct<_VALUE:string,_lang:string>>>>>>>"""

# Genre names of the resource type vocabulary and what they are called here.
GENRES = {"bachelor thesis": "zavrsni", "master thesis": "diplomski", "doctoral thesis": "doktorski"}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The records of all XML files below path."""
    return spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", "true").schema(SCHEMA).load(path)


def harvest(spark: SparkSession, folder: str, fetch: Callable[[str | None], str], refresh: bool = False, delay: float = 0.4) -> int:
    """Bring all pages of a paged list into a folder of XML files that scan() reads; returns their number.

    fetch(token) gives the page after a resumption token (None: the first one). The token of the next page stands in the page,
    so pages come one by one; a page that is in the folder already is read again instead, but for refresh. Written through
    Hadoop's file system, so that the folder may be wherever executors read.
    """
    jvm = spark._jvm
    store = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    token, number = None, 0
    while True:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/page_{number:04d}.xml")
        if store.exists(path) and not refresh:
            page = spark.read.text(path.toString(), wholetext=True).first()[0]
        else:
            if number:
                time.sleep(delay)
            page = fetch(token)
            out = store.create(path, True)
            out.write(bytearray(page.encode()))
            out.close()
        number += 1
        found = re.search(r"<resumptionToken[^>]*>\s*([^<\s][^<]*?)\s*</resumptionToken>", page)
        if not found:
            return number
        token = found[1]


def _all(values: Column) -> Column:
    return F.coalesce(values, F.expr("array()").cast("array<string>"))


def _first(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda x: F.btrim(x) != ""), F.lit(1))


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def _texts(structs: Column, keep) -> Column:
    return F.transform(F.filter(structs, keep), lambda x: F.btrim(x["_VALUE"]))


def _roles(person: Column, language: str) -> Column:
    """The last role term of a person in Croatian ("hrv"), or of any other kind, in lower case."""
    terms = F.flatten(F.transform(person["role"], lambda r: r["roleTerm"]))
    kept = F.filter(terms, lambda t: (F.coalesce(t["_lang"], F.lit("")) == "hrv") if language == "hrv" else (F.coalesce(t["_lang"], F.lit("")) != "hrv") & (F.btrim(t["_VALUE"]) != ""))
    return F.lower(F.btrim(_last(F.transform(kept, lambda t: t["_VALUE"]))))


def _person(person: Column) -> Column:
    """Family and given name by their types, or those of the one part without a type."""
    part = lambda kind: _first(_texts(person["namePart"], lambda x: x["_type"] == kind))
    typed = F.struct(part("family").alias("family"), part("given").alias("given"))
    plain = name_parts(_first(_texts(person["namePart"], lambda x: x["_type"].isNull())))
    return F.when(part("family").isNotNull() & part("given").isNotNull(), typed).otherwise(plain)


def items(records: DataFrame) -> DataFrame:
    """identifier, rejected (the reason, or null) and the fields of each record."""
    mods = F.col("metadata.mods")
    master = F.coalesce(F.try_element_at(F.filter(mods, lambda m: m["_ID"] == "master"), F.lit(1)), F.try_element_at(mods, F.lit(1)))
    rows = records.select(F.col("header.identifier").alias("identifier"), (F.coalesce("header._status", F.lit("")) == "deleted").alias("deleted"), master.alias("m"))
    m = F.col("m")
    english = lambda x: (F.coalesce(x["_lang"], F.lit("")) == "eng") | (F.coalesce(x["_type"], F.lit("")) == "alternative")
    title = lambda keep: _first(F.transform(F.filter(m["titleInfo"], keep), lambda x: F.btrim(x["title"])))
    advisors = F.filter(m["name"], lambda p: _roles(p, "other") == "thesis advisor")
    members = F.filter(m["name"], lambda p: _roles(p, "other") == "degree committee member")
    written = F.transform(F.flatten(F.transform(m["recordInfo"], _field("recordCreationDate"))), _field("_VALUE"))
    disciplines = F.flatten(F.transform(F.flatten(F.transform(m["extension"], _field("degree"))), _field("discipline")))
    programme = _first(_texts(disciplines, lambda d: (d["_type"] == "studijski program") & (d["_lang"] == "hrv")))
    dates = F.flatten(F.array(*[_all(F.flatten(F.transform(m["originInfo"], _field(name)))) for name in ("dateIssued", "dateCreated", "dateOther")], _all(written)))
    years = F.filter(F.transform(dates, lambda d: F.regexp_extract(d, r"(\d{4})", 1)), lambda y: y != "")
    coar = F.lower(_first(_texts(m["genre"], lambda g: g["_authority"] == "coar")))
    label = F.lower(_first(_texts(m["genre"], lambda g: g["_lang"] == "hrv")))
    kind = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for pair in GENRES.items() for x in pair]), coar),
        F.when(label.contains("završni") | label.contains("zavrsni"), "zavrsni").when(label.contains("diplomski"), "diplomski").when(label.contains("doktor"), "doktorski"),
    )
    classified = F.filter(m["subject"], lambda s: s["_authority"] == "nvzz.hr")
    fields = F.filter(F.transform(classified, lambda s: _last(_texts(s["topic"], lambda x: F.coalesce(x["_lang"], F.lit("hrv")) == "hrv"))), lambda x: x.isNotNull())
    free = F.filter(m["subject"], lambda s: F.coalesce(s["_authority"], F.lit("")) != "nvzz.hr")
    topics = F.flatten(F.transform(free, lambda s: _texts(s["topic"], lambda x: F.btrim(x["_VALUE"]) != "")))
    return rows.select(
        "identifier",
        F.when(F.col("deleted"), "deleted").when(m.isNull(), "no metadata").alias("rejected"),
        title(lambda x: ~english(x)).alias("title"),
        title(english).alias("title_en"),
        _first(_texts(m["abstract"], lambda x: F.coalesce(x["_lang"], F.lit("")) != "eng")).alias("abstract"),
        _first(_texts(m["abstract"], lambda x: x["_lang"] == "eng")).alias("abstract_en"),
        _person(_last(advisors)).alias("advisor"),
        F.transform(members, lambda p: F.struct(_person(p).alias("person"), F.when(F.coalesce(_roles(p, "hrv"), F.lit("")).contains("predsjednik"), "chair").otherwise("member").alias("role"))).alias("committee"),
        F.try_element_at(years, F.lit(1)).cast("int").alias("year"),
        kind.alias("kind"),
        F.nullif(F.array_join(F.array_distinct(fields), "; "), F.lit("")).alias("field"),
        F.array_distinct(topics).alias("keywords"),
        programme.alias("programme"),
        _first(_texts(m["identifier"], lambda x: x["_type"] == "urn")).alias("urn"),
    )


def first_items(found: DataFrame, limit: int) -> DataFrame:
    """So many items that aren't rejected. The scan goes on only until they are found; which ones they are is up to it."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return found.where("rejected IS NULL").limit(limit)


def _field(name: str):
    return lambda o: o[name]
