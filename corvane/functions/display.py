"""What rows are shown as: titles, shares, dates, sort and profile keys, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import text as T

# The name of an item without a title, and the months in the genitive.
UNTITLED = "(bez naslova)"
MONTHS = "siječnja veljače ožujka travnja svibnja lipnja srpnja kolovoza rujna listopada studenoga prosinca".split()


def _filled(*parts: Column) -> Column:
    return F.coalesce(*[F.when(p != "", p) for p in parts], F.lit(""))


def fixed(value: Column) -> Column:
    """A number with six decimals, as C and SQL print it: rounded by its exact binary value, halves to even.

    format_string rounds the shortest decimal that stands for the number, so 0.2479025, which is a little less in binary, would go up.
    The product with a million is taken in two parts, which are both exact, so its distance from a half is, too.
    """
    x, million = F.abs(value), F.lit(1e6)
    wide = x * F.lit(134217729.0)  # 2 ** 27 + 1: parts of 26 bits
    high = wide - (wide - x)
    low = (x - high) * million
    whole = F.floor(high * million + low)
    over = (high * million - (whole + F.lit(0.5))) + low
    shown = whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1).otherwise(0)
    return F.concat(F.when(value < 0, "-").otherwise(""), F.format_string("%.6f", shown / million))


def listed_title(*titles: Column) -> Column:
    """The first title that holds something, trimmed; UNTITLED if nothing is left."""
    trimmed = F.btrim(_filled(*titles))
    return F.when(trimmed == "", UNTITLED).otherwise(trimmed)


def detail_title(*titles: Column) -> Column:
    """The first title that holds something, or UNTITLED; trimmed at the end, so a blank one stays blank."""
    found = _filled(*titles)
    return F.btrim(F.when(found == "", UNTITLED).otherwise(found))


def percent(share: Column) -> Column:
    """A share as whole per cent, halves up."""
    return F.concat(F.floor(share * 100 + 0.5).cast("long").cast("string"), F.lit("%"))


def long_date(when: Column) -> Column:
    """Day, month in the genitive and year: '18. srpnja 2026.'"""
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(when))
    return F.concat_ws(" ", F.concat(F.dayofmonth(when).cast("string"), F.lit(".")), month, F.concat(F.year(when).cast("string"), F.lit(".")))


def surname_key(name: Column) -> Column:
    """'Given Family Name' as 'Family Name Given'; a single word as it is."""
    words = F.split(F.btrim(name), r"\s+")
    rest = F.slice(words, 2, F.size(words))
    return F.when(F.size(words) > 1, F.concat_ws(" ", F.array_join(rest, " "), words[0])).otherwise(name)


def profile_slug(name: Column) -> Column:
    """A name's words in plain lower-case letters, joined by points."""
    plain = F.regexp_replace(F.translate(T.unmarked(F.lower(name)), "đ", "d"), r"[^a-z\s-]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"^\s+|\s+$", ""), r"\s+", ".")


def prompt(text: Column, kind: str, model: str, most: int = 6000) -> Column:
    """A text as a model takes it: models of the e5 family want the kind in front, before the text is cut."""
    led = F.concat(F.lit(f"{kind}: "), text) if "e5" in model.lower() else text
    return F.left(led, F.lit(most))


def kind_bucket(kind: Column) -> Column:
    """The bucket of a kind of work, by what its name holds."""
    low = T.unmarked(F.lower(F.coalesce(kind, F.lit(""))))
    holds = lambda part: F.contains(low, F.lit(part))
    return F.when(holds("zavr"), "zavrsni").when(holds("diplom"), "diplomski").when(holds("doktor"), "doktorski").otherwise("ostalo")


def quoted(terms: Column, most: int = 3) -> Column:
    return F.array_join(F.transform(F.slice(terms, 1, most), lambda t: F.concat(F.lit("„"), t, F.lit("”"))), ", ")


def works(n: Column) -> Column:
    """The form of 'rad' after a number, as the explanations use it."""
    return F.when(n == 1, "rad").when(n.between(2, 4), "rada").otherwise("radova")


def person_sentence(name: Column, n: Column, title: Column, year: Column, matched: Column) -> Column:
    """Why a person is recommended: by shared terms, by similar works, or (without a title) in general."""
    when = F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise("")
    have = F.concat(F.lit("Preporučeno jer "), name, F.lit(" ima "), n.cast("string"), F.lit(" "), works(n))
    shared = F.concat(F.when(n == 1, " koji dijeli ").otherwise(" koji dijele "), F.when(F.size(matched) == 1, "pojam ").otherwise("pojmove "), quoted(matched))
    example = F.concat(F.lit("„"), title, F.lit("”"), when, F.lit("."))
    general = F.concat(F.lit("Preporučeno na temelju semantičke sličnosti radova "), name, F.lit("."))
    return (
        F.when(title.isNull(), general)
        .when(F.size(matched) > 0, F.concat(have, shared, F.lit(" — npr. "), example))
        .otherwise(F.concat(have, F.lit(" na sličnu temu, npr. "), example))
    )


def course_sentence(credits: Column, semester: Column, matched: Column) -> Column:
    """Why a course is recommended, with its credits and semester if they are known."""
    said = F.regexp_replace(F.format_string("%.1f", credits), r"\.?0+$", "")
    parts = F.concat_ws(", ", F.when(credits > 0, F.concat(said, F.lit(" ECTS"))), F.when(semester > 0, F.concat(semester.cast("string"), F.lit(". semestar"))))
    suffix = F.when(parts != "", F.concat(F.lit(" ("), parts, F.lit(")"))).otherwise("")
    by_terms = F.concat(F.lit("Predloženo jer se tvoji pojmovi "), quoted(matched), F.lit(" poklapaju s ishodima predmeta"), suffix, F.lit("."))
    general = F.concat(F.lit("Predloženo jer se ishodi i sadržaj predmeta poklapaju s tvojim opisom interesa"), suffix, F.lit("."))
    return F.when(F.size(matched) > 0, by_terms).otherwise(general)


def lexical_sentence(name: Column, n: Column, title: Column, year: Column, matched: Column, fields: Column) -> Column:
    """The lexical mode's sentence: by shared terms, or by fields."""
    form = F.when(n == 1, "rad").when(n < 5, "rada").otherwise("radova")
    when = F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise("")
    example = F.when(title.isNotNull(), F.concat(F.lit(" — npr. „"), title, F.lit("”"), when)).otherwise("")
    by_terms = F.concat(F.lit("Preporučeno jer "), name, F.lit(" ima "), n.cast("string"), F.lit(" "), form, F.lit(" koji dijele pojmove "), quoted(matched), example, F.lit("."))
    of_fields = F.when(F.size(fields) > 0, F.concat(F.lit("iz područja "), F.array_join(F.slice(fields, 1, 2), " i "))).otherwise("iz srodnih područja")
    by_fields = F.concat(name, F.lit(" mentorira "), n.cast("string"), F.lit(" "), form, F.lit(" "), of_fields, F.lit(" koji se podudaraju s tvojom temom."))
    return F.when(F.size(matched) > 0, by_terms).otherwise(by_fields)
