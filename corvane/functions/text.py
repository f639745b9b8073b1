"""Text functions as column expressions: folds, tokens, tolerant matching, names, snippets, display helpers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that carry no topic, before folding.
STOPWORDS = (
    "i ili te pa ali no kao za na od do iz sa se su je li da ne što koji koja koje kojom čiji gdje kada kako ovaj ova ovo taj to "
    "neki neka neko moj moja moje tvoj svoj bih biti želim htio htjela raditi rad tema temu nešto "
    "sustav sustava razvoj izrada implementacija analiza primjena primjene pomoću temelju korištenjem metode metoda model modela "
    "the and for with using based system development analysis application from this that"
).split()
MIN_TOKEN = 3
STEM = 4
SNIPPET = 220


def _plain_letters() -> tuple[str, str]:
    """Letters with marks and their plain forms, for those with a plain form of one letter."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _plain_letters()


def unmarked(text: Column) -> Column:
    """text without accents and other combining marks; letters that do not decompose stay. Plain ASCII is left as it is."""
    plain = F.regexp_replace(F.translate(text, MARKED, PLAIN), r"\p{M}+", "")
    return F.when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), plain).otherwise(text)


def fold(text: Column) -> Column:
    """For lexical matching: lower case, no marks, đ and ð as d."""
    return unmarked(F.translate(F.lower(text), "đð", "dd"))


def fold_name(text: Column) -> Column:
    """For name search: no marks (đ stays), runs of other signs as one space, lower case."""
    return F.btrim(F.lower(F.regexp_replace(unmarked(text), r"[^\p{L}\p{N}]+", " ")))


def fold_slug(text: Column) -> Column:
    """For keys: no marks, đ as d, lower case."""
    return F.lower(unmarked(F.translate(text, "đĐ", "dD")))


def folded_stopwords() -> list[str]:
    strip = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w.replace("đ", "d")) if not unicodedata.combining(c))
    return [strip(w) for w in STOPWORDS]


def _telling(folded: Column) -> Column:
    return (F.length(folded) >= MIN_TOKEN) & ~F.regexp_like(folded, F.lit(r"^\p{N}+$")) & ~folded.isin(folded_stopwords())


def content_terms(text: Column) -> Column:
    """Distinct folded tokens that may carry a topic, in order of first occurrence; each distinct word is folded once."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0)))
    long = F.filter(words, lambda w: F.length(w) >= MIN_TOKEN)  # folding makes no word longer
    return F.array_distinct(F.filter(F.transform(long, lambda w: unmarked(F.translate(w, "đð", "dd"))), _telling))


def content_words(text: Column) -> Column:
    """(surface, folded) of a short text's content terms, the first surface of each."""
    pairs = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.struct(w.alias("surface"), fold(w).alias("folded")))
    kept = F.filter(pairs, lambda x: _telling(x["folded"]))
    return F.transform(F.array(kept), lambda all_: F.filter(all_, lambda x, i: F.array_position(F.transform(all_, lambda y: y["folded"]), x["folded"]) == i + 1))[0]


def tokens_match(a: Column, b: Column) -> Column:
    """Equal, or both of four letters or more with a common beginning of four or more and of all but one letter of the shorter."""
    common = F.greatest(F.lit(STEM), F.least(F.length(a), F.length(b)) - 1)
    stems = (F.least(F.length(a), F.length(b)) >= STEM) & (F.left(a, common) == F.left(b, common))
    return (a == b) | stems


def matched(terms: Column, text_terms: Column) -> Column:
    """The terms that match a term of the text; only terms that agree in STEM letters (or wholly, if shorter) are compared."""
    stems = F.transform(terms, lambda a: F.left(a, F.lit(STEM)))
    near = F.transform(F.array(stems), lambda s: F.filter(text_terms, lambda b: F.array_contains(s, F.left(b, F.lit(STEM)))))[0]
    return F.transform(F.array(near), lambda n: F.filter(terms, lambda a: F.exists(n, lambda b: tokens_match(a, b))))[0]


def lexical_overlap(terms: Column, text_terms: Column) -> Column:
    """The share of terms that the text matches; 0 without terms."""
    return F.when(F.size(terms) > 0, F.size(matched(terms, text_terms)) / F.size(terms)).otherwise(0.0)


def matched_keywords(terms: Column, keywords: Column) -> Column:
    """The keywords with a token that matches a term: trimmed, in order, each folded form once."""
    hits = F.filter(keywords, lambda k: F.exists(content_terms(k), lambda b: F.exists(terms, lambda a: tokens_match(a, b))))
    pairs = F.transform(hits, lambda k: F.struct(F.btrim(k).alias("surface"), fold(F.btrim(k)).alias("folded")))
    return F.transform(F.array(pairs), lambda p: F.transform(F.filter(p, lambda x, i: F.array_position(F.transform(p, lambda y: y["folded"]), x["folded"]) == i + 1), lambda x: x["surface"]))[0]


def query_key(text: Column) -> Column:
    """Lower case, white space collapsed, marks kept."""
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))


def name_parts(text: Column) -> Column:
    """(family, given) of 'Family, Given' or 'Given Family'; null unless both are there."""
    clean = F.btrim(F.regexp_replace(F.regexp_replace(text, r"[\r\n\t|]", " "), r"\s+", " "))
    comma = F.instr(clean, ",") > 0
    family = F.when(comma, F.btrim(F.substring_index(clean, ",", 1))).otherwise(F.substring_index(clean, " ", -1))
    given = F.when(comma, F.btrim(F.regexp_replace(clean, r"^[^,]*,", ""))).otherwise(F.btrim(F.regexp_replace(clean, r"(^|\s)\S+$", "")))
    return F.when((clean != "") & (clean != "-") & (family != "") & (given != ""), F.struct(family.alias("family"), given.alias("given")))


def slug(family: Column, given: Column) -> Column:
    """family_given, each folded with dashes for runs of other signs."""
    part = lambda c: F.regexp_replace(F.regexp_replace(fold_slug(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(part(family), F.lit("_"), part(given))


def snippet(text: Column, most: int = SNIPPET) -> Column:
    """White space collapsed; a text longer than most is cut there, its last broken word dropped, with an ellipsis."""
    flat = F.btrim(F.regexp_replace(text, r"\s+", " "))
    cut = F.concat(F.regexp_replace(F.left(flat, F.lit(most)), r" [^ ]*$", ""), F.lit("…"))
    return F.when(flat.isNull() | (text == ""), F.lit(None)).when(F.length(flat) <= most, flat).otherwise(cut)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """n with the form that its last digits ask for."""
    last, two = n % 10, n % 100
    form = F.when((last == 1) & (two != 11), one).when(last.between(2, 4) & ~two.between(12, 14), few).otherwise(many)
    return F.concat_ws(" ", n.cast("string"), form)


def joined_texts(*parts: Column) -> Column:
    """The parts that hold something, one a line: the text that is embedded."""
    return F.concat_ws("\n", *[F.when(F.btrim(p) != "", p) for p in parts])


def landing_url(source: Column, urn: Column, base: str) -> Column:
    """The public page of a published item, or null."""
    return F.when((source == "repo") & (F.btrim(urn) != ""), F.concat(F.lit(base), F.btrim(urn)))
