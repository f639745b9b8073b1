"""Document fingerprints by spot signatures.

Built-in functions only. Words are runs of letters and digits in lower case. A signature is a common word (the anchor) with
the next two content words that follow it, common words between them left out. A text's fingerprint is the set of its
signatures' 32-bit hashes, in order, as hexadecimal text. Fingerprints are put into partitions by set length, so that pairs
whose partitions cannot reach a likeness are pruned without a comparison; the others are compared by Jaccard similarity.

The next document of each is found without a global sort in one task: rows are dealt into ranges of doc_id of about RANGE bytes of
text and kept as a table bucketed by range; a range's rows are followed by the first row of the next range, so no text is
broadcast or sent twice. Both fingerprints of a row are computed once, after that.

Edge cases: in a text without a common word that two content words follow (any other language), the words whose CRC-32 is a
multiple of SPARE are anchors, each with the next two words; characters of scripts without spaces are words of their own; a text
without such an anchor either (empty, null, very short) has one signature, the hash of all its words, so equal texts have
equal fingerprints and are alike to 1; rows of one doc_id stand next to each other, in order of their text's MD5; a null doc_id stands first; a single document is its own next; an empty table gives no rows; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.shared import Bucketed, held, let, saved, table

#: Common words of four languages: anchors, and what chains skip.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will no more if out so up",
    "de": "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an er hat aus bei sind noch nach wird einer um am haben nur oder aber vor zur bis mehr durch man",
    "fr": "le la les et des en un du une que est pour qui dans par sur au pas plus ne se avec il ce sont ou son cette ont aux elle mais comme nous sa leur",
    "es": "el los del las por con una su para al lo como o este sus le ha me sin sobre ya entre cuando todo esta ser son dos fue era muy hasta desde",
}
#: Bytes of text that a range aims at; ranges at most (the sample that sets their bounds grows with them, not with rows); ranges of a bucket.
RANGE, RANGES, BUCKET = 8 << 20, 20_000, 2
#: In texts without common words, one word in so many is an anchor.
SPARE = 4
#: Scripts that put no spaces between words.
_UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}])"


def normal(text: Column) -> Column:
    """The words of a text, in lower case, a space between them."""
    apart = F.when(F.regexp_like(text, F.lit(_UNSPACED)), F.regexp_replace(text, _UNSPACED, " $1 ")).otherwise(text)
    return F.btrim(F.regexp_replace(F.lower(apart), r"[^\p{L}\p{N}]+", " "))


def _branches(words: set[str]) -> str:
    """A pattern that matches exactly words, shared beginnings written once."""
    heads: dict[str, set[str]] = {}
    for w in words - {""}:
        heads.setdefault(w[0], set()).add(w[1:])
    said = "|".join(c + _branches(rest) for c, rest in sorted(heads.items()))
    if not said:
        return ""
    return f"(?:{said})?" if "" in words else said if len(heads) == 1 else f"(?:{said})"


def _groups(words: Column) -> Column:
    """words as groups: the common words before a content word, a mark after each, and that word."""
    common = _branches({w for said in COMMON.values() for w in said.split()})
    return F.split(F.regexp_replace(words, rf"(?<![^ ])({common})(?: |$)", "$1\x01"), " ")


def signatures(words: Column) -> Column:
    """The sorted distinct hashes of the signatures of words, or of all words if there is none."""

    def chained(groups: Column) -> Column:
        content = F.transform(groups, lambda g: F.substring_index(g, "\x01", -1))
        pairs = F.zip_with(F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0))), F.slice(content, 2, F.size(groups)), lambda g, c: F.struct(g.alias("group"), c.alias("next")))
        anchored = F.filter(pairs, lambda x: (F.instr(x["group"], "\x01") > 0) & (x["next"] != ""))
        return F.flatten(F.transform(anchored, lambda x: let(F.split(x["group"], "\x01"), lambda parts: F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda a: F.hash(a, F.element_at(parts, -1), x["next"])))))

    def spare(said: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(said) - 3)
        hashes = F.transform(F.filter(at, lambda i: F.crc32(F.get(said, i).cast("binary")) % SPARE == 0), lambda i: F.hash(F.get(said, i), F.get(said, i + 1), F.get(said, i + 2)))
        return F.when(F.size(said) >= 3, hashes).otherwise(F.expr("array_repeat(0, 0)"))

    distinct = lambda h: F.array_sort(F.array_distinct(h))
    whole = F.array(F.hash(words))
    other = let(let(F.split(words, " "), spare), lambda h: F.when(F.size(h) > 0, distinct(h)).otherwise(whole))
    return let(let(_groups(words), chained), lambda h: F.when(F.size(h) > 0, distinct(h)).otherwise(other))


def as_text(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), " ")


def partition(signatures: Column, least: float = 0.8) -> Column:
    """The partition of a set's length: sets more than one partition apart have a likeness under least."""
    return F.floor(F.log(F.size(signatures).cast("double")) / F.log(F.lit(1 / least))).cast("int")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without a comparison where their lengths show that it is under least."""
    shared = F.size(F.array_intersect(a, b))
    full = shared / (F.size(a) + F.size(b) - shared)
    if not least:
        return full
    near = F.abs(partition(a, least) - partition(b, least)) <= 1
    return F.when(near & (F.least(F.size(a), F.size(b)) >= least * F.greatest(F.size(a), F.size(b))), full).otherwise(0.0)


def followed(docs: DataFrame, range_bytes: int = RANGE) -> Bucketed:
    """doc_id, text, _range, _order and _head of the rows of docs, as a table bucketed by _range.

    Rows in _order within their _range stand as they do in the whole table; the last one (_head) is the first row of the next range.
    """
    text = F.coalesce("text", F.lit(""))
    given = docs.select("doc_id", text.alias("text"), F.md5(text.cast("binary")).alias("_digest"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(total // range_bytes + 1, RANGES)
    keys = [F.asc_nulls_first("doc_id"), "_digest", "_tie"]  # the tie lets equal rows be dealt to several ranges
    dealt = given.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id())
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_digest", "_tie")
    kept = Bucketed(dealt.select("doc_id", "text", "_range", order.alias("_order"), F.lit(False).alias("_head")), "_range", n // BUCKET + 1)
    ranges = kept.rows.groupBy("_range").agg(F.min("_order").alias("_least"))
    by_range = Window.orderBy("_range")  # one row a range
    everything = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # at most RANGES rows of a range and an order: small enough to be sent to every task
    before = ranges.select(F.col("_range").alias("_own"), "_least", F.coalesce(F.lag("_range").over(by_range), F.last("_range").over(everything)).alias("_before"))
    first = (F.col("_range") == F.col("_own")) & (F.col("_order") == F.col("_least"))
    firsts = kept.rows.join(F.broadcast(before), first).select("doc_id", "text", F.col("_before").alias("_range"), "_order", F.lit(True).alias("_head"))
    kept.append(saved(firsts, "firsts"))
    return kept


def edited(text: Column, after: Column) -> Column:
    """text with its last quarter of code points replaced by as many (or all) of the next text's first ones."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(after, F.lit(1), cut))


def printed(docs: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Every document with its fingerprint and those of its edited text and of the next document, compared."""
    kept = followed(docs, range_bytes)
    own = held(kept.rows, "_own", signatures(normal(F.col("text"))))
    inside = Window.partitionBy("_range").orderBy("_head", "_order")
    pairs = own.select("*", F.lead(F.struct("text", "_own")).over(inside).alias("next")).where(~F.col("_head"))
    pairs = held(pairs, "_edited", edited(F.col("text"), F.col("next.text")))
    pairs = held(pairs, "_changed", signatures(normal(F.col("_edited"))))
    out = pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_changed")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_changed")).alias("near_edited"),
        likeness(F.col("_own"), F.col("next._own")).alias("near_next"),
        partition(F.col("_own")).alias("length_partition"),
    )
    out = saved(out, "printed")
    kept.drop()
    return out


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return printed(table(spark, sf_dir, "documents"))
