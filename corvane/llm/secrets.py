"""Secret scans: three token patterns, and sliding-window Shannon entropy per character class.

Built-in functions only. The patterns are matched leftmost and without overlap; where a match starts follows from the
lengths of the pieces between matches. A candidate string is a run of 20 or more characters of a class; a window
of 20 characters slides over it, and its entropy is kept up to date by the two counts that change with each step.
A run's hot windows (entropy at or above the class's threshold) give one span, from the first one's start to the last
one's end; of a key of one case and digits, whose alphabet has no joining signs, the span is the whole run. Runs without a digit (words, paths
of words) and identifiers of a fixed form are no candidates, and a word that marks an example takes what touches it out of a run.

Edge cases: null or empty text has no spans; very long texts, runs and lists of matches are scanned whole, in time that grows with
their length; repeated rows each get a row; an empty table gives no rows; more columns are ignored by scanned() and kept by
redacted(), whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import held, let, masked, table

WINDOW = 20
#: Bits of a count in a window, and counts in an integer.
FIELD, FIELDS = 5, 12
#: Values that one level of a running merge takes.
RUN = 256
#: Characters of the stretches that a text is cut out of.
STRETCH = 4096
_KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
#: kind -> pattern; kinds stand in the order in which spans of one start are listed.
PATTERNS = {
    "assign": rf"""(?:{_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
LEAST_ASSIGN = 8
#: class -> (runs of it, the symbols that are counted, bits of a hot window, what a run must contain, whether its span is the whole run).
#: Fewer symbols repeat sooner, so their bounds are lower: 99 and 98 of 100 random keys of 20 characters of one case reach theirs.
#: Runs of hex digits alone are entropy_hex's.
CLASSES = {
    "entropy_hex": (r"[0-9A-Fa-f]{20,}", "0123456789abcdef", 3.0, ("[0-9]", "[A-Fa-f]"), False),
    "entropy_base64": (r"[A-Za-z0-9+/_-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.8, ("[0-9]", "[a-z]", "[A-Z]"), False),
    "entropy_base36": (r"[a-z0-9]{20,}", "abcdefghijklmnopqrstuvwxyz0123456789", 3.4, ("[0-9]", "[g-z]"), True),
    "entropy_base32": (r"[A-Z0-9]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.4, ("[0-9]", "[G-Z]"), True),
}
#: Words that mark an example: blanks stand for them where runs are looked for, so every other character keeps its place.
MARKERS = ("example", "sample", "dummy", "placeholder")
#: Runs that are no secrets whatever their entropy. Plain words and paths of words need no entry: without a digit they are no candidates.
#: No pattern of this module repeats a group; Java's matcher would recurse once for each repetition.
ALLOWED = (r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",)
KINDS = [*PATTERNS, *CLASSES]


def _any_case(word: str) -> str:
    """A pattern of an ASCII word in letters of either case."""
    return "".join(f"[{c.upper()}{c}]" for c in word)


def _before(values: Column, zero: int, merge) -> Column:
    """For each value, the merge of all values before it (zero for the first): runs of RUN values, then the runs' totals.

    A fold that appends to one array copies it at every step; in two levels no array that grows is longer than RUN, or than
    the number of runs.
    """
    none = F.expr("array_repeat(0, 0)")
    start = F.struct(F.lit(zero).alias("at"), none.alias("seen"))

    def scanned(part: Column) -> Column:
        step = lambda s, x: F.struct(merge(s["at"], x).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen"))
        return F.aggregate(part, start, step)

    def joined(runs: Column) -> Column:
        totals = scanned(F.transform(runs, lambda r: r["at"]))["seen"]
        return F.flatten(F.zip_with(runs, totals, lambda r, t: F.transform(r["seen"], lambda x: merge(t, x))))

    first = F.sequence(F.lit(1), F.size(values), F.lit(RUN))
    return F.when(F.size(values) > 0, let(F.transform(first, lambda i: scanned(F.slice(values, i, RUN))), joined)).otherwise(none)


def _located(text: Column, pattern: str, group: int = 0) -> Column:
    """The matches of pattern in text: array of (start, end, found). A match starts after the pieces and matches before it."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    wanted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    none = F.expr("array_repeat(named_struct('start', 0, 'end', 0, 'found', ''), 0)")
    lengths = F.zip_with(F.split(text, pattern, -1), whole, lambda piece, m: F.struct(F.length(piece).alias("gap"), F.length(m).alias("length")))
    lengths = F.filter(lengths, lambda x: x["length"].isNotNull())  # the last piece has no match after it

    def placed(lengths: Column) -> Column:
        start = _before(F.transform(lengths, lambda x: x["gap"] + x["length"]), 0, lambda a, x: a + x)
        return F.zip_with(F.arrays_zip(start.alias("at"), lengths.alias("of")), wanted, lambda x, found: F.struct((x["at"] + x["of"]["gap"]).alias("start"), (x["at"] + x["of"]["gap"] + x["of"]["length"]).alias("end"), found.alias("found")))

    return F.when(F.regexp_like(text, F.lit(pattern)), let(lengths, placed)).otherwise(none)


def _hot(run: Column, symbols: str, bits: float) -> Column:
    """The first and the last hot window of a run, each a start within it; -1 without one.

    The counts of a window (at most WINDOW, so FIELD bits each) are packed into a few integers; a step takes one unit out of a
    field and puts one into another, and corrects the sum of c * log2(c) by those two counts alone. A long run is taken in
    stretches, each with the end of the one before, so memory stays flat.
    """
    fold = F.lower(run) if symbols == "0123456789abcdef" else run
    kept = WINDOW - 1

    def searched(parts: Column) -> Column:
        before = lambda k: F.when(k > 0, F.substring(F.get(parts, k - 1), -kept, kept)).otherwise("")
        places = lambda k, hot: F.transform(F.array(hot["first"], hot["last"]), lambda x: F.when(x >= 0, x + k * STRETCH - F.when(k > 0, kept).otherwise(0)))
        return F.flatten(F.transform(parts, lambda p, k: places(k, _hot_stretch(F.concat(before(k), p), symbols, bits))))

    parts = F.when(F.length(fold) > STRETCH, F.regexp_extract_all(fold, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))).otherwise(F.array(fold))
    return let(let(parts, searched), lambda x: F.struct(F.coalesce(F.array_min(x), F.lit(-1)).alias("first"), F.coalesce(F.array_max(x), F.lit(-1)).alias("last")))


def _hot_stretch(run: Column, symbols: str, bits: float) -> Column:
    """_hot of one stretch."""
    slots = -(-len(symbols) // FIELDS)
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(symbols), c) - 1)
    weights = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    counts = [f"c{k}" for k in range(slots)]
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in counts], F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def field(code: Column) -> Column:
        unit = F.call_function("shiftleft", F.lit(1).cast("long"), code % FIELDS * FIELD)
        return F.struct(F.floor(code / FIELDS).cast("int").alias("slot"), unit.alias("unit"), (code % FIELDS * FIELD).alias("shift"))

    def count(state: Column, at: Column) -> Column:
        return F.call_function("shiftright", F.get(F.array(*[state[c] for c in counts]), at["slot"]), at["shift"]).bitwiseAND((1 << FIELD) - 1).cast("int")

    def step(state: Column, each: Column) -> Column:
        full = each["at"] > WINDOW
        same = full & (each["in"]["unit"] == each["out"]["unit"]) & (each["in"]["slot"] == each["out"]["slot"])
        gone, come = count(state, each["out"]), count(state, each["in"])
        less = F.when(full, F.get(weights, gone - 1) - F.get(weights, gone)).otherwise(0.0)
        more = F.get(weights, come + 1) - F.get(weights, come)
        total = F.when(same, state["sum"]).otherwise(state["sum"] + less + more)
        hot = (each["at"] >= WINDOW) & (F.round(F.lit(WINDOW * math.log2(WINDOW)) - total, 6) >= bits * WINDOW)
        start = each["at"] - WINDOW
        unit = lambda x, k: F.when(x["slot"] == k, x["unit"]).otherwise(0)
        return F.struct(
            *[(state[c] + unit(each["in"], k) - F.when(full, unit(each["out"], k)).otherwise(0)).alias(c) for k, c in enumerate(counts)],
            total.alias("sum"),
            F.when(hot & (state["first"] < 0), start).otherwise(state["first"]).alias("first"),
            F.when(hot, start).otherwise(state["last"]).alias("last"),
        )

    def steps(fields: Column) -> Column:
        return F.transform(fields, lambda c, j: F.struct(c.alias("in"), F.get(fields, F.greatest(j - WINDOW, F.lit(0))).alias("out"), (j + 1).alias("at")))

    return F.aggregate(let(F.transform(codes, field), steps), zero, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _unmarked(text: Column) -> Column:
    """text with blanks in place of MARKERS."""
    for word in MARKERS:
        text = F.regexp_replace(text, _any_case(word), " " * len(word))
    return text


def _entropy(text: Column, name: str) -> Column:
    pattern, symbols, bits, needs, whole = CLASSES[name]

    def suspect(run: Column) -> Column:
        keep = F.lit(True)
        for need in needs:
            keep = keep & F.regexp_like(run, F.lit(need))
        for allowed in ALLOWED:
            keep = keep & ~F.regexp_like(run, F.lit(allowed))
        return keep

    runs = F.filter(_located(text, pattern), lambda x: suspect(x["found"]))
    if whole:
        return F.transform(F.filter(runs, lambda x: _hot(x["found"], symbols, bits)["first"] >= 0), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    scored = F.transform(runs, lambda x: F.struct(x["start"].alias("start"), _hot(x["found"], symbols, bits).alias("hot")))
    return F.transform(F.filter(scored, lambda x: x["hot"]["first"] >= 0), lambda x: F.struct((x["start"] + x["hot"]["first"]).alias("start"), (x["start"] + x["hot"]["last"] + WINDOW).alias("end")))


def _of_kind(k: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))


def _is_kind(k: int):
    return lambda x: x["kind"] == k


def spans_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _spans: array of (start, kind as its place in KINDS, end), in order of start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = held(docs, "_unmarked", _unmarked(body))
    parts = []
    for k, name in enumerate(KINDS):
        if name in PATTERNS:
            found = _located(body, PATTERNS[name], 1 if name == "assign" else 0)
            found = F.filter(found, lambda x: F.length(x["found"]) >= LEAST_ASSIGN) if name == "assign" else found
        else:
            found = _entropy(F.col("_unmarked"), name)
        parts.append(F.transform(found, _of_kind(k)))
    return held(docs, "_spans", F.array_sort(F.concat(*parts))).drop("_unmarked")


def _said(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of each pattern, the digest of the patterns' spans, all spans."""
    base = F.filter("_spans", lambda x: x["kind"] < len(PATTERNS))
    return spans_of(docs.select("doc_id", "text")).select(
        "doc_id",
        *[F.size(F.filter("_spans", _is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(PATTERNS)],
        F.sha2(_said(base).cast("binary"), 256).alias("base_sha256"),
        _said(F.col("_spans")).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span in text replaced by mark (spans that touch or overlap: by one mark) and n_chars brought up to date.

    A text is cut out of stretches of STRETCH characters, so a cut doesn't count characters from the text's start.
    """
    stretches = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))

    def cut(parts: Column, low: Column, high: Column) -> Column:
        """The characters low .. high - 1."""
        first, last = F.floor(low / STRETCH).cast("int"), F.floor(high / STRETCH).cast("int")
        piece = lambda k, a, n: F.substring(F.coalesce(F.get(parts, k), F.lit("")), a, n)
        inner = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        across = F.concat(piece(first, low - first * STRETCH + 1, F.lit(STRETCH)), inner, piece(last, F.lit(1), high - last * STRETCH))
        return F.when(first == last, piece(first, low - first * STRETCH + 1, high - low)).otherwise(across)

    def marked(parts: Column) -> Column:
        reached = _before(F.transform("_spans", lambda x: x["end"]), 0, lambda a, x: F.greatest(a, x))
        gaps = F.zip_with("_spans", reached, lambda x, to: F.struct(to.alias("low"), x["start"].alias("high")))
        fresh = F.filter(gaps, lambda g, i: (g["high"] > g["low"]) | (i == 0))
        rest = F.array_max(F.transform("_spans", lambda x: x["end"]))
        return F.concat(F.array_join(F.transform(fresh, lambda g: F.concat(cut(parts, g["low"], g["high"]), F.lit(mark))), ""), cut(parts, rest, F.length("text")))

    given, names = masked(docs, "text")
    found = spans_of(given)
    text = F.when(F.size("_spans") > 0, let(stretches, marked)).otherwise(F.col("text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return held(found, "_text", text).select(*[new.get(c, F.col(names[c])).alias(c) for c in docs.columns])


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def op8_secrets_wide(spark, sf_dir: str) -> DataFrame:
    """doc_id and all spans of op8_secrets."""
    return op8_secrets(spark, sf_dir).select("doc_id", "spans")


def _sql_located(name: str, pattern: str, group: int, text: str = "text") -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, n, i, '{name}' AS kind, found, pos - length(whole) AS s, pos AS e FROM (
    SELECT doc_id, n, i, found, whole, CAST(sum(length(piece) + length(whole)) OVER (PARTITION BY n ORDER BY i) AS BIGINT) AS pos FROM (
      SELECT doc_id, n, unnest(string_split_regex({text}, '{p}')) AS piece, unnest(regexp_extract_all({text}, '{p}')) AS whole, unnest(regexp_extract_all({text}, '{p}', {group})) AS found,
             unnest(range(len(regexp_extract_all({text}, '{p}')))) AS i
      FROM docs WHERE regexp_matches({text}, '{p}')) WHERE i IS NOT NULL)"""


def _sql() -> str:
    def entropy(name: str) -> str:
        _, _, bits, needs, whole = CLASSES[name]
        ok = " AND ".join([f"regexp_matches(found, '{x}')" for x in needs] + [f"NOT regexp_matches(found, '{x}')" for x in ALLOWED])
        fold = "lower(found)" if name == "entropy_hex" else "found"
        span = "s, any_value(e) AS e" if whole else f"s + min(w) AS s, s + max(w) + {WINDOW} AS e"
        return f"""
  SELECT doc_id, n, '{name}' AS kind, {span} FROM (
    SELECT doc_id, n, i, s, e, {fold} AS found, unnest(range(length(found) - {WINDOW - 1})) AS w FROM r_{name} WHERE {ok})
  WHERE round(list_entropy(string_split(substr(found, CAST(w + 1 AS BIGINT), {WINDOW}), '')) * {WINDOW}, 6) >= {bits * WINDOW} GROUP BY doc_id, n, i, s"""

    kinds = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    ctes = [f"r_{k} AS ({_sql_located(k, PATTERNS[k], 1 if k == 'assign' else 0)})" for k in PATTERNS] + [f"r_{k} AS ({_sql_located(k, CLASSES[k][0], 0, 'unmarked')})" for k in CLASSES]
    every = [f"SELECT doc_id, n, kind, s, e FROM r_{k}" + (f" WHERE length(found) >= {LEAST_ASSIGN}" if k == "assign" else "") for k in PATTERNS] + [entropy(k) for k in CLASSES]
    unmarked = "coalesce(text, '')"
    for word in MARKERS:
        unmarked = f"regexp_replace({unmarked}, '{_any_case(word)}', '{' ' * len(word)}', 'g')"
    base = ", ".join(f"'{k}'" for k in PATTERNS)
    said = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {unmarked} AS unmarked, row_number() OVER () AS n FROM documents),
{", ".join(ctes)},
spans AS (SELECT *, {kinds} AS k FROM ({" UNION ALL ".join(every)})),
found AS (
  SELECT n, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in PATTERNS)},
         {said} FILTER (kind IN ({base})) AS base, {said} AS spans
  FROM spans GROUP BY n)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in PATTERNS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (n)
"""


OP8_SQL = _sql()
OP8_WIDE_SQL = f"SELECT doc_id, spans FROM ({OP8_SQL})"
