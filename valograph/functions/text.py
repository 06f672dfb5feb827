"""Text functions as column expressions; only NFKD folding and sequence ratios run in Python."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from valograph import constants as C


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def squeeze(value: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(value), r"(?U)\s+", " "))


def normalise(value: Column | str) -> Column:
    """Lower case, everything but ASCII letters and digits to single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(value), F.lit(""))), "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t))


def normalise_loose(value: Column | str) -> Column:
    """As ``normalise``, after compatibility decomposition (ligatures, accents)."""
    return normalise(_nfkd(_col(value)))


def compact(normalised: Column | str) -> Column:
    return F.replace(_col(normalised), F.lit(" "), F.lit(""))


def core_title(value: Column | str) -> Column:
    """The part before the first colon or dash, still raw."""
    return F.split(F.coalesce(_col(value), F.lit("")), "[:\\-–—]", 2)[0]


def token_set(normalised: Column | str, stop_words: Sequence[str] = C.TITLE_STOP_WORDS) -> Column:
    """Distinct words longer than two letters that are no stop words."""
    words = F.filter(F.split(_col(normalised), " "), lambda w: F.length(w) > 2)
    return F.array_except(words, F.lit(list(stop_words)))


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two word arrays over their union, 0 for two empty ones."""
    return F.size(F.array_intersect(left, right)) / F.greatest(F.lit(1), F.size(F.array_union(left, right)))


def recall(wanted: Column, found: Column) -> Column:
    return F.size(F.array_intersect(wanted, found)) / F.greatest(F.lit(1), F.size(F.array_distinct(wanted)))


def _matched(a: str, b: str) -> int:
    """Characters in the matching blocks that the standard library's sequence matcher finds.

    The longest common substring is grown by substring search, which is quicker than its tables of positions. As there, the
    first such substring in ``a`` counts and its first place in ``b``, characters that make up over a hundredth of a long
    ``b`` begin no block but lengthen one, and what is left on both sides is matched likewise.
    """
    known = b
    if len(b) >= 200:
        often = [c for c in set(b) if b.count(c) > len(b) // 100 + 1]
        known = b.translate(dict.fromkeys(map(ord, often), "\0"))
    total, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        a_from, a_to, b_from, b_to = open_.pop()
        part = known[b_from:b_to]
        i = at = a_from
        size = 0
        while i + size < a_to:
            while i + size < a_to and a[i : i + size + 1] in part:
                size += 1
                at = i
            i += 1
        j = b_from + part.find(a[at : at + size])
        while at > a_from and j > b_from and a[at - 1] == b[j - 1]:
            at, j, size = at - 1, j - 1, size + 1
        while at + size < a_to and j + size < b_to and a[at + size] == b[j + size]:
            size += 1
        if size:
            total += size
            if a_from < at and b_from < j:
                open_.append((a_from, at, b_from, j))
            if at + size < a_to and j + size < b_to:
                open_.append((at + size, a_to, j + size, b_to))
    return total


def _ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp similarity as of the standard library's sequence matcher; 0 when either is empty."""
    if not a or not b:
        return 0.0
    if "\0" in a or "\0" in b:
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * _matched(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity of two strings; 0 when either is empty."""
    for left, right in batches:
        yield pd.Series([_ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def title_similarity(left: Column | str, right: Column | str) -> Column:
    """Blend of sequence ratio and word overlap of two normalised strings; containment gives at least 0.95, empty ones 0."""
    left, right = _col(left), _col(right)
    ratio = sequence_ratio(left, right)
    held = F.contains(left, right) | F.contains(right, left)
    blend = 0.65 * ratio + 0.35 * jaccard(F.array_distinct(F.split(left, " ")), F.array_distinct(F.split(right, " ")))
    return F.when((left == "") | (right == ""), 0.0).when(held, F.greatest(ratio, F.lit(0.95))).otherwise(blend)


def fill_template(template: str, **values: Column | str) -> Column:
    """``template`` with each ``{name}`` or ``{name:.2f}`` replaced by the column of that name; a null reads as empty.

    The text between the slots is taken as it stands, so a prompt may hold percent signs and line breaks.
    """
    parts = []
    for text, name, form, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            value = _col(values[name])
            shown = F.format_string(f"%{form}", value) if form else value.cast("string")
            parts.append(F.coalesce(F.when(value.isNotNull(), shown), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def keyword_fallback(value: Column | str, words: Sequence[str], miss: float = 0.5) -> Column:
    """1 if the text holds every word, else ``miss``."""
    text = F.lower(_col(value))
    hit = F.lit(True)
    for word in words:
        hit = hit & text.contains(word)
    return F.when(hit, F.lit(1.0)).otherwise(F.lit(miss))


# --- articles -----------------------------------------------------------------


def reference_start(text: Column | str) -> Column:
    """1-based start of the reference section: the latest of the first hits of each heading; 0 without one."""
    lowered = F.lower(_col(text))
    return F.greatest(*[_first_match(lowered, heading) for heading in C.REFERENCE_HEADINGS])


def _first_match(text: Column, pattern: str) -> Column:
    head = F.split(text, pattern, 2)
    return F.when(F.size(head) > 1, F.length(head[0]) + 1).otherwise(F.lit(0))


def body_text(text: Column | str) -> Column:
    at = reference_start(text)
    return F.when(at > 0, F.substring(_col(text), F.lit(1), at - 1)).otherwise(F.coalesce(_col(text), F.lit("")))


def reference_text(text: Column | str) -> Column:
    at = reference_start(text)
    return F.when(at > 0, F.substring(_col(text), at, F.length(_col(text)))).otherwise(F.lit(""))


def _pieces(refs: str, numbers: str, pattern: str) -> Column:
    """Number ``n`` and text ``t`` of what may be entries, and as ``whole`` both, where a number passes 999."""
    found = lambda group: F.regexp_extract_all(refs, F.lit(f"(?msdU){pattern}"), F.lit(group))
    wholes = F.when(F.exists(numbers, lambda n: F.length(n) > 3), found(0)).otherwise(F.array().cast("array<string>"))
    pairs = F.zip_with(numbers, found(2), lambda n, t: F.struct(n.alias("n"), t.alias("t")))
    return F.zip_with(pairs, wholes, lambda p, w: F.struct(p["n"].alias("n"), p["t"].alias("t"), w.alias("whole")))


def _begun(pieces: str) -> Column:
    """The places at which entries begin, where a number passes 999; else null, as each piece is an entry.

    A number of four digits or more begins an entry only if it follows on the entry before; else, as a year at the start of
    a line, it belongs to that entry's text.
    """
    numbers = F.transform(pieces, lambda p, i: F.struct(i.alias("i"), (F.length(p["n"]) <= 3).alias("short"), p["n"].try_cast("int").alias("n")))
    begun = F.aggregate(
        numbers,
        F.struct(F.lit(-2).alias("last"), F.array().cast("array<int>").alias("at")),
        lambda a, e: F.when(
            e["short"] | (e["n"] == a["last"] + 1), F.struct(e["n"].alias("last"), F.array_append(a["at"], e["i"]).alias("at"))
        ).otherwise(a),
        lambda a: a["at"],
    )
    return F.when(F.exists(pieces, lambda p: p["whole"].isNotNull()), begun)


def _numbered(pieces: str, begun: str, marker: str) -> Column:
    def joined(i: Column, k: Column) -> Column:
        first, after = F.get(pieces, i), F.coalesce(F.get(begun, k + 1), F.size(pieces))
        rest = F.transform(F.slice(pieces, i + 2, after - i - 1), lambda p: p["whole"])
        return F.struct(first["n"].alias("n"), F.concat(first["t"], F.array_join(rest, "")).alias("t"))

    plain = F.transform(pieces, lambda p: F.struct(p["n"].alias("n"), p["t"].alias("t")))
    return F.transform(
        F.when(F.col(begun).isNull(), plain).otherwise(F.transform(begun, joined)),
        lambda e: F.struct(
            F.format_string(marker, e["n"].try_cast("int")).alias("marker"),
            e["n"].try_cast("int").alias("number"),
            squeeze(e["t"]).alias("entry"),
        ),
    )


def with_reference_entries(df: DataFrame, refs: str, out: str, minimum: int = 3) -> DataFrame:
    """Add the entries ``(marker, number, entry)`` of a numbered list: ``[n]`` style, else ``n.`` style.

    A style counts only with at least ``minimum`` hits; empty entries are left out. Lists may be longer than 999 entries.
    The steps of the two parses are columns of their own, so each runs once per row.
    """
    styles = {"_bracketed": (C.BRACKET_ENTRY, "[%d]"), "_dotted": (C.DOTTED_ENTRY, "%d")}
    staged = df.withColumns({f"{s}_n": F.regexp_extract_all(refs, F.lit(f"(?msdU){p}"), F.lit(1)) for s, (p, _) in styles.items()})
    staged = staged.withColumns({f"{s}_p": _pieces(refs, f"{s}_n", p) for s, (p, _) in styles.items()})
    staged = staged.withColumns({f"{s}_b": _begun(f"{s}_p") for s in styles})
    staged = staged.withColumns({s: _numbered(f"{s}_p", f"{s}_b", m) for s, (_, m) in styles.items()})
    chosen = (
        F.when(F.size("_bracketed") >= minimum, F.col("_bracketed"))
        .when(F.size("_dotted") >= minimum, F.col("_dotted"))
        .otherwise(F.slice("_dotted", 1, 0))
    )
    entries = staged.withColumn(out, F.filter(chosen, lambda e: e["entry"] != ""))
    return entries.drop(*[s + step for s in styles for step in ("", "_n", "_p", "_b")])


def author_year_entries(refs: Column | str, minimum_length: int = 40) -> Column:
    """Entries of an unnumbered author-year list, marked ``AY1``, ``AY2`` and so on."""
    text = F.replace(_col(refs), F.lit("\r"), F.lit("\n"))
    found = F.transform(F.regexp_extract_all(text, F.lit(f"(?msd){C.AUTHOR_YEAR_ENTRY}"), F.lit(1)), squeeze)
    kept = F.filter(found, lambda e: F.length(e) >= minimum_length)
    return F.transform(
        kept,
        lambda e, i: F.struct(
            F.concat(F.lit("AY"), (i + 1).cast("string")).alias("marker"), F.lit(None).cast("int").alias("number"), e.alias("entry")
        ),
    )


def sentences(text: Column | str) -> Column:
    """Non-blank sentences, untrimmed of nothing but outer space."""
    parts = F.split(_col(text), f"(?U){C.SENTENCE_BREAK}")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def expand_range(token: Column, widest: int = 20) -> Column:
    """Numbers a citation token stands for: ``7`` is 7, ``3-5`` is 3, 4, 5; anything else nothing.

    Most tokens are one number and are told first; both ends of a range are read once.
    """
    t = F.translate(F.trim(token), "–—", "--")
    low = F.regexp_extract(t, r"^\s*(\d{1,9})\s*-", 1).try_cast("int")
    high = F.regexp_extract(t, r"^\s*\d{1,9}\s*-\s*(\d{1,9})\s*$", 1).try_cast("int")
    none = F.array().cast("array<int>")

    def spanned(e: Column) -> Column:
        span = (e["low"] <= e["high"]) & (e["high"] - e["low"] <= widest)
        return F.when(F.coalesce(span, F.lit(False)), F.sequence(e["low"], F.least(e["high"], e["low"] + widest))).otherwise(none)

    ranged = F.flatten(F.transform(F.array(F.struct(low.alias("low"), high.alias("high"))), spanned))
    return F.when(t.rlike(r"^\d{1,9}$"), F.array(t.try_cast("int"))).when(t.contains("-"), ranged).otherwise(none)


def bracket_numbers(inside: Column) -> Column:
    """All numbers cited by the inside of one bracket."""
    return F.flatten(F.transform(F.split(inside, r"[,\s;]+"), lambda t: expand_range(t)))


def bracket_kind(inside: Column) -> Column:
    text = F.translate(inside, "–—", "--")
    return (
        F.when(text.contains(",") | text.contains(";"), F.lit("grouped"))
        .when(text.contains("-"), F.lit("range"))
        .otherwise(F.lit("exact"))
    )


def _window(parts: Column, position: Column) -> Column:
    """Sentence at a 0-based position with its two neighbours."""
    first = F.greatest(position, F.lit(1))
    count = F.least(position + 2, F.size(parts)) - first + 1
    return squeeze(F.array_join(F.slice(parts, first, count), " "))


def _brackets(parts: Column, position: Column) -> Column:
    """Insides of the brackets that open in a sentence; one still open at its end is completed from the next ones."""
    text = parts[position]
    closed = F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    open_end = F.regexp_extract(text, r"\[([^\]]*)$", 1)
    following = F.array_join(F.slice(parts, position + 2, F.greatest(F.size(parts) - position - 1, F.lit(0))), " ")
    completed = F.concat(open_end, F.lit(" "), F.regexp_extract(following, r"^([^\]]*)\]", 1))
    opens = text.rlike(r"\[[^\]]*$") & following.contains("]")
    return F.when(F.coalesce(opens, F.lit(False)), F.concat(closed, F.array(completed))).otherwise(closed)


def mention_index(sentence_column: str) -> Column:
    """Every bracket of a text as ``(window, kind, numbers)``, in text order, from a column of its sentences."""
    parts = F.col(sentence_column)
    per_sentence = F.transform(
        parts,
        lambda s, i: F.when(
            s.contains("["),
            F.transform(
                _brackets(parts, i),
                lambda b: F.struct(_window(parts, i).alias("window"), bracket_kind(b).alias("kind"), bracket_numbers(b).alias("numbers")),
            ),
        ).otherwise(F.array().cast("array<struct<window:string,kind:string,numbers:array<int>>>")),
    )
    return F.flatten(per_sentence)


def with_mentions(df: DataFrame, index: str, number: Column | str, out: str) -> DataFrame:
    """Add the mentions ``(window, kind)`` of one reference number; a window met again is left out."""
    wanted = df.withColumn("_number", _col(number))
    hits = F.filter(index, lambda m: F.array_contains(m["numbers"], F.col("_number")))
    found = wanted.withColumn("_hits", F.transform(hits, lambda m: F.struct(m["window"].alias("window"), m["kind"].alias("kind"))))
    listed = found.withColumn("_windows", F.transform("_hits", lambda m: m["window"]))
    fresh = F.filter("_hits", lambda m, i: F.array_position(F.col("_windows"), m["window"]) == i + 1)
    none = F.array().cast("array<struct<window:string,kind:string>>")
    return listed.withColumn(out, F.coalesce(fresh, none)).drop("_number", "_hits", "_windows")


def mentions_by_number(df: DataFrame, key: str, index: str) -> DataFrame:
    """``key, number, mentions``: for each reference number of a text its mentions ``(at, kind, window)`` in text order.

    A bracket becomes a row per number it cites, never a copy of the text's whole index; a window met again for the same
    number is left out. ``index`` should be a written column: an expression would be computed anew for each of its parts.
    """
    each = df.select(key, F.posexplode(index).alias("at", "m")).select(
        key, "at", "m.kind", "m.window", F.explode(F.array_distinct("m.numbers")).alias("number")
    )
    first = each.groupBy(key, "number", "window").agg(F.min(F.struct("at", "kind")).alias("f"))
    mention = F.struct(F.col("f.at").alias("at"), F.col("f.kind").alias("kind"), F.col("window"))
    return first.groupBy(key, "number").agg(F.array_sort(F.collect_list(mention)).alias("mentions"))


def surname(author: Column | str) -> Column:
    """Last word of the normalised author name."""
    return F.element_at(F.split(normalise_loose(author), " "), -1)


def author_year_mentions(sentence_column: str, surname_column: str, year: Column | str) -> Column:
    """Sentences (with their neighbours) that name the author together with the year."""
    name, target = F.col(surname_column), _col(year).cast("string")
    parts = F.col(sentence_column)
    word = F.concat(F.lit(r"\b"), name, F.lit(r"\b"))
    patterns = [
        F.concat(F.lit("(?i)"), word, F.lit(r"[^.()\\n]{0,40}(?:19|20)\d{2}")),
        F.concat(F.lit("(?i)"), word, F.lit(r"\s*(?:et al\.?|and [A-Z][a-zA-Z'`-]+)?\s*\((?:19|20)\d{2}\)")),
        F.concat(F.lit(r"(?i)\([^)]*?"), word, F.lit(r"[^)]*?(?:19|20)\d{2}[^)]*?\)")),
    ]

    def cited(s: Column) -> Column:
        hit = F.rlike(s, patterns[0]) | F.rlike(s, patterns[1]) | F.rlike(s, patterns[2])
        return s.contains(target) & hit

    windows = F.transform(parts, lambda s, i: F.when(cited(s), _window(parts, i)))
    found = F.array_distinct(F.filter(windows, lambda w: w.isNotNull() & (w != "")))
    usable = (F.coalesce(name, F.lit("")) != "") & target.isNotNull()
    return F.when(usable, found).otherwise(F.array().cast("array<string>"))


def doi(text: Column | str) -> Column:
    """First DOI in a text, lower case; empty without one."""
    return F.regexp_extract(F.lower(_col(text)), f"({C.DOI})", 1)


def cue_words(text: Column | str, cues: Sequence[str] = C.HARD_CASE_CUES) -> Column:
    """Distinct cue words in the text, sorted."""
    pattern = r"(?i)\b(" + "|".join(cues) + r")\b"
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(pattern), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def poor_quality(text: Column | str, shortest: int = 2000, share: float = 0.01) -> Column:
    """A short text, or one with too many replacement characters."""
    length = F.length(_col(text))
    odd = length - F.length(F.replace(_col(text), F.lit("�"), F.lit("")))
    return (length < shortest) | (odd / F.greatest(F.lit(1), length) > share)
