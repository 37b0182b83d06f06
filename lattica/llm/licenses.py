"""License scans: ordered signature rules over whole texts, in SQL expressions alone.

A rule is a regular expression with a keyword that every match must contain. A text is
looked at by the rules whose keyword it contains, and only if a word begins with any; one
regular expression tells that. Every match is an interval of characters with its rule's priority. In order of start, a
detection is dropped when one of equal or higher priority before it reaches as far: it
lies inside that one. What stays gives labels and a score.

Rules are identifiers, names and versions per family, and the wording of grants, notices
and disclaimers (:mod:`lattica.llm.license_texts`), some hundreds in all. Patterns are
literals, so a task compiles each once. Places of matches are running sums of lengths,
taken block by block, so a text of very many matches takes time in proportion to them.
Everything is a projection of one row: no shuffle, no join.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.license_texts import TEXTS

#: Characters that are no part of a word, as fixed by the task.
_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[a-z0-9A-Z\x80-\x{10FFFF}]+"
#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


class Rule(NamedTuple):
    """Priority 1 is highest: identifiers and addresses, named versions, names, hints."""

    name: str
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


G = r"[^a-z0-9]{1,12}"  # what may stand between two words
L = r"licen[cs]e"
V = rf"(?:,?{G})?(?:v(?:ersion)?\.?[ ]?)?"
UNDER = rf"(?:(?:licen[cs]ed|released|distributed|available){G}under{G}(?:the{G})?(?:terms{G}of{G}(?:the{G})?)?(?:gnu{G})?)?"
LEFT, RIGHT = r"(?<![a-z0-9])", r"(?![a-z0-9])"

#: (label, SPDX names, keyword, pattern of the full name, pattern of a short name, versions)
FAMILIES: tuple[tuple[str, str, str, str, str, tuple[str, ...]], ...] = (
    ("agpl", "agpl", "gpl", rf"affero{G}general{G}public{G}{L}", "agpl", ("1.0", "3.0")),
    ("lgpl", "lgpl", "gpl", rf"(?:lesser|library){G}general{G}public{G}{L}", "lgpl", ("2.0", "2.1", "3.0")),
    ("gpl", "gpl", "gpl", rf"general{G}public{G}{L}", "gpl", ("1.0", "2.0", "3.0")),
    ("gfdl", "gfdl", "gfdl", rf"free{G}documentation{G}{L}", "gfdl", ("1.1", "1.2", "1.3")),
    ("apache", "apache", "apache", rf"apache(?:{G}software)?{G}{L}", "apache", ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", "mpl", rf"mozilla{G}public{G}{L}", "mpl", ("1.0", "1.1", "2.0")),
    ("epl", "epl", "epl", rf"eclipse{G}public{G}{L}", "epl", ("1.0", "2.0")),
    ("cddl", "cddl", "cddl", rf"common{G}development{G}and{G}distribution{G}{L}", "cddl", ("1.0", "1.1")),
    ("cpl", "cpl", "cpl", rf"common{G}public{G}{L}", "cpl", ("1.0",)),
    ("eupl", "eupl", "eupl", rf"european{G}union{G}public{G}{L}", "eupl", ("1.0", "1.1", "1.2")),
    ("osl", "osl", "osl", rf"open{G}software{G}{L}", "osl", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "afl", "afl", rf"academic{G}free{G}{L}", "afl", ("1.1", "2.0", "2.1", "3.0")),
    ("artistic", "artistic", "artistic", rf"artistic{G}{L}", "artistic", ("1.0", "2.0")),
    ("ofl", "ofl", "ofl", rf"open{G}font{G}{L}", "ofl", ("1.0", "1.1")),
    ("psf", "psf", "psf", rf"python{G}software{G}foundation{G}{L}", "psf", ("2.0",)),
    ("bsl", "bsl", "bsl", rf"boost{G}software{G}{L}", "bsl", ("1.0",)),
    ("busl", "busl", "busl", rf"business{G}source{G}{L}", "busl", ("1.1",)),
    ("lppl", "lppl", "lppl", rf"latex{G}project{G}public{G}{L}", "lppl", ("1.0", "1.1", "1.2", "1.3c")),
    ("cecill", "cecill", "cecill", rf"cecill{G}{L}", "cecill", ("1.0", "1.1", "2.0", "2.1")),
    ("zpl", "zpl", "zpl", rf"zope{G}public{G}{L}", "zpl", ("1.1", "2.0", "2.1")),
    ("php", "php", "php", rf"php{G}{L}", "php", ("3.0", "3.01")),
    ("w3c", "w3c", "w3c", rf"w3c{G}software{G}(?:notice{G}and{G})?{L}", "w3c", ("19980720", "20150513")),
    ("unicode", "unicode", "unicode", rf"unicode{G}(?:{L}|terms{G}of{G}use)", "unicode", ("3.0",)),
    ("vim", "vim", "vim", rf"vim{G}{L}", "vim", ()),
    ("ncsa", "ncsa", "ncsa", rf"ncsa{G}open{G}source{G}{L}", "ncsa", ()),
    ("isc", "isc", "isc", rf"isc{G}{L}", "isc", ()),
    ("zlib", "zlib", "zlib", rf"zlib(?:/libpng)?{G}{L}", "zlib", ()),
    ("wtfpl", "wtfpl", "wtfpl", rf"do{G}what{G}the{G}f\w+{G}you{G}want{G}to{G}public{G}{L}", "wtfpl", ()),
    ("unlicense", "unlicense", "unlicense", "unlicense", "unlicense", ()),
    ("postgresql", "postgresql", "postgresql", rf"postgresql{G}{L}", "postgresql", ()),
    ("openssl", "openssl", "openssl", rf"openssl{G}{L}", "openssl", ()),
    ("ms-pl", "ms-pl", "ms-pl", rf"microsoft{G}public{G}{L}", "ms-pl", ()),
    ("ms-rl", "ms-rl", "ms-rl", rf"microsoft{G}reciprocal{G}{L}", "ms-rl", ()),
)

#: Word that every full name of a family holds, where it is not the short name.
_NAMED = {
    "agpl": "affero", "lgpl": "general", "gpl": "general", "gfdl": "documentation", "mpl": "mozilla", "epl": "eclipse", "cddl": "distribution", "cpl": "common",
    "eupl": "european", "osl": "software", "afl": "academic", "ofl": "font", "psf": "python", "bsl": "boost", "busl": "business", "lppl": "latex", "zpl": "zope",
    "wtfpl": "public", "ms-pl": "microsoft", "ms-rl": "microsoft",
}

#: Creative Commons kinds: label, short form, long form.
CC_KINDS = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", rf"by{G}sa", rf"attribution{G}share{G}?alike"),
    ("cc-by-nd", rf"by{G}nd", rf"attribution{G}no{G}?deriv\w+"),
    ("cc-by-nc", rf"by{G}nc", rf"attribution{G}non{G}?commercial"),
    ("cc-by-nc-sa", rf"by{G}nc{G}sa", rf"attribution{G}non{G}?commercial{G}share{G}?alike"),
    ("cc-by-nc-nd", rf"by{G}nc{G}nd", rf"attribution{G}non{G}?commercial{G}no{G}?deriv\w+"),
)
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Phrasings that no family has: label, keyword, pattern, priority, weight.
OTHERS: tuple[tuple[str, str, str, int, float], ...] = (
    ("mit", "licen", rf"mit{G}{L}", 3, 0.9),
    ("mit", "licen", rf"(?:licen[cs]ed|released|distributed|available){G}under{G}(?:the{G})?(?:terms{G}of{G}the{G})?mit{G}{L}", 2, 0.95),
    ("mit", "spdx", rf"spdx-licen[cs]e-identifier:[ ]?mit{RIGHT}", 1, 1.0),
    ("mit", "permission", rf"permission{G}is{G}hereby{G}granted,{G}free{G}of{G}charge", 2, 0.95),
    ("bsd", "bsd", rf"bsd{G}{L}", 3, 0.8),
    ("bsd-2-clause", "bsd", rf"(?:2|two)-clause{G}bsd|bsd{G}(?:2|two){G}clause|simplified{G}bsd{G}{L}|freebsd{G}{L}", 2, 0.95),
    ("bsd-3-clause", "bsd", rf"(?:3|three)-clause{G}bsd|bsd{G}(?:3|three){G}clause|(?:new|modified|revised){G}bsd{G}{L}", 2, 0.95),
    ("bsd-4-clause", "bsd", rf"(?:4|four)-clause{G}bsd|bsd{G}(?:4|four){G}clause|original{G}bsd{G}{L}", 2, 0.95),
    ("0bsd", "bsd", rf"0bsd|zero-clause{G}bsd", 2, 0.95),
    ("bsd", "redistribution", rf"redistribution{G}and{G}use{G}in{G}source{G}and{G}binary{G}forms", 2, 0.9),
    ("cc0", "cc0", rf"cc0(?:{G}1\.0)?", 2, 0.95),
    ("cc0", "creative", rf"creative{G}commons{G}zero", 2, 0.95),
    ("public-domain", "public", rf"(?:in|into|to){G}the{G}public{G}domain|public{G}domain{G}dedication", 2, 0.9),
    ("public-domain", "public", rf"public{G}domain", 4, 0.5),
    ("creative-commons", "creative", rf"creative{G}commons", 4, 0.5),
    ("copyright", "copyright", rf"copyright{G}(?:\(c\){G})?(?:19|20)[0-9]{{2}}", 3, 0.7),
    ("copyright", "copyright", "copyrighted|copyright", 4, 0.3),
    ("reserved", "reserved", rf"all{G}rights{G}reserved", 2, 0.9),
    ("reserved", "reserved", rf"(?:some|no){G}rights{G}reserved", 3, 0.6),
    ("proprietary", "proprietary", rf"proprietary{G}and{G}confidential|confidential{G}and{G}proprietary", 2, 0.95),
    ("proprietary", "proprietary", rf"proprietary{G}(?:software|{L}|information)", 3, 0.7),
    ("proprietary", "not", rf"(?:may|must){G}not{G}be{G}(?:copied|reproduced|distributed){G}\w+", 4, 0.5),
    ("commercial", "commercial", rf"commercial{G}{L}", 3, 0.6),
    ("non-commercial", "commercial", rf"non{G}?commercial{G}(?:use|purposes?){G}only", 2, 0.8),
    ("unknown-license", "under", rf"(?:licen[cs]ed|released|distributed){G}under{G}(?:the{G})?(?:terms{G}of{G}(?:the{G})?)?[a-z0-9.-]+", 4, 0.4),
    ("unknown-license", "see", rf"see{G}(?:the{G})?(?:file{G})?(?:{L}|copying){G}(?:file{G})?for{G}(?:more{G})?(?:details|terms|information)", 4, 0.4),
)


_TOKEN = re.compile(r"\(([^()]*)\)(\??)|((?:\[[^\]]*\](?:\{[^}]*\})?|[^\s\[])+)")
def phrase_pattern(phrase: str) -> str:
    """The regular expression of a phrase of :data:`TEXTS`."""
    out = ""
    for m in _TOKEN.finditer(phrase):
        part = m[3] or "(?:" + re.sub(r"[ ]+(?![^\[]*\])", lambda _: G, m[1]) + ")"
        out += f"(?:{part}{G})?" if m[2] else part + G
    return out[: -len(G)] if out.endswith(G) else out


def phrase_keyword(phrase: str) -> str:
    """The longest run of letters at the beginning of a word that every match of a phrase holds."""
    words = [m[3] for m in _TOKEN.finditer(phrase) if m[3]]
    fixed = [w for word in words for w in re.findall(r"\A[a-z0-9]+(?![?{*a-z0-9])|\A[a-z0-9]+(?=[a-z0-9][?{*])", word)]
    return max((w for w in fixed if w not in _GATES), key=len)


#: Labels whose phrases do not follow "licensed under".
_ALONE = ("unknown", "copyright", "reserved", "proprietary", "commercial", "non-commercial", "public-domain")


def rules() -> list[Rule]:
    """All rules, in order of priority, then as listed."""
    out: list[Rule] = []

    def add(label: str, keyword: str, pattern: str, priority: int, weight: float) -> None:
        lead = UNDER if 1 < priority and not label.startswith(_ALONE) else ""
        out.append(Rule(f"r{len(out):03d}-{label}", label, keyword, f"{LEFT}{lead}(?:{pattern})", priority, weight))

    for label, spdx, short, full, brief, versions in FAMILIES:
        named = _NAMED.get(label, short)
        for v in versions:
            n = v.replace(".", r"\.")
            bare = rf"{n}|{v[:-2]}(?!\.?[0-9])" if v.endswith(".0") else n
            only = rf"(?:-only|-or-later|\+)?{RIGHT}"
            add(f"{label}-{v}", "spdx", rf"spdx-licen[cs]e-identifier:[ ]?{spdx}-{n}{only}", 1, 1.0)
            add(f"{label}-{v}", "licenses", rf"(?:gnu|apache|mozilla|eclipse|opensource|spdx)\.org/licenses/(?:old-licenses/)?{spdx}[-/]?(?:license-)?(?:{bare}){RIGHT}", 1, 1.0)
            add(f"{label}-{v}", named, rf"{full}{V}(?:{bare}){RIGHT}", 2, 0.95)
            add(f"{label}-{v}", short, rf"{brief}[- ]?v?(?:{bare}){only}", 3, 0.8)
        if not versions:
            add(label, "spdx", rf"spdx-licen[cs]e-identifier:[ ]?{spdx}{RIGHT}", 1, 1.0)
        add(label, named, rf"{full}{RIGHT}", 3, 0.8)
        add(label, short, rf"(?:under|terms{G}of){G}(?:the{G})?{brief}{RIGHT}", 4, 0.5)
    for label, short, full in CC_KINDS:
        for v in CC_VERSIONS:
            n = v.replace(".", r"\.")
            add(f"{label}-{v}", "spdx", rf"spdx-licen[cs]e-identifier:[ ]?{label}-{n}{RIGHT}", 1, 1.0)
            add(f"{label}-{v}", "creativecommons", rf"creativecommons\.org/licenses/{label[3:]}/{n}{RIGHT}", 1, 1.0)
            add(f"{label}-{v}", "cc", rf"cc{G}{short}{G}(?:v?){n}{RIGHT}", 2, 0.95)
            add(f"{label}-{v}", "attribution", rf"{full}{G}{n}{RIGHT}", 2, 0.95)
        add(label, "cc", rf"cc{G}{short}{RIGHT}", 3, 0.8)
        add(label, "attribution", rf"creative{G}commons{G}{full}{RIGHT}", 3, 0.8)
    for label, keyword, pattern, priority, weight in OTHERS:
        add(label, keyword, rf"(?:{pattern}){RIGHT}", priority, weight)
    for label, weight, phrase in (t for texts in TEXTS.values() for t in texts):
        out.append(Rule(f"r{len(out):03d}-{label}", label, phrase_keyword(phrase), f"{LEFT}(?:{phrase_pattern(phrase)}){RIGHT}", 2 if weight >= 0.8 else 3 if weight >= 0.5 else 4, weight))
    return sorted(out, key=lambda r: r.priority)


#: Words that may begin otherwise than the keyword of their rule.
_BEGINNINGS = {"gpl": ("gpl", "agpl", "lgpl"), "bsd": ("bsd", "freebsd", "0bsd"), "commercial": ("commercial", "noncommercial")}


def _beginnings(found: list[Rule]) -> dict[str, list[str]]:
    """Of each keyword the word beginnings that open its rules; none of all is a prefix of another."""
    own = {r.keyword: _BEGINNINGS.get(r.keyword, (r.keyword,)) for r in found}
    every = {b for bs in own.values() for b in bs}
    least = {b: min((a for a in every if b.startswith(a)), key=len) for b in every}
    return {k: sorted({least[b] for b in bs}) for k, bs in own.items()}


def opening(found: list[Rule]) -> str:
    """A regular expression that every match of every rule holds: one of the rules' keywords
    at the beginning of a word. It is looked for at beginnings only, first letter first."""
    by_letter: dict[str, list[str]] = {}
    for a in sorted({b for bs in _beginnings(found).values() for b in bs}):
        by_letter.setdefault(a[0], []).append(a[1:])
    return f"{LEFT}(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ")"


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Lengths of all matches of a rule and of what stands before, between and after them.
_CUT = "struct<label: string, priority: int, weight: double, hits: array<int>, gaps: array<int>>"
_SPAN = "struct<begin: int, behind: int, priority: int, label: string, weight: double>"
#: Matches whose places are summed up in one go; arrays of more would be copied too often.
_BLOCK = 64


#: What else every match holds for the rules of a keyword that is too common alone.
_GATES = {
    "cc": rf"{LEFT}cc{G}by", "public": rf"public{G}(?:domain|{L})", "common": rf"common{G}public", "software": rf"open{G}software",
    "not": rf"not{G}be{G}(?:copied|reproduced|distributed)", "under": rf"ed{G}under", "see": rf"see{G}(?:the{G})?(?:file{G})?(?:{L}|copying)",
}


def _detections(text: str, begins: str, found: list[Rule]) -> str:
    """SQL for all intervals in ``text`` of the rules that its keywords let through, in order.

    ``begins`` is the array of what :func:`opening` finds in it.

    ``behind`` is the negated end, so that the natural order of the structs is by start,
    longest first, then priority.
    """
    groups: dict[str, list[Rule]] = {}
    for r in found:
        groups.setdefault(r.keyword, []).append(r)
    # Within the lambda patterns are literals of an interpreted expression, not of generated code.
    lengths = lambda strings: f"transform({strings}, s -> length(s))"
    cut = lambda r, p: f"IF(x.t RLIKE {p}, struct({_quote(r.label)}, {r.priority}, {r.weight}D, {lengths(f'regexp_extract_all(x.t, {p}, 0)')}, {lengths(f'split(x.t, {p})')}), NULL)"
    starts = _beginnings(found)

    def opens(k: str) -> str:
        word = " OR ".join(f"array_contains(x.b, {_quote(b)})" for b in starts[k])
        return f"({word})" + (f" AND contains(x.t, {_quote(k)})" if starts[k] != [k] else "") + (f" AND x.t RLIKE {_quote(_GATES[k])}" if k in _GATES else "")

    tables = ", ".join(f"IF({opens(k)}, array({', '.join(cut(r, _quote(r.pattern)) for r in rs)}), NULL)" for k, rs in groups.items())
    cuts = f"cast(filter(flatten(filter(array({tables}), g -> g IS NOT NULL)), c -> c IS NOT NULL) as array<{_CUT}>)"
    cuts = f"flatten(transform(array(struct({text} AS t, {begins} AS b)), x -> {cuts}))"
    # Each transform names what the next one uses more than once.
    cuts = f"transform({cuts}, c -> struct(c.label, c.priority, c.weight, c.gaps, transform(c.hits, (h, i) -> h + c.gaps[i]) AS steps))"
    sums = f"transform(sequence(0, (size(c.steps) - 1) div {_BLOCK}), b -> aggregate(slice(c.steps, b * {_BLOCK} + 1, {_BLOCK}), 0, (at, n) -> at + n))"
    bases = f"aggregate({sums}, struct(0 AS at, cast(array() AS array<int>) AS bases), (acc, n) -> struct(acc.at + n AS at, array_append(acc.bases, acc.at) AS bases), acc -> acc.bases)"
    cuts = f"transform({cuts}, c -> struct(c.label, c.priority, c.weight, c.gaps, c.steps, {bases} AS bases))"
    spans = f"""
        aggregate(sequence(b * {_BLOCK}, least(size(c.steps), (b + 1) * {_BLOCK}) - 1),
            struct(base AS at, cast(array() AS array<{_SPAN}>) AS spans),
            (acc, k) -> struct(
                acc.at + c.steps[k] AS at,
                array_append(acc.spans, struct(acc.at + c.gaps[k] AS begin, -(acc.at + c.steps[k]) AS behind, c.priority AS priority, c.label AS label, c.weight AS weight)) AS spans),
            acc -> acc.spans)"""
    return f"array_sort(flatten(transform({cuts}, c -> flatten(transform(c.bases, (base, b) -> {spans})))))"


def _resolve(detections: str) -> str:
    """SQL for (labels, miss): the labels that stay and the product of 1 - weight over them.

    ``reach_p`` is the furthest end so far of a detection of priority p or higher.
    """
    reach = ", ".join(f"0 AS reach_{p}" for p in (1, 2, 3, 4))
    further = ", ".join(f"greatest(acc.reach_{p}, if(d.priority <= {p}, -d.behind, 0)) AS reach_{p}" for p in (1, 2, 3, 4))
    stays = "-d.behind > CASE d.priority WHEN 1 THEN acc.reach_1 WHEN 2 THEN acc.reach_2 WHEN 3 THEN acc.reach_3 ELSE acc.reach_4 END"
    return f"""
        aggregate({detections},
            struct(cast(array() as array<string>) AS labels, 1D AS miss, {reach}),
            (acc, d) -> struct(
                if({stays}, array_union(acc.labels, array(d.label)), acc.labels) AS labels,
                if({stays}, acc.miss * (1D - d.weight), acc.miss) AS miss, {further}),
            acc -> struct(acc.labels AS labels, acc.miss AS miss))"""


def _phrase(words: str) -> str:
    return rf"(?<!{_WORD[:-1]}){(_SEP + '+').join(words.split())}(?!{_WORD[:-1]})"


def scan_licenses(docs: DataFrame, extra: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words, base phrases and their places are those of the text with A-Z lower-cased; the
    labels are distinct, sorted and joined by commas (empty: none). ``score`` is one minus
    the product of ``1 - weight`` over all detections that stay, 0 without any. A null
    text is an empty one. Rows that repeat are scanned each for itself; other columns
    are ignored. ``extra`` rules come after the built-in ones of their priority.
    """
    found = sorted(rules() + (extra or []), key=lambda r: r.priority)
    base = "(?i)(?:" + "|".join(_phrase(p) for p, _ in BASE) + ")"
    # Phrases are ASCII, so a text without their rarest words in lower case has none.
    hint = F.expr("(contains(low, 'cc') AND contains(low, 'by')) OR contains(low, 'license') OR contains(low, 'reserved')")
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("raw"))
    words = lambda c: F.regexp_count(c, F.lit(_WORD)).cast("long")
    rows = raw.withColumns({"n_words": words(F.col("raw")), "low": F.lower("raw")})
    rows = rows.withColumn("n_base", F.when(hint, F.regexp_count("raw", F.lit(base)).cast("long")).otherwise(F.lit(0).cast("long")))
    gaps = F.split("raw", base)
    hits = F.regexp_extract_all("raw", F.lit(base), F.lit(0))
    any_base = F.col("n_base") > 0
    is_phrase = lambda p: F.col("raw").rlike("(?i)" + _phrase(p))
    base_labels = F.array_compact(F.array(*[F.when(any_base & is_phrase(p), F.lit(label)) for p, label in BASE]))
    rows = rows.withColumn("begins", F.array_distinct(F.regexp_extract_all("low", F.lit(opening(found)), F.lit(0))))
    rows = rows.withColumns({
        "first_word": F.when(any_base, words(gaps[0])),
        "last_word": F.when(any_base, F.col("n_words") - words(F.element_at(gaps, -1)) - words(F.element_at(hits, -1))),
        "base": base_labels,
        "found": F.when(F.size("begins") > 0, F.expr(_resolve(_detections("low", "begins", found)))),
    })
    every = F.array_sort(F.array_union("base", F.coalesce(F.col("found.labels"), F.array().cast("array<string>"))))
    score = F.coalesce(1.0 - F.col("found.miss"), F.lit(0.0))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
