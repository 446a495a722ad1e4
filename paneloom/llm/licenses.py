"""License notices in texts, by ordered signature rules, in DataFrame functions only.

A text becomes its words, lower-cased and joined by single spaces. Few stems decide
whether it can hold any notice, keywords decide which rules can match; only those regular
expressions run. Detections are sorted by start, longest first, and one that lies inside
another of the same or a higher rank is suppressed. Everything happens within a row, so
there is no shuffle and no key to be hot.

Defined cases. A null or empty text has no words and no detections. Equal intervals are
resolved by rank, then by the order of the rules. Repeated rows get equal results. An empty
table gives no rows. Other columns are carried in `row`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import lower_ascii

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RANKS = 4

# Fixed values of the contract: phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Public license identifiers, a keyword (any characters) that each name holds, and its name in
# words. The identifiers without a version stand for a name that gives none.
V = r"(?:v|v |ver |version |versions )"
NAMES = (
    ("gpl-1.0", "general public", rf"gnu general public license {V}1(?: 0)?"),
    ("gpl-2.0", "general public", rf"gnu general public license {V}2(?: 0)?"),
    ("gpl-3.0", "general public", rf"gnu general public license {V}3(?: 0)?"),
    ("gpl-2.0-or-later", "general public",
     rf"gnu general public license {V}2(?: 0)? or (?:any )?later(?: version)?"),
    ("gpl-3.0-or-later", "general public",
     rf"gnu general public license {V}3(?: 0)? or (?:any )?later(?: version)?"),
    ("lgpl-2.0", "general public", rf"gnu library general public license(?: {V}2(?: 0)?)?"),
    ("lgpl-2.1", "general public", rf"gnu lesser general public license {V}2 1"),
    ("lgpl-3.0", "general public", rf"gnu lesser general public license {V}3(?: 0)?"),
    ("agpl-3.0", "general public", rf"gnu affero general public license(?: {V}3(?: 0)?)?"),
    ("gfdl-1.3", "documentation license", rf"gnu free documentation license(?: {V}1 3)?"),
    ("apache-1.1", "apache", rf"apache (?:software )?license {V}1 1"),
    ("apache-2.0", "apache", rf"apache (?:software )?license {V}?2(?: 0)?"),
    ("gpl", "general public", r"gnu general public licen[sc]e"),
    ("lgpl", "general public", r"gnu lesser general public licen[sc]e"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e"),
    ("mpl", "mozilla public", r"mozilla public licen[sc]e"),
    ("epl", "eclipse public", r"eclipse public licen[sc]e"),
    ("eupl", "european union public", r"european union public licen[sc]e"),
    ("artistic", "artistic license", r"artistic license"),
    ("cc-by", "cc by", r"cc by"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("mit", "mit licen", r"mit licen[sc]e"),
    ("mit", "expat", r"(?:mit expat|expat mit|expat) licen[sc]e"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: license)?"),
    ("mit-modern", "mit license modern", r"mit license modern variant"),
    ("x11", "x11 license", r"(?:mit )?x11 license"),
    ("isc", "isc license", r"isc license"),
    ("bsd-0-clause", "bsd", r"(?:bsd zero clause|0 clause bsd|zero clause bsd)(?: license)?"),
    ("bsd-1-clause", "bsd", r"(?:bsd 1 clause|1 clause bsd)(?: license)?"),
    ("bsd-2-clause", "bsd",
     r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd|two clause bsd)(?: license)?"),
    ("bsd-3-clause", "bsd",
     r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|three clause bsd)(?: license)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?"),
    ("mpl-1.0", "mozilla public", rf"mozilla public license {V}1 0"),
    ("mpl-1.1", "mozilla public", rf"mozilla public license {V}1 1"),
    ("mpl-2.0", "mozilla public", rf"mozilla public license {V}?2(?: 0)?"),
    ("epl-1.0", "eclipse public", rf"eclipse public license {V}?1 0"),
    ("epl-2.0", "eclipse public", rf"eclipse public license {V}?2 0"),
    ("cpl-1.0", "common public", rf"common public license(?: {V}?1 0)?"),
    ("cddl-1.0", "common development", rf"common development and distribution license(?: {V}?1 0)?"),
    ("eupl-1.1", "european union public", rf"european union public licen[cs]e {V}?1 1"),
    ("eupl-1.2", "european union public", rf"european union public licen[cs]e {V}?1 2"),
    ("osl-3.0", "open software license", rf"open software license {V}?3 0"),
    ("afl-3.0", "academic free", rf"academic free license(?: {V}?3 0)?"),
    ("artistic-1.0", "artistic license", rf"artistic license {V}?1(?: 0)?"),
    ("artistic-2.0", "artistic license", rf"artistic license {V}?2(?: 0)?"),
    ("bsl-1.0", "boost software", rf"boost software license(?: {V}?1 0)?"),
    ("zlib", "zlib", r"(?:zlib|zlib libpng) license"),
    ("libpng", "libpng license", r"libpng license(?: version 2)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "public license", r"do what the fuck you want to public license"),
    ("python-2.0", "python", rf"python (?:software foundation )?license(?: {V}?2(?: 0)?)?"),
    ("php-3.01", "php license", rf"php license(?: {V}?3 01)?"),
    ("ruby", "ruby license", r"ruby license"),
    ("openssl", "openssl license", r"openssl license"),
    ("ms-pl", "microsoft public", r"microsoft public license"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal license"),
    ("ofl-1.1", "open font", rf"(?:sil )?open font license(?: {V}?1 1)?"),
    ("odbl-1.0", "open database", rf"open database license(?: {V}?1 0)?"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution license"),
    ("pddl-1.0", "open data commons", r"open data commons public domain dedication and license"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-2.0", "cc by", r"cc by 2 0"),
    ("cc-by-3.0", "cc by", r"cc by 3 0"),
    ("cc-by-4.0", "cc by", r"cc by 4 0"),
    ("cc-by-sa-3.0", "cc by sa", r"cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc by sa", r"cc by sa(?: 4 0)?"),
    ("cc-by-nc-4.0", "cc by nc", r"cc by nc(?: 4 0)?"),
    ("cc-by-nd-4.0", "cc by nd", r"cc by nd(?: 4 0)?"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", r"cc by nc sa(?: 4 0)?"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", r"cc by nc nd(?: 4 0)?"),
    ("cc-by-4.0", "creative commons", r"creative commons attribution 4 0(?: international)?"),
    ("cc-by-sa-4.0", "creative commons",
     r"creative commons attribution share ?alike 4 0(?: international)?"),
    ("cc-by-nc-4.0", "creative commons",
     r"creative commons attribution non ?commercial 4 0(?: international)?"),
)

# Abbreviated names as they stand in prose, with a keyword. "GPLv2" is one word, "LGPL-2.1" three.
W = r" ?(?:v ?|ver |version )?"
LATER = r" or (?:any )?(?:later|newer|greater)(?: version)?"
ABBREVIATED = (
    ("gpl", "gpl", r"(?:gnu gpl(?: licen[sc]e)?|gpl licen[sc]e)"),
    ("gpl-1.0", "gpl", rf"(?:gnu )?gpl{W}1(?: 0)?"),
    ("gpl-2.0", "gpl", rf"(?:gnu )?gpl{W}2(?: 0)?(?: only)?"),
    ("gpl-3.0", "gpl", rf"(?:gnu )?gpl{W}3(?: 0)?(?: only)?"),
    ("gpl-2.0-or-later", "gpl", rf"(?:gnu )?gpl{W}2(?: 0)?{LATER}"),
    ("gpl-3.0-or-later", "gpl", rf"(?:gnu )?gpl{W}3(?: 0)?{LATER}"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: licen[sc]e)?"),
    ("lgpl-2.0", "lgpl", rf"(?:gnu )?lgpl{W}2(?: 0)?"),
    ("lgpl-2.1", "lgpl", rf"(?:gnu )?lgpl{W}2 1"),
    ("lgpl-3.0", "lgpl", rf"(?:gnu )?lgpl{W}3(?: 0)?"),
    ("agpl", "agpl", r"(?:gnu )?agpl(?: licen[sc]e)?"),
    ("agpl-3.0", "agpl", rf"(?:gnu )?agpl{W}3(?: 0)?"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl(?: licen[sc]e)?"),
    ("gfdl-1.3", "gfdl", rf"(?:gnu )?gfdl{W}1 3"),
    ("mpl", " mpl", r"mpl licen[sc]e"),
    ("mpl-1.0", " mpl", rf"mpl{W}1 0"),
    ("mpl-1.1", " mpl", rf"mpl{W}1 1"),
    ("mpl-2.0", " mpl", rf"mpl{W}2(?: 0)?"),
    ("epl-1.0", " epl", rf"epl{W}1 0"),
    ("epl-2.0", " epl", rf"epl{W}2 0"),
    ("cddl-1.0", " cddl", rf"cddl(?:{W}1 0)?"),
    ("eupl-1.1", " eupl", rf"eupl{W}1 1"),
    ("eupl-1.2", " eupl", rf"eupl{W}1 2"),
)
# Names too short or too general to stand for a license outside of a sentence about one.
IN_CONTEXT = (
    ("gpl", "gpl", r"gpl(?: licen[sc]e)?"),
    ("mpl", " mpl", r"mpl(?: licen[sc]e)?"),
    ("epl", " epl", r"epl(?: licen[sc]e)?"),
    ("eupl", " eupl", r"eupl(?: licen[sc]e)?"),
    ("apache-2.0", "apache", rf"apache{W}2(?: 0)?"),
    ("mit", " mit ", r"mit"),
    ("bsd", "bsd", r"bsd(?: style)?"),
)

# Sentences that stand for a license without naming it.
SENTENCES = (
    ("mit", "permission is hereby granted",
     r"permission is hereby granted free of charge to any person obtaining a copy of this software"
     r" and associated documentation files"),
    ("isc", "permission to use copy modify",
     r"permission to use copy modify and or distribute this software for any purpose with or"
     r" without fee is hereby granted"),
    ("bsd", "redistribution and use",
     r"redistribution and use in source and binary forms with or without modification are"
     r" permitted"),
    ("apache-2.0", "apache", r"www apache org licenses license 2 0(?: txt| html)?"),
    ("gpl", "gnu org", r"www gnu org licenses (?:gpl|old licenses gpl)(?: [0-9]+)*(?: html| txt)?"),
    ("gpl", "free software foundation",
     r"under the terms of the gnu general public license as published by the free software"
     r" foundation"),
    ("lgpl", "free software foundation",
     r"under the terms of the gnu (?:lesser|library) general public license as published by the"
     r" free software foundation"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by [0-9] [0-9]"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [0-9] [0-9]"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc [0-9] [0-9]"),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "public domain",
     r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
)

#: A text without any of these has no match: every rule's words hold one of them.
STEMS = (
    "licen", "cc by", "cc0", "bsd", "public domain", "rights reserved", "hereby granted",
    "redistribution and use", "apache", "gnu org", "creativecommons", "creative commons",
    "mit no", "spdx", "general public", "gpl", " gfdl", " mpl", " epl", " cddl", " eupl",
    " under mit ", " the mit ", " of mit ", " to mit ",
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    rank: int  # 0 is the highest
    score: float
    base: bool = False


def rules() -> list[Rule]:
    """Every rule, in order."""
    found = [Rule(label, phrase, phrase, RANKS - 1, 0.5, True) for phrase, label in BASE]
    for label in dict.fromkeys(label for label, _, _ in (*NAMES, *ABBREVIATED)):
        words = re.sub("[^a-z0-9]+", " ", label)
        found.append(Rule(label, "spdx", f"spdx license identifier {words}", 0, 1.0))
    under = r"(?:licen[sc]ed|released|distributed|published|available|provided|offered) under"
    terms = r"(?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
    for label, keyword, name in (*NAMES, *ABBREVIATED, *IN_CONTEXT):
        found.append(Rule(label, keyword, f"{under} {terms}{name}", 1, 0.95))
        found.append(Rule(label, keyword, f"subject to {terms}{name}", 1, 0.9))
        found.append(Rule(label, keyword, f"licen[sc]e(?: is)? (?:the )?{name}", 2, 0.8))
        if (label, keyword, name) not in IN_CONTEXT:
            found.append(Rule(label, keyword, name, 3, 0.6))
    found += [Rule(label, keyword, text, 1, 0.9) for label, keyword, text in SENTENCES]
    return found


RULES = (
    "array<struct<keyword: string, rules: array<struct<order: int, label: string, "
    "pattern: string, rank: int, score: double, base: boolean>>>>"
)


def _catalog(found: Sequence[Rule]) -> Column:
    """Rules as a constant, one literal: an array of (keyword, its rules)."""
    by_keyword: dict[str, list[dict]] = {}
    for order, rule in enumerate(found):
        own = {"order": order, "pattern": f"(?<= )(?:{rule.pattern})(?= )"}
        for name in ("label", "rank", "score", "base"):
            own[name] = getattr(rule, name)
        by_keyword.setdefault(rule.keyword, []).append(own)
    table = [{"keyword": keyword, "rules": own} for keyword, own in by_keyword.items()]
    return F.from_json(F.lit(json.dumps(table)), RULES)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, " ", ""))


DETECTION = (
    "struct<start:int,back:int,rank:int,order:int,label:string,score:double,base:boolean>"
)


#: Put before the first and behind the last character of a match; no word holds them.
FIRST, LAST = "\x01", "\x02"
#: Detections that are appended one by one; beyond, by whole chunks.
CHUNK = 500


def _matches(words: Column, rule: Column) -> Column:
    """Every match of one rule, as (start, -end, rank, order, label, score, base)."""
    none = F.array().cast(f"array<{DETECTION}>")

    def places(marked: Column, is_one) -> Column:
        at = F.transform(marked, lambda word, i: F.when(is_one(word), i))
        return F.filter(at, lambda i: i.isNotNull())

    def found(marked: Column) -> Column:
        starts = places(marked, lambda w: F.startswith(w, F.lit(FIRST)))
        ends = places(marked, lambda w: F.endswith(w, F.lit(LAST)))
        return F.zip_with(
            starts, ends,
            lambda first, last: F.struct(
                (first - 1).alias("start"), (-last).alias("back"),
                rule["rank"].alias("rank"), rule["order"].alias("order"),
                rule["label"].alias("label"), rule["score"].alias("score"),
                rule["base"].alias("base"),
            ).cast(DETECTION),
        )

    # The words begin with a space, so the first one is at place 1.
    marked = F.split(
        F.regexp_replace(words, rule["pattern"], F.lit(f"{FIRST}$0{LAST}")), " ", -1
    )
    once = F.transform(F.array(marked), found)  # computed once, used twice
    return F.when(F.regexp(words, rule["pattern"]), F.get(once, F.lit(0))).otherwise(none)


def _unsuppressed(detections: Column) -> Column:
    """Detections, sorted, without those inside one of the same or a higher rank."""
    none = F.array().cast(f"array<{DETECTION}>")

    def step(done: Column, x: Column) -> Column:
        end = -x["back"]
        furthest = F.array_max(F.slice(done["reach"], F.lit(1), x["rank"] + 1))
        return F.struct(
            F.transform(
                done["reach"],
                lambda reach, rank: F.when(
                    (rank == x["rank"]) & ~x["base"], F.greatest(reach, end)
                ).otherwise(reach),
            ).alias("reach"),
            F.when((furthest >= end) & ~x["base"], done["kept"])
            .otherwise(F.concat(done["kept"], F.array(x))).alias("kept"),
        )

    def chunk(done: Column, at: Column) -> Column:
        own = F.aggregate(
            F.slice(detections, at * CHUNK + 1, F.lit(CHUNK)),
            F.struct(done["reach"].alias("reach"), none.alias("kept")),
            step,
        )
        added = F.transform(  # computed once, used twice
            F.array(own),
            lambda x: F.struct(
                x["reach"].alias("reach"),
                F.concat(done["chunks"], F.array(x["kept"])).alias("chunks"),
            ),
        )
        return F.get(added, F.lit(0))

    start = F.struct(
        F.array(*[F.lit(0)] * RANKS).alias("reach"),
        F.array().cast(f"array<array<{DETECTION}>>").alias("chunks"),
    )
    chunks = F.sequence(F.lit(0), F.floor(F.size(detections) / CHUNK).cast("int"))
    return F.aggregate(chunks, start, chunk, lambda done: F.flatten(done["chunks"]))


def scan(
    docs: DataFrame,
    text_col: str = "text",
    carry: Sequence[str] | None = None,
    signatures: Sequence[Rule] | None = None,
) -> DataFrame:
    """(row, n_words, detections): `row` holds the columns `carry` of `docs`, all by
    default; detections (label, start, end, score, base) count words from 0, `end` is past
    the last one. Base detections are never suppressed and suppress nothing."""
    catalog = _catalog(rules() if signatures is None else signatures)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.btrim(F.regexp_replace(lower_ascii(text), GAP, " "))
    rows = docs.select(
        F.struct(*(carry or docs.columns)).alias("row"),
        F.concat(F.lit(" "), words, F.lit(" ")).alias("words"),
    )
    gate = F.lit(signatures is not None)
    for stem in STEMS:
        gate = gate | F.col("words").contains(stem)
    possible = F.filter(catalog, lambda k: F.contains(F.col("words"), k["keyword"]))
    matched = F.flatten(
        F.transform(
            F.flatten(F.transform(possible, lambda k: k["rules"])),
            lambda rule: _matches(F.col("words"), rule),
        )
    )
    none = F.array().cast(f"array<{DETECTION}>")
    return (
        rows.withColumn("found", F.when(gate, F.array_sort(matched)).otherwise(none))
        .withColumn("kept", _unsuppressed(F.col("found")))
        .select(
            "row",
            F.when(F.col("words") == "  ", F.lit(0)).otherwise(_spaces(F.col("words")) - 1)
            .cast("long").alias("n_words"),
            F.transform(
                "kept",
                lambda d: F.struct(
                    d["label"].alias("label"), d["start"].cast("long").alias("start"),
                    (-d["back"]).cast("long").alias("end"), d["score"].alias("score"),
                    d["base"].alias("base"),
                ),
            ).alias("detections"),
        )
    )
