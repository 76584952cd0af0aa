"""License scan by ordered signature rules, in DataFrame functions only.

A text is lower-cased (A-Z) and brought to its words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
with one space around each. A rule is a regular expression over that form with a label, a
priority and a keyword; it runs only on texts that hold its keyword as a word. Rules are
made of the families below, each in several forms (identifier, grant, address, name), and
of mentions written one by one.
Every match of a rule holds its keyword, so the keyword leaves out no match (tested).

Detections that overlap are resolved from left to right: one that lies inside another is
suppressed, of two that cross the lower priority goes; equal spans keep the higher
priority, then the earlier rule. ``score`` is the share of words in kept detections.

Fixed phrases are counted besides, at every place, whether or not a rule fires there.
Null texts count as empty and have no detections; rows that repeat are scanned each; other
columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.scratch import plain

#: Phrases counted at every place, with their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_V = "(?: version| v)?"
#: (label, keyword, name, identifier, address): patterns over normalized words; an empty
#: pattern means that the family has no such form.
FAMILIES = [
    ("agpl", "affero", f"gnu affero general public license(?:{_V} \\d+(?: 0)?)?", "agpl(?: \\d 0)?(?: only| or later)?", "gnu org licenses agpl(?: \\d 0)?"),
    ("gpl", "gnu", f"gnu (?:general public license|gpl)(?:{_V} [123](?: 0)?)?(?: or (?:any )?later)?", "gpl(?: [123] 0)?(?: only| or later)?", "gnu org (?:licenses|copyleft) (?:old licenses )?gpl(?: \\d 0)?"),
    ("gpl", "gpl", "gpl(?: version ?| v ?| )[123](?: 0)?(?: or (?:any )?later)?", "", ""),
    *[("gpl", f"gpl{n}", f"gpl{n}(?: 0)?(?: or (?:any )?later)?", "", "") for n in (1, 2, 3)],
    ("lgpl", "lesser", f"gnu lesser general public license(?:{_V} [23](?: [01])?)?", "lgpl(?: [23] [01])?(?: only| or later)?", "gnu org (?:licenses|copyleft) (?:old licenses )?lgpl(?: \\d \\d)?"),
    ("lgpl", "library", f"gnu library general public license(?:{_V} 2(?: [01])?)?", "", ""),
    ("gfdl", "documentation", f"gnu free documentation license(?:{_V} 1 [123])?", "gfdl(?: 1 [123])?(?: only| or later)?", "gnu org licenses fdl(?: 1 \\d)?"),
    ("apache", "apache", f"apache (?:software )?license(?:{_V} [12](?: [01])?)?", "apache [12] [01]", "apache org licenses license [12] [01]"),
    ("mit", "mit", "(?:the )?mit (?:x11 )?license", "mit(?: 0)?", "opensource org licenses mit(?: license)?"),
    ("mit", "expat", "expat license", "", ""),
    ("x11", "x11", "x11 license", "x11", "xfree86 org [a-z0-9 ]{0,20}legal licenses"),
    ("bsd-2-clause", "bsd", "(?:(?:simplified|freebsd) bsd license|bsd 2 clause(?: license)?|2 clause bsd(?: license)?)", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:(?:new|modified|revised) bsd license|bsd 3 clause(?: license)?|3 clause bsd(?: license)?)", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original bsd license|bsd 4 clause(?: license)?|4 clause bsd(?: license)?)", "bsd 4 clause", ""),
    ("bsd", "bsd", "(?:bsd style license|bsd license)", "bsd", "opensource org licenses bsd license"),
    ("0bsd", "0bsd", "0bsd(?: license)?", "0bsd", "opensource org licenses 0bsd"),
    ("0bsd", "zero", "zero clause bsd(?: license)?", "", ""),
    ("isc", "isc", "isc license", "isc", "opensource org licenses isc(?: license)?"),
    ("zlib", "zlib", "zlib(?: libpng)? license", "zlib", "zlib net zlib license"),
    ("boost", "boost", f"boost software license(?:{_V} 1 0)?", "bsl 1 0", "boost org license 1 0"),
    ("mpl", "mozilla", f"mozilla public license(?:{_V} [12](?: [01])?)?", "mpl [12] [01]", "mozilla org (?:en us )?mpl(?: [12] [01])?"),
    ("npl", "netscape", f"netscape public license(?:{_V} 1 [01])?", "npl 1 [01]", "mozilla org npl"),
    ("epl", "eclipse", f"eclipse public license(?:{_V} [12](?: 0)?)?", "epl [12] 0", "eclipse org legal epl(?: v10| 2 0)?"),
    ("edl", "eclipse", f"eclipse distribution license(?:{_V} 1 0)?", "", "eclipse org org documents edl v10"),
    ("cpl", "common", f"common public license(?:{_V} 1 0)?", "cpl 1 0", "opensource org licenses cpl1 0"),
    ("cddl", "cddl", f"cddl(?:{_V} 1 [01])?", "cddl 1 [01]", "opensource org licenses cddl1"),
    ("cddl", "distribution", f"common development and distribution license(?:{_V} 1 [01])?", "", ""),
    ("eupl", "european", f"european union public licen[cs]e(?:{_V} 1 [012])?", "eupl 1 [012]", "joinup ec europa eu [a-z0-9 ]{0,20}eupl"),
    ("cecill", "cecill", "cecill(?: [bc])?(?: license)?", "cecill(?: [bc])?(?: [12] [01])?", "cecill info licences"),
    ("artistic", "artistic", "artistic license(?: [12] 0)?", "artistic [12] 0", "perlfoundation org artistic license 2 0"),
    ("perl", "perl", "same terms as perl(?: itself)?", "", "perl com language misc artistic"),
    ("python", "python", "python (?:software foundation )?license(?: version 2)?", "psf 2 0", "python org (?:psf )?license"),
    ("php", "php", "php license(?: version)?(?: 3 0[01]?)?", "php 3 0[01]?", "php net license"),
    ("ruby", "ruby", "ruby(?: s)? license", "ruby", "ruby lang org [a-z ]{0,8}license"),
    ("openssl", "openssl", "openssl license", "openssl", "openssl org source license"),
    ("postgresql", "postgresql", "postgresql license", "postgresql", "postgresql org about licence"),
    ("unicode", "unicode", "unicode license(?: agreement)?(?: v3)?", "unicode(?: dfs 201[56]| 3 0)", "unicode org copyright"),
    ("ofl", "font", "sil open font license(?: version)?(?: 1 [01])?", "ofl 1 [01]", "scripts sil org ofl"),
    ("w3c", "w3c", "w3c (?:software (?:notice and )?)?license", "w3c", "w3 org consortium legal"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source license", "ncsa", "opensource org licenses (?:uoi )?ncsa"),
    ("wtfpl", "wtfpl", "wtfpl(?: license| version 2)?", "wtfpl", "wtfpl net"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense", "unlicense org"),
    ("beerware", "beerware", "beerware license", "beerware", ""),
    ("public-domain", "domain", "(?:dedicated to|released into|placed in|in) the public domain", "", "creativecommons org licenses publicdomain"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-nc-nd", "nd", "(?:cc |creative commons )?by nc nd(?: [1234] [05])?", "cc by nc nd [1234] [05]", "creativecommons org licenses by nc nd(?: \\d \\d)?"),
    ("cc-by-nc-nd", "noderivatives", "(?:cc |creative commons )?attribution noncommercial noderivatives(?: [1234] [05])?", "", ""),
    ("cc-by-nc-sa", "sa", "(?:cc |creative commons )?by nc sa(?: [1234] [05])?", "cc by nc sa [1234] [05]", "creativecommons org licenses by nc sa(?: \\d \\d)?"),
    ("cc-by-nc-sa", "sharealike", "(?:cc |creative commons )?attribution noncommercial sharealike(?: [1234] [05])?", "", ""),
    ("cc-by-nc", "nc", "(?:cc |creative commons )?by nc(?: [1234] [05])?", "cc by nc [1234] [05]", "creativecommons org licenses by nc(?: \\d \\d)?"),
    ("cc-by-nc", "noncommercial", "(?:cc |creative commons )?attribution noncommercial(?: [1234] [05])?", "", ""),
    ("cc-by-nd", "nd", "(?:cc |creative commons )?by nd(?: [1234] [05])?", "cc by nd [1234] [05]", "creativecommons org licenses by nd(?: \\d \\d)?"),
    ("cc-by-nd", "noderivatives", "(?:cc |creative commons )?attribution noderivatives(?: [1234] [05])?", "", ""),
    ("cc-by-sa", "sa", "(?:cc |creative commons )?by sa(?: [1234] [05])?", "cc by sa [1234] [05]", "creativecommons org licenses by sa(?: \\d \\d)?"),
    ("cc-by-sa", "sharealike", "(?:cc |creative commons )?attribution sharealike(?: [1234] [05])?", "", ""),
    ("cc-by", "cc", "cc by(?: [1234] [05])?", "cc by [1234] [05]", ""),
    ("cc-by", "commons", "creative commons attribution(?: license)?(?: [1234] [05])?", "", "creativecommons org licenses by \\d \\d"),
    ("odbl", "database", "open (?:data commons open )?database license(?: v1 0)?", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by", "data", "open data commons attribution license", "odc by 1 0", "opendatacommons org licenses by"),
    ("cdla", "community", "community data license agreement(?: permissive| sharing)?(?: [12] 0)?", "cdla (?:permissive|sharing) [12] 0", "cdla (?:dev|io)"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl", "opensource org licenses ms rl"),
    ("apsl", "apple", f"apple public source license(?:{_V} [12] \\d)?", "apsl [12] \\d", "opensource apple com apsl"),
    ("osl", "osl", "osl(?: 3 0)?", "osl [123] [01]", "opensource org licenses osl 3 0"),
    ("afl", "academic", "academic free license(?: version)?(?: [123] [01])?", "afl [123] [01]", "opensource org licenses afl 3 0"),
    ("upl", "permissive", "universal permissive license(?: 1 0)?", "upl 1 0", "oss oracle com licenses upl"),
    ("mulan", "mulan", "mulan (?:psl|permissive software license) ?(?:v2|version 2)?", "mulanpsl [12] 0", "license coscl org cn mulanpsl2"),
    ("bsl", "business", "business source license(?: 1 [01])?", "busl 1 1", "mariadb com bsl11"),
    ("sspl", "sspl", "sspl(?: v1)?", "sspl 1 0", "mongodb com licensing server side public license"),
    ("elastic", "elastic", "elastic license(?: 2 0)?", "elastic 2 0", "elastic co licensing elastic license"),
    ("openrail", "openrail", "(?:creativeml |bigscience )?openrail(?: m| m1)?(?: license)?", "openrail(?: m)?", ""),
    ("llama", "llama", "llama \\d(?: \\d)? community license(?: agreement)?", "llama\\d", "ai meta com llama license"),
    ("mit", "obtaining", "permission is hereby granted free of charge to any person obtaining a copy", "", ""),
    ("boost", "obtaining", "permission is hereby granted free of charge to any person or organization obtaining a copy", "", ""),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", "", ""),
    ("isc", "fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", "", ""),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", "", ""),
    ("all-rights-reserved", "reserved", "all rights reserved", "", ""),
    ("proprietary", "proprietary", "proprietary and confidential", "", ""),
]

#: Plain mentions, each written by itself: (label, keyword, pattern).
MENTIONS = [
    ("agpl", "affero", "(?:gnu )?affero gpl(?: v?3(?: 0)?)?"),
    ("agpl", "agpl", "(?:gnu )?agpl(?: v?3(?: 0)?)?(?: licen[cs]ed?)?"),
    ("agpl", "agplv3", "(?:gnu )?agplv3(?: 0)?(?: only| or later)?"),
    ("agpl", "agpl3", "(?:gnu )?agpl3(?: 0)?"),
    ("gpl", "gpl", "(?:gnu )?gpl(?: licen[cs]ed?)?"),
    ("gpl", "gplv1", "(?:gnu )?gplv1(?: 0)?(?: only| or later)?"),
    ("gpl", "gplv2", "(?:gnu )?gplv2(?: 0)?(?: only| or later)?"),
    ("gpl", "gplv3", "(?:gnu )?gplv3(?: 0)?(?: only| or later)?"),
    ("gpl", "gpled", "gpled"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?: v?[23](?: [01])?)?(?: licen[cs]ed?)?"),
    ("lgpl", "lgplv2", "(?:gnu )?lgplv2(?: [01])?(?: only| or later)?"),
    ("lgpl", "lgplv3", "(?:gnu )?lgplv3(?: 0)?(?: only| or later)?"),
    ("lgpl", "lgpl2", "(?:gnu )?lgpl2(?: [01])?"),
    ("lgpl", "lgpl3", "(?:gnu )?lgpl3(?: 0)?"),
    ("lgpl", "lesser", "(?:gnu )?lesser gpl(?: v?[23](?: [01])?)?"),
    ("gfdl", "gfdl", "(?:gnu )?gfdl(?: v?1 [123])?"),
    ("gfdl", "fdl", "gnu fdl(?: v?1 [123])?"),
    ("apache", "apache", "apache (?:v ?)?2 0(?: licen[cs]ed?)?"),
    ("apache", "apache", "apache (?:v2|2) licen[cs]ed?"),
    ("apache", "apache", "apache licen[cs]ed"),
    ("apache", "apache2", "apache2 licen[cs]ed?"),
    ("apache", "asl", "asl (?:v2|2 0)"),
    ("mit", "mit", "mit licen[cs]ed"),
    ("mit", "mit", "mit style licen[cs]ed?"),
    ("bsd", "bsd", "bsd licen[cs]ed"),
    ("bsd", "bsd", "bsd style licen[cs]ed"),
    ("bsd-2-clause", "bsd2", "bsd2(?: clause)?(?: licen[cs]ed?)?"),
    ("bsd-3-clause", "bsd3", "bsd3(?: clause)?(?: licen[cs]ed?)?"),
    ("isc", "isc", "isc licen[cs]ed"),
    ("zlib", "zlib", "zlib licen[cs]ed"),
    ("boost", "boost", "boost licen[cs]ed?(?: 1 0)?"),
    ("mpl", "mpl", "mpl v?[12](?: [01])?(?: licen[cs]ed?)?"),
    ("mpl", "mplv2", "mplv2(?: 0)?"),
    ("mpl", "mpl2", "mpl2(?: 0)?"),
    ("epl", "epl", "epl v?[12](?: 0)?(?: licen[cs]ed?)?"),
    ("eupl", "eupl", "eupl(?: v?1 [012])?"),
    ("cddl", "cddl", "cddl licen[cs]ed"),
    ("artistic", "artistic", "artistic licen[cs]ed"),
    ("artistic", "artistic", "artistic 2 0"),
    ("ofl", "ofl", "(?:sil )?ofl(?: v?1 [01])?"),
    ("odbl", "odbl", "odbl(?: v?1 0)?"),
    ("psf", "psf", "psf licen[cs]ed?"),
    ("php", "php", "php licen[cs]ed"),
    ("sspl", "server", "server side public license(?: v?1| version 1)?"),
    ("sspl", "sspl", "sspl licen[cs]ed"),
    ("bsl", "busl", "busl(?: 1 [01])?"),
    ("elastic", "elastic", "elastic licen[cs]ed"),
    ("cc0", "zero", "creative commons zero(?: v?1 0)?(?: universal)?"),
    ("cc0", "zero", "cc zero"),
    ("cc0", "cc0", "(?:creative commons )?cc0 licen[cs]ed?"),
    ("cc-by", "commons", "creative commons attribution [1234] [05] (?:international|unported|generic)"),
    ("cc-by", "cc", "cc attribution(?: [1234] [05])?"),
    ("public-domain", "domain", "public domain (?:software|work|code|text)"),
    ("public-domain", "pd", "pd licen[cs]ed"),
    ("proprietary", "proprietary", "proprietary licen[cs]ed?"),
    ("openrail", "rail", "rail (?:m )?licen[cs]ed?"),
]
MENTIONED = 40  # their priority

#: Forms of a family: name, priority, words around the family's pattern, its column, keyword.
_UNDER = (
    "(?:licen[cs]ed|released|distributed|available|provided|published|redistributed|covered|used) "
    "under (?:the )?(?:terms (?:and conditions )?of (?:the )?|conditions of (?:the )?)?"
)
FORMS = [
    ("identifier", 90, "spdx license identifier {}", 3, "spdx"),
    ("field", 80, "license {}", 3, "license"),
    ("grant", 70, _UNDER + "{}", 2, None),
    ("address", 60, "{}", 4, None),
    ("name", 50, "{}", 2, None),
]

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules() -> list[dict]:
    """All rules in order: label, priority, keyword, pattern (a space before, one after)."""
    out = []
    for _, priority, around, at, keyword in FORMS:
        for family in FAMILIES:
            if family[at]:
                gate = keyword or (family[1] if at == 2 else family[4].split(" ")[0])
                out.append({"label": family[0], "priority": priority, "keyword": gate,
                            "pattern": f" (?:{around.format(f'(?:{family[at]})')})(?= )"})
    for label, keyword, pattern in MENTIONS:
        out.append({"label": label, "priority": MENTIONED, "keyword": keyword, "pattern": f" (?:{pattern})(?= )"})
    return out


def _spaces(c) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _rule_array() -> Column:
    return F.array(*[
        F.struct(F.lit(r["label"]).alias("label"), F.lit(r["priority"]).alias("priority"),
                 F.lit(r["keyword"]).alias("keyword"), F.lit(r["pattern"]).alias("pattern"),
                 F.lit(i).alias("rank"))
        for i, r in enumerate(rules())
    ])


_DETECTION = "array<struct<begin:int,past:int,below:int,rank:int,label:string>>"


def _places(norm: Column, rule: Column) -> Column:
    """Word spans at which a rule matches: pieces between the matches, added up."""
    pieces = F.split(norm, rule["pattern"], -1)
    matches = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    # Sorting by (begin, -past, -priority, rank) puts the span that wins first.
    return F.aggregate(
        F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("gap"), matches.alias("hit")),
        F.struct(F.lit(0).alias("at"), F.array().cast(_DETECTION).alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + _spaces(x["gap"]) + _spaces(x["hit"])).alias("at"),
            F.array_append(
                acc["found"],
                F.struct(
                    (acc["at"] + _spaces(x["gap"])).alias("begin"),
                    (-(acc["at"] + _spaces(x["gap"]) + _spaces(x["hit"]))).alias("past"),
                    (-rule["priority"]).alias("below"),
                    rule["rank"].alias("rank"),
                    rule["label"].alias("label"),
                ),
            ).alias("found"),
        ),
        lambda acc: acc["found"],
    )


def _resolved(found: Column) -> Column:
    """Labels and number of words of the detections that are not suppressed."""

    def close(acc):
        return F.struct(
            F.when(acc["label"].isNull(), acc["labels"])
            .otherwise(F.array_union(acc["labels"], F.array(acc["label"])))
            .alias("labels"),
            (acc["words"] + acc["end"] - acc["begin"]).alias("words"),
        )

    def step(acc, x):
        end = -x["past"]
        opened = close(acc)
        fresh = F.struct(
            x["begin"].alias("begin"), end.alias("end"), x["below"].alias("below"), x["label"].alias("label"),
            opened["labels"].alias("labels"), opened["words"].alias("words"),
        )
        instead = F.struct(
            x["begin"].alias("begin"), end.alias("end"), x["below"].alias("below"), x["label"].alias("label"),
            acc["labels"].alias("labels"), acc["words"].alias("words"),
        )
        return (
            F.when(x["begin"] >= acc["end"], fresh)
            .when((end <= acc["end"]) | (x["below"] >= acc["below"]), acc)
            .otherwise(instead)
        )

    start = F.struct(
        F.lit(0).alias("begin"), F.lit(0).alias("end"), F.lit(1).alias("below"),
        F.lit(None).cast("string").alias("label"), F.array().cast("array<string>").alias("labels"),
        F.lit(0).alias("words"),
    )
    return F.aggregate(F.array_sort(found), start, step, close)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; a row each.

    ``n_base`` counts all places of the fixed phrases, ``first_word`` and ``last_word`` are
    their smallest and largest first words. Labels are distinct, sorted, comma-joined.
    """
    keywords = sorted({r["keyword"] for r in rules()})
    lowered = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    texts = plain(docs, doc_id=id_col, text=text_col).select(
        "doc_id", F.trim(F.regexp_replace(lowered, SEPARATOR, " ")).alias("joined")
    )
    words = F.split("joined", " ")
    texts = texts.select(
        "doc_id",
        F.concat(F.lit(" "), "joined", F.lit(" ")).alias("norm"),
        F.when(F.col("joined") == "", 0).otherwise(_spaces(F.col("joined")) + 1).cast("long").alias("n_words"),
        F.array_intersect(words, F.array(*map(F.lit, keywords))).alias("keywords"),
    )
    norm = F.col("norm")
    gated = F.filter(_rule_array(), lambda r: F.array_contains("keywords", r["keyword"]))
    found = F.when(
        F.size("keywords") > 0, F.flatten(F.transform(gated, lambda r: _places(norm, r)))
    ).otherwise(F.array().cast(_DETECTION))
    texts = texts.withColumn("found", found)

    places = []
    for phrase in PHRASES:
        closed = F.lit(f" {phrase} ")
        there = F.contains(norm, closed)
        first = _spaces(F.substring(norm, F.lit(1), F.instr(norm, f" {phrase} ") - 1))
        back = F.instr(F.reverse(norm), f" {phrase} "[::-1])
        until = F.length(norm) - (back - 1) - len(phrase) - 2
        places.append(
            F.when(
                there,
                F.struct(
                    F.regexp_count(norm, F.lit(f" {phrase}(?= )")).alias("n"),
                    first.alias("first"),
                    _spaces(F.substring(norm, F.lit(1), until)).alias("last"),
                ),
            )
        )
    texts = texts.select(
        "doc_id", "n_words", _resolved(F.col("found")).alias("kept"),
        *[p.alias(f"p{i}") for i, p in enumerate(places)],
    )
    cols = [F.col(f"p{i}") for i in range(len(places))]
    base = F.filter(
        F.array(*[F.when(p.isNotNull(), F.lit(label)) for p, label in zip(cols, PHRASES.values())]),
        lambda x: x.isNotNull(),
    )
    return texts.select(
        "doc_id",
        "n_words",
        sum((F.coalesce(p["n"], F.lit(0)) for p in cols), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[p["first"] for p in cols]).cast("long").alias("first_word"),
        F.greatest(*[p["last"] for p in cols]).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("kept.labels"))), ",").alias("labels"),
        F.when(F.col("n_words") > 0, F.col("kept.words") / F.col("n_words")).otherwise(0.0).alias("score"),
    )
