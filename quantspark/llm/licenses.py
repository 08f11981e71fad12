"""License scans by ordered signature rules, in DataFrame operations only.

A text becomes its words in lower case, one space apart. A text without any keyword ends there. In the
others, only rules whose keyword is among the words run. A rule is a regex with a label, a priority (1 is
best) and a confidence; its matches are word intervals. Detections are ordered by begin, longest first,
best priority first; one that lies inside an earlier kept interval of equal or better priority is
suppressed, so a full notice keeps its label and the mention in it says nothing new.

Everything happens inside a row: no shuffle and no Python. Base phrases are counted by themselves and always
keep their labels. Defined cases: null is empty; a text without words has no labels and score 0; several
labels are distinct, sorted and comma-joined.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words: runs of letters, digits and non-ASCII characters. Java tests this class many times faster than the negated
#: class of all other characters.
WORD = "[0-9A-Za-z\x80-\U0010ffff]+"

# Phrase and label that every scan must report.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Licenses: label, keyword (a word of every match), regex of the name over normalised words.
NAMES = [
    ("mit", "mit", r"mit"),
    ("mit-0", "mit", r"mit (?:no attribution|0)"),
    ("x11", "x11", r"x11"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version| v)? 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version)? (?:v ?)?2(?: 0)?"),
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl(?: version)? (?:v )?1(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?: version)? (?:v )?2(?: 0)?(?: only)?"),
    ("gpl-2.0-or-later", "gpl", r"(?:gnu )?gpl(?: version)? (?:v )?2(?: 0)? or (?:any )?later"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?: version)? (?:v )?3(?: 0)?(?: only)?"),
    ("gpl-3.0-or-later", "gpl", r"(?:gnu )?gpl(?: version)? (?:v )?3(?: 0)? or (?:any )?later"),
    ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2"),
    ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3"),
    ("gpl-2.0", "general", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? (?:version |v )2(?: 0)?"),
    ("gpl-3.0", "general", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? (?:version |v )3(?: 0)?"),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl(?: version)? (?:v )?2(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: version)? (?:v )?2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl(?: version)? (?:v )?3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license (?:version |v )2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license (?:version |v )3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public"),
    ("lgpl", "library", r"(?:gnu )?library general public"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?: version)? (?:v )?3(?: 0)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license (?:version |v )3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation"),
    ("bsd-0-clause", "bsd", r"(?:bsd (?:0|zero) clause|(?:0|zero) clause bsd)"),
    ("bsd-0-clause", "0bsd", r"0bsd"),
    ("bsd-1-clause", "bsd", r"(?:bsd (?:1|one) clause|(?:1|one) clause bsd)"),
    ("bsd-2-clause", "bsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd)"),
    ("bsd-2-clause", "freebsd", r"freebsd"),
    ("bsd-3-clause", "bsd", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("isc", "isc", r"isc"),
    ("mpl-1.0", "mozilla", r"mozilla public license (?:version |v )?1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public license (?:version |v )?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license (?:version |v )?2(?: 0)?"),
    ("mpl-1.1", "mpl", r"mpl (?:version |v )?1 1"),
    ("mpl-2.0", "mpl", r"mpl (?:version |v )?2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: version| v)? 1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version| v)? 2(?: 0)?"),
    ("epl", "epl", r"epl(?: (?:v )?[12](?: 0)?)?"),
    ("edl-1.0", "eclipse", r"eclipse distribution"),
    ("cddl-1.0", "cddl", r"cddl(?: version| v)? 1(?: 0)?"),
    ("cddl-1.1", "cddl", r"cddl(?: version| v)? 1 1"),
    ("cddl", "distribution", r"common development and distribution"),
    ("cpl-1.0", "common", r"common public"),
    ("ipl-1.0", "ibm", r"ibm public"),
    ("eupl-1.1", "eupl", r"eupl(?: version| v)? 1 1"),
    ("eupl-1.2", "eupl", r"eupl(?: version| v)? 1 2"),
    ("eupl", "union", r"european union public"),
    ("artistic-1.0", "artistic", r"artistic(?: license)? 1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic(?: license)? 2(?: 0)?"),
    ("artistic", "artistic", r"(?:clarified )?artistic"),
    ("boost-1.0", "boost", r"boost software(?: license)?(?: version)?(?: 1(?: 0)?)?"),
    ("boost-1.0", "bsl", r"bsl 1 0"),
    ("busl-1.1", "business", r"business source(?: license)?(?: 1 1)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", r"libpng"),
    ("openssl", "openssl", r"openssl"),
    ("python-2.0", "python", r"python(?: software foundation)?"),
    ("php-3.01", "php", r"php(?: 3 0?1)?"),
    ("ruby", "ruby", r"ruby"),
    ("ofl-1.1", "ofl", r"(?:sil )?ofl(?: 1 1)?"),
    ("ofl-1.1", "font", r"(?:sil )?open font"),
    ("upl-1.0", "universal", r"universal permissive"),
    ("afl-3.0", "academic", r"academic free(?: license)?(?: version)?(?: 3(?: 0)?)?"),
    ("osl-3.0", "osl", r"osl 3 0"),
    ("osl", "open", r"open software"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("mulan-2.0", "mulan", r"mulan(?: psl)?(?: permissive software)?(?: v?2)?"),
    ("sspl-1.0", "sspl", r"sspl(?: v?1)?(?: 0)?"),
    ("sspl-1.0", "server", r"server side public"),
    ("elastic-2.0", "elastic", r"elastic(?: license)?(?: 2(?: 0)?)?"),
    ("odbl-1.0", "odbl", r"odbl(?: v?1 0)?"),
    ("odbl-1.0", "database", r"open database"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?"),
    ("cc0-1.0", "zero", r"(?:creative commons )?(?:cc )?zero(?: 1 0)?(?: universal)?"),
]

# Creative Commons terms: words of the code, words of the long form.
CREATIVE = [
    ("by", r"by", r"attribution"), ("by-sa", r"by sa", r"attribution share ?alike"), ("by-nd", r"by nd", r"attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("by-nc", r"by nc", r"attribution non ?commercial"), ("by-nc-sa", r"by nc sa", r"attribution non ?commercial share ?alike"),
    ("by-nc-nd", r"by nc nd", r"attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
]
#: Stands for any word that begins with these letters.
STEM = "licen"
VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

# Passages of license texts and notices: label, keyword, priority, confidence, regex.
PASSAGES = [
    ("mit", "permission", 1, 0.98, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", 1, 0.98, r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", 1, 0.95, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", 1, 0.9, r"may be used to endorse or promote products derived from this software"),
    ("gpl", "redistribute", 1, 0.95, r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", 1, 0.96, r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "redistribute", 1, 0.96, r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("apache-2.0", "compliance", 1, 0.95, r"you may not use this file except in compliance with the license"),
    ("mpl-2.0", "mozilla", 1, 0.98, r"this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "unencumbered", 1, 0.98, r"this is free and unencumbered software released into the public domain"),
    ("zlib", "misrepresented", 1, 0.95, r"the origin of this software must not be misrepresented"),
    ("boost-1.0", "boost", 1, 0.97, r"distributed under the boost software license version 1 0"),
    ("warranty-disclaimer", "warranty", 4, 0.6, r"without warranty of any kind(?: express or implied)?"),
    ("warranty-disclaimer", "merchantability", 4, 0.6, r"implied warranty of merchantability or fitness for a particular purpose"),
    ("public-domain", "domain", 3, 0.7, r"(?:released into|dedicated to|placed in|in) the public domain"),
    ("all-rights-reserved", "reserved", 4, 0.7, r"all rights reserved"),
    ("proprietary", "proprietary", 4, 0.7, r"(?:proprietary and confidential|confidential and proprietary|proprietary software|proprietary license)"),
    ("proprietary", "unauthorized", 3, 0.8, r"unauthorized (?:copying|use|reproduction|distribution)(?: of this [^ ]+)? (?:via any medium )?is (?:strictly )?prohibited"),
    ("copyright", "copyright", 5, 0.4, r"copyright(?: c)? (?:19|20)[0-9]{2}(?: [^ ]+)?"),
    ("spdx", "spdx", 5, 0.5, r"spdx license identifier(?: [^ ]+)?"),
    *[("reference", word, 5, 0.3, rf"see (?:the )?{word}(?: file)?(?: for (?:more )?(?:details|information|terms))?") for word in ("license", "licence", "copying")],
]


def rules() -> list[dict]:
    """All rules. Each named license is looked for in four forms, each with its priority and confidence."""
    names = list(NAMES)
    for code, short, words in CREATIVE:
        for version in VERSIONS:
            digits = version.replace(".", " ")
            names.append((f"cc-{code}-{version}", "cc", rf"cc {short}(?: v)? {digits}"))
            names.append((f"cc-{code}-{version}", "creative", rf"creative commons {words}(?: license| licence)?(?: version)? {digits}"))
        names.append((f"cc-{code}", "cc", rf"cc {short}"))
        names.append((f"cc-{code}", "creative", rf"creative commons {words}"))
    forms = [
        ("identifier", "spdx", 1, 1.0, r"spdx license identifier {}"),
        ("notice", "under", 2, 0.95, r"(?:licensed|released|distributed|available|published|provided|licenced) under (?:the )?(?:terms of )?(?:the |an? )?{}(?: licen[sc]e)?"),
        ("name", STEM, 3, 0.8, r"{} licen[sc]e[ds]?"),
    ]
    out = []
    for label, keyword, name in names:
        for form, also, priority, confidence, frame in forms:
            out.append({"form": form, "label": label, "keyword": keyword, "also": also, "priority": priority, "confidence": confidence, "regex": frame.format(f"(?:{name})")})
        # A name that says its version or is a code of its own needs no further word.
        if label[-1].isdigit() or label.startswith("cc-"):
            out.append({"form": "code", "label": label, "keyword": keyword, "also": keyword, "priority": 4, "confidence": 0.6, "regex": name})
    for label, keyword, priority, confidence, regex in PASSAGES:
        out.append({"form": "passage", "label": label, "keyword": keyword, "also": keyword, "priority": priority, "confidence": confidence, "regex": regex})
    for rule in out:
        rule["regex"] = f"(?<= )(?:{rule['regex']})(?= )"
    return out


RULE_TYPE = "array<struct<keyword:string,also:string,label:string,priority:int,confidence:double,regex:string>>"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def normalised(text: Column) -> Column:
    """`` w1 w2 ... wn ``: lower case (A-Z), one space around every word."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(lower, F.lit(f"({WORD})"), 1), " "), F.lit(" "))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def intervals(norm: Column, regex: Column) -> Column:
    """array<struct<begin, end>>: word intervals of all matches, from left to right.

    The text is split at the matches; words are counted piece by piece. Most rules find nothing, which costs one search.
    """
    begun = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:long,end:long>>").alias("spans"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + _spaces(pair["piece"]) - 1
        end = begin + _spaces(pair["found"]) + 1
        return F.struct(end.cast("long").alias("at"), F.concat(state["spans"], F.array(F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end")))).alias("spans"))

    # zip_with stops nothing early: the last piece, after the last match, has no match and is left out.
    pairs = F.filter(F.zip_with(F.split(norm, regex, -1), F.regexp_extract_all(norm, regex, F.lit(0)), lambda p, f: F.struct(p.alias("piece"), f.alias("found"))), lambda x: x["found"].isNotNull())
    spans = F.aggregate(pairs, begun, add, lambda state: state["spans"])
    return F.when(F.rlike(norm, regex), spans).otherwise(F.array().cast("array<struct<begin:long,end:long>>"))


def keywords() -> list[str]:
    """All words that some rule needs."""
    return sorted({r[k] for r in rules() for k in ("keyword", "also")} - {STEM})


def detections(norm: Column, words: Column) -> Column:
    """Matches of all rules whose keyword is among ``words``, in scan order."""
    listed = rules()
    table = F.from_json(F.lit(json.dumps([{k: r[k] for k in ("keyword", "also", "label", "priority", "confidence", "regex")} for r in listed])), RULE_TYPE)
    active = F.filter(table, lambda r: F.array_contains(words, r["keyword"]) & F.array_contains(words, r["also"]))
    one = lambda r: F.transform(intervals(norm, r["regex"]), lambda x: F.struct(x["begin"].alias("begin"), (-x["end"]).alias("back"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")))
    return F.array_sort(F.flatten(F.transform(active, one)))


def unsuppressed(found: Column) -> Column:
    """Detections that lie in no kept interval of equal or better priority before them."""
    kind = "array<struct<begin:long,back:long,priority:int,label:string,confidence:double>>"
    begun = F.struct(F.array_repeat(F.lit(0).cast("long"), 5).alias("reach"), F.array().cast(kind).alias("kept"))

    def add(state: Column, d: Column) -> Column:
        inside = F.exists(F.slice(state["reach"], 1, d["priority"]), lambda end: end >= -d["back"])
        reach = F.transform(state["reach"], lambda end, i: F.when(~inside & (i == d["priority"] - 1), F.greatest(end, -d["back"])).otherwise(end))
        return F.struct(reach.alias("reach"), F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], F.array(d))).alias("kept"))

    return F.aggregate(found, begun, add)["kept"]


def gate(text: Column) -> Column:
    """Can any rule match? Looks for the stem and for the keywords of the rules that do not need it."""
    free = sorted({r["also"] for r in rules()} - {STEM})
    letter = WORD.removesuffix("+")  # borders are those of words: an underscore is one, unlike for \b
    return F.coalesce(text.rlike(rf"(?i){STEM}|(?<!{letter})(?:{'|'.join(free)})(?!{letter})"), F.lit(False))


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once: a generator is a step that projections do not merge into."""
    value = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(value)))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``license``: n_words, base (per phrase: label, places) and found (kept detections)."""
    from quantspark.llm.rows import fresh

    norm_name, words_name, name = fresh(docs, "normalised_text"), fresh(docs, "found_keywords"), fresh(docs, "license")
    norm = F.col(norm_name)
    read = _computed(docs, **{norm_name: F.when(gate(F.col(text)), normalised(F.col(text)))})
    # Rules ask for their keywords one by one: only those that the text has are kept, found by one hash look-up a word.
    words = F.array_intersect(F.split(F.trim(norm), " "), F.array(*[F.lit(k) for k in keywords()]))
    read = _computed(read, **{words_name: F.when(norm.contains(f" {STEM}"), F.array_append(words, F.lit(STEM))).otherwise(words)})
    none = F.array().cast("array<struct<begin:long,end:long>>")
    base = F.array(*[
        F.struct(F.lit(label).alias("label"), F.when(norm.isNotNull(), intervals(norm, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(none).alias("places")) for phrase, label in BASE
    ])
    found = F.when(norm.isNotNull(), unsuppressed(detections(norm, F.col(words_name))))
    license = F.struct(n_words(F.col(text)).alias("n_words"), base.alias("base"), found.alias("found"))
    return _computed(read, **{name: license}).drop(norm_name, words_name)


def summary(scanned: DataFrame, license: str = "license") -> DataFrame:
    """``scanned`` with n_words, n_base, first_word, last_word, base_labels, labels, score in place of the struct."""
    none = F.array().cast("array<string>")
    value = F.col(license)
    begins = F.flatten(F.transform(value["base"], lambda b: F.transform(b["places"], lambda p: p["begin"])))
    base_labels = F.transform(F.filter(value["base"], lambda b: F.size(b["places"]) > 0), lambda b: b["label"])
    own = F.coalesce(F.transform(value["found"], lambda d: d["label"]), none)
    best = F.coalesce(F.array_max(F.transform(value["found"], lambda d: d["confidence"])), F.lit(0.0))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.select(
        *[F.col(f"`{c}`") for c in scanned.columns if c != license],
        value["n_words"].alias("n_words"), F.size(begins).cast("long").alias("n_base"), F.array_min(begins).alias("first_word"), F.array_max(begins).alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, own)).alias("labels"), F.greatest(best, F.when(F.size(begins) > 0, 0.8).otherwise(0.0)).alias("score"),
    )
