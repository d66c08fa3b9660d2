"""License scan: ordered signature rules over normalised words, with DataFrame functions only.

A text is lower-cased and reduced to its words, the runs of digits, a-z and non-ASCII
characters, with one blank around each.  (Lower-casing other letters than A-Z changes no
word border and makes no letter of a rule but k, from the Kelvin sign.)  A document's words
are intersected with the gate words; each gate word found brings in the rules that it guards,
those that name a licence only beside the word itself, so a rule's regular expression runs
over documents that can match it and no others.  A detection is an
interval of words.  Rules carry a priority: names of exact licences before families, families
before vague mentions.  A detection that lies within one of an earlier rule, or in a longer
one of its own priority, is suppressed.

The four base phrases are matched word by word, independently of the rules; their labels
always stay.

Defined results: null or wordless text has n_words 0, n_base 0, null positions, empty label
strings and score 0; each row is scanned by itself, so repeated rows repeat.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: phrase: label (fixed values)
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Without one of these, no rule that names a licence is tried.
WORD = ("license", "licence")
_V = r"(?: (?:v|version))?"
_LIC = "licen[cs]e"
#: Hand-written names: gate word, label, expression. Every match of an expression holds its gate word; ways without it are rows of their own.
#: Blanks separate words; \w doesn't occur, since words hold any non-ASCII character.
NAMES = [
    ("gnu", "agpl-3.0", rf"gnu affero general public {_LIC}{_V} 3(?: 0)?"),
    ("gnu", "agpl", rf"gnu affero general public {_LIC}"),
    ("gnu", "lgpl-2.1", rf"gnu lesser general public {_LIC}{_V} 2 1"),
    ("gnu", "lgpl-3.0", rf"gnu lesser general public {_LIC}{_V} 3(?: 0)?"),
    ("gnu", "lgpl-2.0", rf"gnu library general public {_LIC}{_V} 2(?: 0)?"),
    ("gnu", "lgpl", rf"gnu (?:lesser|library) general public {_LIC}"),
    ("gnu", "gpl-1.0", rf"gnu general public {_LIC}{_V} 1(?: 0)?"),
    ("gnu", "gpl-2.0", rf"gnu general public {_LIC}{_V} 2(?: 0)?"),
    ("gnu", "gpl-3.0", rf"gnu general public {_LIC}{_V} 3(?: 0)?"),
    ("gnu", "gpl-family", rf"gnu general public {_LIC}"),
    ("gnu", "gfdl-1.2", rf"gnu free documentation {_LIC}{_V} 1 2"),
    ("gnu", "gfdl-1.3", rf"gnu free documentation {_LIC}{_V} 1 3"),
    ("gnu", "gfdl", rf"gnu free documentation {_LIC}"),
    ("gnu", "gpl-family", r"gnu (?:l|a)?gpl"),
    ("gpl", "gpl-2.0", r"gpl (?:v ?|version ?)?2(?: 0)?"),
    ("gpl", "gpl-3.0", r"gpl (?:v ?|version ?)?3(?: 0)?"),
    ("gpl2", "gpl-2.0", r"gpl2(?: 0)?"),
    ("gpl3", "gpl-3.0", r"gpl3(?: 0)?"),
    ("gplv2", "gpl-2.0", r"gplv2"),
    ("gplv3", "gpl-3.0", r"gplv3"),
    ("lgpl", "lgpl-2.1", r"lgpl(?: v| version)? 2 1"),
    ("lgpl", "lgpl-3.0", r"lgpl(?: v| version)? 3(?: 0)?"),
    ("lgplv3", "lgpl-3.0", r"lgplv3"),
    ("agpl", "agpl-3.0", r"agpl(?: v| version)? 3(?: 0)?"),
    ("agplv3", "agpl-3.0", r"agplv3"),
    ("gfdl", "gfdl", r"gfdl"),
    ("apache", "apache-1.0", rf"apache (?:software )?{_LIC}{_V} 1 0"),
    ("apache", "apache-1.1", rf"apache (?:software )?{_LIC}{_V} 1 1"),
    ("apache", "apache-2.0", rf"apache (?:software )?(?:{_LIC}{_V} )?2(?: 0)?"),
    ("apache", "apache-family", rf"apache (?:software )?{_LIC}"),
    ("mit", "mit-0", r"mit no attribution"),
    ("mit", "mit", rf"(?:the )?mit (?:x11 )?{_LIC}"),
    ("expat", "mit", rf"expat {_LIC}"),
    ("x11", "x11", rf"x11 {_LIC}"),
    ("bsd", "bsd-2-clause", rf"(?:bsd 2 clause|2 clause bsd|simplified bsd|two clause bsd)(?: {_LIC})?"),
    ("bsd", "bsd-3-clause", rf"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd|three clause bsd)(?: {_LIC})?"),
    ("bsd", "bsd-4-clause", rf"(?:bsd 4 clause|4 clause bsd|original bsd|four clause bsd)(?: {_LIC})?"),
    ("bsd", "0bsd", rf"(?:zero clause bsd|bsd zero clause|bsd 0 clause)(?: {_LIC})?"),
    ("0bsd", "0bsd", r"0bsd"),
    ("bsd", "bsd-family", rf"bsd {_LIC}"),
    ("cc0", "cc0-1.0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc", "cc-by-nc-nd", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc", "cc-by-nc-sa", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc", "cc-by-nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc", "cc-by-nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc", "cc-by-sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc", "cc-by", r"cc by(?: [1-4] [05])?"),
    ("creative", "cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)"),
    ("creative", "cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike"),
    ("creative", "cc-by-nc", r"creative commons attribution non ?commercial"),
    ("creative", "cc-by-nd", r"creative commons attribution no ?deriv(?:ative|atives|s)"),
    ("creative", "cc-by-sa", r"creative commons attribution share ?alike"),
    ("creative", "cc-by", r"creative commons attribution"),
    ("creative", "cc0-1.0", r"creative commons (?:zero|cc0)"),
    ("creative", "cc-family", rf"creative commons(?: {_LIC})?"),
    ("mozilla", "mpl-1.1", rf"mozilla public {_LIC}{_V} 1 1"),
    ("mozilla", "mpl-2.0", rf"mozilla public {_LIC}{_V} 2(?: 0)?"),
    ("mozilla", "mpl-family", rf"mozilla public {_LIC}"),
    ("mpl", "mpl-2.0", r"mpl(?: v| version)? 2(?: 0)?"),
    ("eclipse", "epl-1.0", rf"eclipse public {_LIC}{_V} 1(?: 0)?"),
    ("eclipse", "epl-2.0", rf"eclipse public {_LIC}{_V} 2(?: 0)?"),
    ("eclipse", "epl-family", rf"eclipse public {_LIC}"),
    ("eclipse", "edl-1.0", rf"eclipse distribution {_LIC}(?:{_V} 1 0)?"),
    ("epl", "epl-2.0", r"epl(?: v| version)? 2(?: 0)?"),
    ("cddl", "cddl-1.0", r"cddl(?: v| version)? 1(?: 0)?"),
    ("common", "cddl-1.0", rf"common development and distribution {_LIC}"),
    ("common", "cpl-1.0", rf"common public {_LIC}(?:{_V} 1 0)?"),
    ("common", "cpal-1.0", rf"common public attribution {_LIC}"),
    ("artistic", "artistic-2.0", rf"artistic {_LIC}{_V} 2(?: 0)?"),
    ("artistic", "artistic-1.0", rf"artistic {_LIC}{_V} 1(?: 0)?"),
    ("artistic", "artistic-family", rf"artistic {_LIC}"),
    ("boost", "bsl-1.0", rf"boost software {_LIC}(?:{_V} 1 0)?"),
    ("isc", "isc", rf"isc {_LIC}"),
    ("zlib", "zlib", rf"zlib(?: libpng)? {_LIC}"),
    ("libpng", "libpng", rf"libpng {_LIC}(?:{_V} 2)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python", "psf-2.0", rf"python software foundation {_LIC}(?:{_V} 2)?"),
    ("python", "python-2.0", rf"python {_LIC}(?:{_V} 2 0)?"),
    ("psf", "psf-2.0", rf"psf {_LIC}(?:{_V} 2)?"),
    ("php", "php-3.01", rf"php {_LIC}(?:{_V} 3 01)?"),
    ("ruby", "ruby", rf"ruby {_LIC}"),
    ("perl", "perl-family", rf"same terms as perl(?: itself)?"),
    ("postgresql", "postgresql", rf"postgresql {_LIC}"),
    ("openssl", "openssl", rf"openssl {_LIC}"),
    ("sil", "ofl-1.1", rf"sil open font {_LIC}(?:{_V} 1 1)?"),
    ("font", "ofl-family", rf"open font {_LIC}"),
    ("ofl", "ofl-1.1", r"ofl(?: v| version)? 1 1"),
    ("european", "eupl-1.2", rf"european union public {_LIC}{_V} 1 2"),
    ("european", "eupl-family", rf"european union public {_LIC}"),
    ("eupl", "eupl-1.2", r"eupl(?: v| version)? 1 2"),
    ("microsoft", "ms-pl", rf"microsoft public {_LIC}"),
    ("microsoft", "ms-rl", rf"microsoft reciprocal {_LIC}"),
    ("universal", "upl-1.0", rf"universal permissive {_LIC}(?:{_V} 1 0)?"),
    ("academic", "afl-3.0", rf"academic free {_LIC}(?:{_V} 3 0)?"),
    ("educational", "ecl-2.0", rf"educational community {_LIC}(?:{_V} 2 0)?"),
    ("open", "osl-3.0", rf"open software {_LIC}(?:{_V} 3 0)?"),
    ("open", "odbl-1.0", rf"open (?:data commons open )?database {_LIC}(?:{_V} 1 0)?"),
    ("open", "odc-by-1.0", rf"open data commons attribution {_LIC}(?:{_V} 1 0)?"),
    ("open", "pddl-1.0", rf"open data commons public domain dedication(?: and {_LIC})?"),
    ("open", "ogl-3.0", rf"open government {_LIC}(?:{_V} 3 0)?"),
    ("openrail", "openrail", r"(?:creativeml )?openrail(?: m)?"),
    ("responsible", "openrail", r"(?:open )?responsible ai licen[cs]es?(?: rail)?"),
    ("business", "busl-1.1", rf"business source {_LIC}(?:{_V} 1 1)?"),
    ("server", "sspl-1.0", rf"server side public {_LIC}(?:{_V} 1)?"),
    ("sspl", "sspl-1.0", r"sspl(?: 1 0)?"),
    ("elastic", "elastic-2.0", rf"elastic {_LIC}(?:{_V} 2 0)?"),
    ("commons", "commons-clause", r"commons clause"),
    ("polyform", "polyform", r"polyform (?:noncommercial|strict|small business|shield|perimeter|internal use|free trial)"),
    ("llama", "llama-community", rf"llama [23](?: [0-9])? community {_LIC}"),
    ("q", "qpl-1.0", rf"q public {_LIC}(?:{_V} 1 0)?"),
    ("qt", "qpl-1.0", rf"qt public {_LIC}(?:{_V} 1 0)?"),
    ("ibm", "ipl-1.0", rf"ibm public {_LIC}(?:{_V} 1 0)?"),
    ("intel", "intel", rf"intel open source {_LIC}"),
    ("nasa", "nasa-1.3", rf"nasa open source agreement(?:{_V} 1 3)?"),
    ("lppl", "lppl-1.3c", r"lppl(?: 1 3c?)?"),
    ("latex", "lppl-1.3c", rf"latex project public {_LIC}(?:{_V} 1 3c?)?"),
    ("unicode", "unicode-dfs", rf"unicode (?:data files and software )?{_LIC}"),
    ("vim", "vim", rf"vim {_LIC}"),
    ("w3c", "w3c", rf"w3c (?:software (?:notice and )?)?{_LIC}"),
    ("ncsa", "ncsa", rf"(?:university of illinois )?ncsa (?:open source )?{_LIC}"),
    ("zope", "zpl-2.1", rf"zope public {_LIC}(?:{_V} 2 1)?"),
    ("sleepycat", "sleepycat", rf"sleepycat {_LIC}"),
    ("mulan", "mulan-psl-2.0", rf"mulan (?:permissive software|psl)(?: {_LIC})?(?:{_V} 2)?"),
    ("hippocratic", "hippocratic", rf"hippocratic {_LIC}"),
    ("beerware", "beerware", r"beerware"),
    ("beer", "beerware", rf"beer ware {_LIC}"),
    ("cecill", "cecill", r"cecill(?: (?:b|c|2 1))?"),
    ("blue", "blueoak-1.0.0", rf"blue oak model {_LIC}(?:{_V}? 1 0 0)?"),
]
#: Wording of licence texts, and mentions that name no licence.
TEXTS = [
    ("permission", "mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("permission", "isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("permission", "hpnd", r"permission to use copy modify and distribute this software and its documentation"),
    ("redistribution", "bsd-family", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("redistribution", "redistribution-free", r"redistribution (?:is|and use) (?:freely )?permitted"),
    ("warranty", "no-warranty", r"(?:comes with|there is) absolutely no warranty"),
    ("warranty", "no-warranty", r"without (?:any )?warranty (?:or conditions )?of any kind"),
    ("warranties", "no-warranty", r"without (?:any )?warranties (?:or conditions )?of any kind"),
    ("warranty", "gpl-family", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("unencumbered", "unlicense", r"free and unencumbered software released into the public domain"),
    ("domain", "public-domain", r"(?:released |placed |dedicated )?(?:in|into|to) the public domain"),
    ("domain", "public-domain", r"public domain"),
    ("rights", "all-rights-reserved", r"all rights reserved"),
    ("rights", "some-rights-reserved", r"some rights reserved"),
    ("copyright", "copyright-notice", r"copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("confidential", "proprietary", r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", "proprietary", r"proprietary (?:software|information)"),
    ("proprietary", "proprietary", rf"proprietary {_LIC}"),
    ("commercial", "non-commercial", r"(?:for )?non commercial (?:use|purposes)(?: only)?"),
    ("noncommercial", "non-commercial", r"(?:for )?noncommercial (?:use|purposes)(?: only)?"),
    ("research", "research-only", r"(?:for )?research (?:use|purposes) only"),
    ("copyleft", "copyleft", r"copyleft"),
    ("eula", "eula", r"eula"),
    ("user", "eula", rf"end user {_LIC} agreement"),
    ("licensed", "licensed-under", r"(?:dual |multi )?licensed under (?:the )?(?:terms of (?:the )?)?"),
    ("released", "licensed-under", r"released under (?:the )?(?:terms of (?:the )?)?"),
    ("license", "license-mention", r"see (?:the )?(?:file )?licen[cs]e(?: file)?(?: for details| for more information)?"),
    ("license", "license-mention", r"(?:this )?(?:software |work )?licen[cs]e agreement"),
    ("licence", "license-mention", r"(?:this )?(?:software |work )?licen[cs]e agreement"),
    ("licence", "license-mention", r"see (?:the )?(?:file )?licen[cs]e(?: file)?(?: for details| for more information)?"),
]
#: Identifiers after "spdx license identifier" (fixed values).
SPDX = "agpl-3.0-only agpl-3.0-or-later apache-2.0 artistic-2.0 bsd-2-clause bsd-3-clause bsl-1.0 cc-by-4.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.2 gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later isc lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later mit mit-0 mpl-2.0 ncsa ofl-1.1 postgresql python-2.0 unlicense upl-1.0 wtfpl zlib 0bsd".split()


def rules() -> list[tuple[int, str, bool, str, str, int, float]]:
    """(rule, gate, needs the word licence, label, expression, priority, confidence), in order; a lower priority number wins."""
    found = [("spdx", s, rf"spdx licen[cs]e identifier {s.replace('-', ' ').replace('.', ' ')}", 1, 1.0) for s in sorted(SPDX, key=len, reverse=True)]
    for gate, label, name in NAMES:
        vague = label.endswith("-family")
        found.append((gate, label, rf"(?:dual )?(?:licensed|licenced|released|distributed|available|published|covered|redistributable|provided) under (?:the )?(?:terms of (?:the )?)?(?:{name})", 4 if vague else 2, 0.95))
        found.append((gate, label, rf"(?:{name})", 5 if vague else 3, 0.6 if vague else 0.8))
    found += [(gate, label, rf"(?:{text})", 6, 0.5) for gate, label, text in TEXTS]
    # the word is part of the name, neither optional nor one of several ways
    needs = lambda gate, e: gate not in ("responsible", *WORD) and _LIC in e and f"{_LIC})?" not in e and f"(?:{_LIC}" not in e and f" {_LIC}{_V} )?" not in e
    return [(n, gate, needs(gate, e), label, e, *rest) for n, (gate, label, e, *rest) in enumerate(found)]


def words_of(text: Column) -> Column:
    """The text's words, lower-cased, with one blank between and around them; a single blank if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _base_starts(words: Column) -> Column:
    """Word positions of all places of base phrases, as (start, label), in the order of the phrases."""

    def places(phrase: str, label: str) -> Column:
        own = phrase.split()
        last = F.size(words) - len(own)
        stands = lambda i: reduce(lambda a, b: a & b, (F.get(words, i + k) == w for k, w in enumerate(own)))
        at = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: stands(i))
        return F.transform(at, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    return F.concat(*(places(p, x) for p, x in BASE.items()))


def _spans(norm: Column, expression: Column) -> Column:
    """Word intervals [start, end) of an expression's matches: the words between matches are counted, then summed up."""
    whole = F.concat(F.lit("(?<= )(?:"), expression, F.lit(")(?= )"))
    gaps = F.split(norm, whole)
    hits = F.regexp_extract_all(norm, whole, F.lit(0))
    # a gap begins or ends with the blank beside a match: as many words as blanks, less one
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct((_blanks(g) - 1).alias("gap"), (_blanks(F.trim(h)) + 1).alias("n")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    step = lambda acc, p: F.concat(acc, F.array(F.struct((F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0)) + p["gap"]).cast("long").alias("start"), (F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0)) + p["gap"] + p["n"]).cast("long").alias("end"))))
    return F.aggregate(pairs, empty, step)


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), "rule int, gate string, needs_license boolean, label string, expression string, priority int, confidence double")


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    ``detections`` are the rules' intervals that stay: start, end (exclusive), label,
    priority, confidence.  Rows are joined by a row key of their own, not by id.
    """
    gates = sorted({r[1] for r in rules()} | {"cc", *WORD})
    norm = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("norm"))
    counted = norm.select("doc_id", "norm", (_blanks(F.col("norm")) - 1).cast("long").alias("n_words"), F.array_intersect(F.split("norm", " "), F.lit(gates)).alias("guards"))
    named = F.arrays_overlap("guards", F.lit([*WORD]))
    # rules by gate word, as one literal map: a bounded table inside the plan, so that nothing is shuffled
    kind = "array<struct<rule:int,needs:boolean,label:string,expression:string,priority:int,confidence:double>>"
    by_gate: dict[str, list] = {}
    for n, gate, *rest in rules():
        by_gate.setdefault(gate, []).append(dict(zip(("rule", "needs", "label", "expression", "priority", "confidence"), (n, *rest), strict=True)))
    table = F.from_json(F.lit(json.dumps(by_gate)), f"map<string,{kind}>")
    guarded = F.flatten(F.transform("guards", lambda g: F.coalesce(F.element_at(table, g), F.array().cast(kind))))
    gated = counted.withColumn("rules", F.when(F.size("guards") > 0, F.filter(guarded, lambda r: ~r["needs"] | named)))
    found = F.flatten(F.transform("rules", lambda r: F.transform(_spans(F.col("norm"), r["expression"]), lambda s: F.struct(r["priority"].alias("priority"), r["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end"), r["label"].alias("label"), r["confidence"].alias("confidence")))))
    within = lambda a, b: (b["start"] <= a["start"]) & (a["end"] <= b["end"])
    longer = lambda a, b: (b["end"] - b["start"]) > (a["end"] - a["start"])
    stronger = lambda a, b: (b["priority"] < a["priority"]) | ((b["priority"] == a["priority"]) & (longer(a, b) | ((b["end"] - b["start"] == a["end"] - a["start"]) & (b["rule"] < a["rule"]))))
    based = F.array_contains("guards", "license") | F.array_contains("guards", "cc")
    scanned = gated.withColumn("words", F.when(based, F.filter(F.split("norm", " "), lambda w: w != ""))).withColumn("base", F.when(based, _base_starts(F.col("words")))).withColumn("found", F.when(F.size("rules") > 0, F.array_sort(found)))
    kept = F.filter("found", lambda a: ~F.exists("found", lambda b: within(a, b) & stronger(a, b)))
    scanned = scanned.withColumn("detections", F.coalesce(kept, F.array().cast("array<struct<priority:int,rule:int,start:bigint,end:bigint,label:string,confidence:double>>")))
    starts = F.transform("base", lambda x: x["start"])
    base_labels = F.coalesce(F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"]))), F.array().cast("array<string>"))
    more = F.transform("detections", lambda d: d["label"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size(starts), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, more))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)), F.when(F.size(starts) > 0, 0.8).otherwise(0.0)).alias("score"),
        "detections",
    )
