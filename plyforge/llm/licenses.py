"""License scans: ordered signature rules behind a keyword gate, overlaps settled by priority.

Rules are regular expressions over lower-cased text whose white space runs are single spaces. A
rule runs only on texts that hold one of its keywords, which are read off its pattern so that every
match holds one. Of two detections, one that lies inside a detection
of a higher priority (or of the same priority and longer) is dropped. Base phrases are counted
apart, on words.

Defined cases: null and empty texts have no words, no labels and score 0; null ids and repeated
rows are scanned row by row; an empty table gives no rows; other columns are left out; long texts
are scanned whole.
"""

import re
from functools import lru_cache
from re import _parser as parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm import batches as B

#: Phrases whose places are counted on words, with their labels.
BASE = (
    (("mit", "license"), "mit"),
    (("apache", "license"), "apache"),
    (("general", "public", "license"), "gpl"),
)

#: label, name patterns, short identifiers, address pattern.
FAMILIES = (
    ("mit", [r"mit licen[cs]e", r"mit/x11", r"expat licen[cs]e", r"x11 licen[cs]e"], ["mit", "mit-0", "x11"], r"opensource\.org/licenses/mit"),
    ("apache", [r"apache licen[cs]e(?:,? version)? ?(?:1\.0|1\.1|2(?:\.0)?)?", r"apache software licen[cs]e", r"apache[- ]2(?:\.0)?"], ["apache-1.0", "apache-1.1", "apache-2.0"], r"apache\.org/licenses/"),
    ("gpl", [r"(?:gnu )?general public licen[cs]e(?:,? (?:version|v)\.? ?[123])?"], ["gpl-1.0", "gpl-2.0", "gpl-3.0"], r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("gpl", [r"\bgnu gpl\b", r"\bgpl ?v?[123]\b", r"\bgpl(?:ed|'d)?\b"], ["gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later"], r"fsf\.org/licens\w+/gpl"),
    ("lgpl", [r"(?:gnu )?lesser general public licen[cs]e(?:,? (?:version|v)\.? ?[23](?:\.1)?)?"], ["lgpl-2.1", "lgpl-3.0"], r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("lgpl", [r"(?:gnu )?library general public licen[cs]e"], ["lgpl-2.0"], r"gnu\.org/copyleft/lesser"),
    ("lgpl", [r"\blgpl ?v?[23](?:\.1)?\b", r"\blgpl\b"], ["lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0-only"], r"fsf\.org/licens\w+/lgpl"),
    ("agpl", [r"(?:gnu )?affero general public licen[cs]e(?:,? (?:version|v)\.? ?3)?"], ["agpl-1.0", "agpl-3.0"], r"gnu\.org/licenses/agpl"),
    ("agpl", [r"\bagpl ?v?3?\b"], ["agpl-3.0-only", "agpl-3.0-or-later"], r"affero\.org/"),
    ("gfdl", [r"(?:gnu )?free documentation licen[cs]e"], ["gfdl-1.2", "gfdl-1.3"], r"gnu\.org/licenses/fdl"),
    ("bsd-2-clause", [r"(?:2|two)[- ]clause bsd", r"simplified bsd licen[cs]e", r"freebsd licen[cs]e"], ["bsd-2-clause"], r"opensource\.org/licenses/bsd-2"),
    ("bsd-3-clause", [r"(?:3|three)[- ]clause bsd", r"(?:new|modified|revised) bsd licen[cs]e"], ["bsd-3-clause"], r"opensource\.org/licenses/bsd-3"),
    ("bsd-4-clause", [r"(?:4|four)[- ]clause bsd", r"original bsd licen[cs]e"], ["bsd-4-clause"], r"bsd-4-clause"),
    ("bsd", [r"\bbsd(?:[- ]style)? licen[cs]e", r"berkeley software distribution licen[cs]e"], ["0bsd", "bsd-1-clause"], r"opensource\.org/licenses/bsd-license"),
    ("isc", [r"\bisc licen[cs]e"], ["isc"], r"opensource\.org/licenses/isc"),
    ("mpl", [r"mozilla public licen[cs]e(?:,? (?:version|v)\.? ?(?:1\.0|1\.1|2\.0))?"], ["mpl-1.1", "mpl-2.0"], r"mozilla\.org/mpl"),
    ("epl", [r"eclipse public licen[cs]e", r"eclipse distribution licen[cs]e"], ["epl-1.0", "epl-2.0"], r"eclipse\.org/legal/epl"),
    ("cddl", [r"common development and distribution licen[cs]e"], ["cddl-1.0", "cddl-1.1"], r"opensource\.org/licenses/cddl"),
    ("cpl", [r"common public licen[cs]e", r"\bibm public licen[cs]e"], ["cpl-1.0"], r"opensource\.org/licenses/cpl"),
    ("eupl", [r"european union public licen[cs]e"], ["eupl-1.1", "eupl-1.2"], r"eupl\.eu"),
    ("artistic", [r"(?:perl )?artistic licen[cs]e(?: (?:1|2)\.0)?"], ["artistic-1.0", "artistic-2.0"], r"opensource\.org/licenses/artistic"),
    ("zlib", [r"\bzlib(?:/libpng)? licen[cs]e"], ["zlib"], r"opensource\.org/licenses/zlib"),
    ("libpng", [r"\blibpng licen[cs]e"], ["libpng", "libpng-2.0"], r"libpng\.org/pub/png/src/libpng-license"),
    ("boost", [r"boost software licen[cs]e"], ["bsl-1.0"], r"boost\.org/license"),
    ("unlicense", [r"\bthe unlicen[cs]e", r"\bunlicen[cs]e\b"], ["unlicense"], r"unlicense\.org"),
    ("wtfpl", [r"\bwtfpl\b", r"do what the f\w+ you want to public licen[cs]e"], ["wtfpl"], r"wtfpl\.net"),
    ("cc0", [r"\bcc0(?: 1\.0)?\b", r"creative commons zero"], ["cc0-1.0"], r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", [r"creative commons attribution(?: [1-4]\.0)?(?! ?-? ?(?:share|non|no))", r"\bcc[- ]by(?: [1-4]\.0)?(?!-)"], ["cc-by-3.0", "cc-by-4.0"], r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", [r"creative commons attribution[- ]share ?alike", r"\bcc[- ]by[- ]sa\b"], ["cc-by-sa-3.0", "cc-by-sa-4.0"], r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-nc", [r"creative commons attribution[- ]non ?-?commercial(?!-)", r"\bcc[- ]by[- ]nc\b(?!-)"], ["cc-by-nc-3.0", "cc-by-nc-4.0"], r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nc-sa", [r"creative commons attribution[- ]non ?-?commercial[- ]share ?alike", r"\bcc[- ]by[- ]nc[- ]sa\b"], ["cc-by-nc-sa-4.0"], r"creativecommons\.org/licenses/by-nc-sa/"),
    ("cc-by-nd", [r"creative commons attribution[- ]no ?-?deriv\w+", r"\bcc[- ]by[- ]nd\b"], ["cc-by-nd-4.0"], r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-nc-nd", [r"creative commons attribution[- ]non ?-?commercial[- ]no ?-?deriv\w+", r"\bcc[- ]by[- ]nc[- ]nd\b"], ["cc-by-nc-nd-4.0"], r"creativecommons\.org/licenses/by-nc-nd/"),
    ("cc-by", [r"\bcc-by(?:-[1-4]\.0)?\b(?!-)"], ["cc-by-1.0", "cc-by-2.0"], r"/by/[1-4]\.0/legalcode"),
    ("odbl", [r"open database licen[cs]e", r"\bodbl\b"], ["odbl-1.0"], r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", [r"open data commons attribution licen[cs]e"], ["odc-by-1.0"], r"opendatacommons\.org/licenses/by"),
    ("pddl", [r"public domain dedication and licen[cs]e"], ["pddl-1.0"], r"opendatacommons\.org/licenses/pddl"),
    ("psf", [r"python software foundation licen[cs]e", r"\bpsf licen[cs]e"], ["psf-2.0", "python-2.0"], r"python\.org/psf/license"),
    ("ruby", [r"\bruby licen[cs]e"], ["ruby"], r"ruby-lang\.org/en/about/license"),
    ("php", [r"\bphp licen[cs]e"], ["php-3.0", "php-3.01"], r"php\.net/license"),
    ("openssl", [r"\bopenssl licen[cs]e"], ["openssl"], r"openssl\.org/source/license"),
    ("postgresql", [r"\bpostgresql licen[cs]e"], ["postgresql"], r"postgresql\.org/about/licen"),
    ("ncsa", [r"university of illinois(?:/ncsa)? open source licen[cs]e"], ["ncsa"], r"opensource\.org/licenses/ncsa"),
    ("ms-pl", [r"microsoft public licen[cs]e"], ["ms-pl"], r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", [r"microsoft reciprocal licen[cs]e"], ["ms-rl"], r"opensource\.org/licenses/ms-rl"),
    ("osl", [r"open software licen[cs]e(?: (?:version|v)\.? ?[123]\.\d)?"], ["osl-3.0"], r"opensource\.org/licenses/osl"),
    ("afl", [r"academic free licen[cs]e"], ["afl-3.0"], r"opensource\.org/licenses/afl"),
    ("ofl", [r"(?:sil )?open font licen[cs]e"], ["ofl-1.0", "ofl-1.1"], r"scripts\.sil\.org/ofl"),
    ("apsl", [r"apple public source licen[cs]e"], ["apsl-2.0"], r"opensource\.apple\.com/license/apsl"),
    ("qpl", [r"\bq public licen[cs]e"], ["qpl-1.0"], r"opensource\.org/licenses/qpl"),
    ("sspl", [r"server side public licen[cs]e"], ["sspl-1.0"], r"mongodb\.com/licensing/server-side"),
    ("busl", [r"business source licen[cs]e"], ["busl-1.1"], r"mariadb\.com/bsl"),
    ("elastic", [r"\belastic licen[cs]e(?: 2\.0)?"], ["elastic-2.0"], r"elastic\.co/licensing"),
    ("commons-clause", [r"commons clause(?: licen[cs]e condition)?"], ["commons-clause"], r"commonsclause\.com"),
    ("upl", [r"universal permissive licen[cs]e"], ["upl-1.0"], r"opensource\.org/licenses/upl"),
    ("bluoak", [r"blue oak model licen[cs]e"], ["blueoak-1.0.0"], r"blueoakcouncil\.org/license"),
    ("mulan", [r"mulan (?:permissive software|psl) ?licen[cs]e"], ["mulanpsl-2.0"], r"license\.coscl\.org\.cn"),
    ("w3c", [r"\bw3c software (?:notice and )?licen[cs]e"], ["w3c"], r"w3\.org/consortium/legal"),
    ("vim", [r"\bvim licen[cs]e"], ["vim"], r"vimhelp\.org/uganda"),
    ("latex", [r"latex project public licen[cs]e"], ["lppl-1.3c"], r"latex-project\.org/lppl"),
    ("hpnd", [r"historical permission notice and disclaimer"], ["hpnd"], r"opensource\.org/licenses/hpnd"),
    ("unicode", [r"\bunicode licen[cs]e"], ["unicode-dfs-2016", "unicode-3.0"], r"unicode\.org/license"),
    ("open-government", [r"open government licen[cs]e"], ["ogl-uk-3.0"], r"nationalarchives\.gov\.uk/doc/open-government"),
    ("public-domain", [r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", r"\bpublic domain\b"], ["public-domain"], r"creativecommons\.org/publicdomain/mark"),
    ("openrail", [r"\b(?:creativeml )?open ?rail(?:\+\+)?(?:-m)? licen[cs]e", r"\bopenrail(?:-m)?\b"], ["openrail", "creativeml-openrail-m"], r"bigscience\.huggingface\.co"),
)

#: label, priority, pattern: sentences of licence texts and general notices.
TEXTS = (
    ("mit", 50, r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", 45, r"deal in the software without restriction"),
    ("isc", 50, r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose with or without fee"),
    ("bsd", 50, r"redistribution and use in source and binary forms, with or without modification"),
    ("bsd-3-clause", 52, r"neither the names? of .{1,80}? nor the names of (?:its|their|the) contributors"),
    ("bsd-4-clause", 53, r"all advertising materials mentioning features or use of this software"),
    ("apache", 50, r"you may not use this file except in compliance with the licen[cs]e"),
    ("gpl", 48, r"redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", 49, r"redistribute it and/or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("agpl", 49, r"redistribute it and/or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gfdl", 48, r"with no invariant sections"),
    ("mpl", 50, r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("zlib", 48, r"altered source versions must be plainly marked as such"),
    ("boost", 51, r"any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", 50, r"free and unencumbered software released into the public domain"),
    ("cc0", 48, r"waive[sd]? all copyright and related or neighboring rights"),
    ("wtfpl", 48, r"you just do what the \S+ you want to"),
    ("commercial", 12, r"\bcommercial licen[cs]e\b"),
    ("proprietary", 12, r"\bproprietary (?:and confidential|licen[cs]e|software)\b"),
    ("all-rights-reserved", 5, r"\ball rights reserved\b"),
    ("copyright", 4, r"\bcopyright (?:\(c\)|©|[12]\d{3}|by|notice)"),
    ("dual-licence", 6, r"\bdual[- ]licen[cs]ed?\b"),
    ("see-licence-file", 3, r"\bsee (?:the )?(?:file )?(?:licen[cs]e|copying)(?:\.(?:txt|md))?(?: file)?\b"),
    ("creative-commons", 8, r"\bcreative commons(?: licen[cs]e)?\b"),
    ("open-source", 3, r"\bopen[- ]source licen[cs]e\b"),
    ("terms-of-use", 2, r"\bterms of (?:use|service)\b"),
)
GRANT = r"\b(?:licen[cs]ed|released|distributed|available|published|provided|covered)(?: to you)? (?:under|by) (?:the )?(?:terms of )?(?:the )?\b(?:{})"
CONFIDENCE = ((40, 0.99), (30, 0.95), (20, 0.8), (10, 0.5), (0, 0.3))
BASE_CONFIDENCE = 0.8


class Rule(NamedTuple):
    label: str
    keywords: tuple[str, ...]
    priority: int
    pattern: str


def _needed(parts) -> tuple[str, ...]:
    """Texts of which every match of the parsed pattern holds at least one; none if not known."""
    found, run = [], [""]
    for op, value in [*parts, (None, None)]:
        chars = value if op is parser.IN else [(op, value)]
        if all(kind is parser.LITERAL for kind, _ in chars) and len(run) * len(chars) <= 16:
            run = [text + chr(x) for text in run for _, x in chars]
            continue
        found.append(tuple(run))
        run = [""]
        if op is parser.SUBPATTERN:
            found.append(_needed(value[3]))
        elif op is parser.BRANCH:
            every = [_needed(branch) for branch in value[1]]
            found.append(tuple(sorted({x for one in every for x in one})) if all(every) else ())
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0]:
            found.append(_needed(value[2]))
    found = [own for own in found if own and min(map(len, own))]
    return max(found, key=lambda own: (min(3, *map(len, own)), -len(own), min(map(len, own))), default=())


def keywords(pattern: str) -> tuple[str, ...]:
    return _needed(parser.parse(pattern))


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules: licence texts, then per family identifiers, grants, addresses and names."""
    out = list(TEXTS)
    for label, names, ids, address in FAMILIES:
        for name in names:
            out.append((label, 20, rf"(?<!\w)(?:{name})"))
            out.append((label, 30, GRANT.format(name)))
        out.append((label, 25, address))
        for code in ids:
            out.append((label, 40, rf"spdx-licen[cs]e-identifier: ?{re.escape(code)}(?![\w.-])"))
    return tuple(Rule(label, keywords(pattern), priority, pattern) for label, priority, pattern in out)


def kept(found: list[tuple]) -> list[tuple]:
    """Detections (start, end, priority, label) that do not lie inside a stronger or longer one.

    Of two with the same place and priority the first label stays. The detections are gone through
    from the left, the longer first; for each priority the farthest end so far is known, and one
    that ends before the farthest end of its own or a higher priority is inside such a one. What was
    dropped lies in something stronger that stays, so it need not be told apart.
    """
    out, farthest = [], {}
    for one in sorted(set(found), key=lambda x: (x[0], -x[1], -x[2], x[3])):
        start, end, priority, _ = one
        if not any(own >= priority and last >= end for own, last in farthest.items()):
            out.append(one)
        farthest[priority] = max(end, farthest.get(priority, end))
    return sorted(out)


class Scanner:
    """Compiled rules by keywords; a single search tells whether any keyword occurs at all."""

    def __init__(self):
        self.by_keywords = {}
        for rule in rules():
            own = self.by_keywords.setdefault(rule.keywords, [])
            own.append((re.compile(rule.pattern), rule.priority, rule.label))

    def __call__(self, text: str) -> list[tuple]:
        """Kept detections of a lower-cased text."""
        keys = [own for own in self.by_keywords if any(key in text for key in own)]
        found = [
            (match.start(), match.end(), priority, label)
            for key in keys
            for pattern, priority, label in self.by_keywords[key]
            for match in pattern.finditer(text)
        ]
        return kept(found)


def gate() -> re.Pattern:
    """A search in raw lower-cased bytes that finds a keyword in every text that any rule matches.

    A space may stand for any white space there, which control and non-ASCII bytes can be.
    """
    keys = {"license", *(key for rule in rules() for key in rule.keywords)}
    least = sorted(key for key in keys if not any(x != key and x in key for x in keys))
    return re.compile(_any_of(key.encode() for key in least))


def _any_of(texts) -> bytes:
    """A pattern of any of the texts, branching byte by byte, which is faster than a list of them."""
    by_first = {}
    for text in texts:
        by_first.setdefault(text[:1], []).append(text[1:])
    if b"" in by_first:
        return b""
    parts = [(b"[\x00-\x20\x80-\xff]+" if x == b" " else re.escape(x)) + _any_of(y) for x, y in by_first.items()]
    return parts[0] if len(parts) == 1 else b"(?:" + b"|".join(parts) + b")"


SCHEMA = (
    "doc_id long, n_words long, base array<struct<word: long, label: string>>,"
    " detections array<struct<start: long, end: long, priority: int, label: string>>"
)
_FIELDS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("base", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
        (
            "detections",
            pa.list_(
                pa.struct(
                    [
                        ("start", pa.int64()),
                        ("end", pa.int64()),
                        ("priority", pa.int32()),
                        ("label", pa.string()),
                    ]
                )
            ),
        ),
    ]
)


def base_places(text: str) -> list[tuple[int, str]]:
    """(word number, label) of every place of a base phrase in a lower-cased text."""
    words = B.WORD.findall(text)
    out = []
    for at, word in enumerate(words):
        for phrase, label in BASE:
            if word == phrase[0] and tuple(words[at : at + len(phrase)]) == phrase:
                out.append((at, label))
    return out


def _scan(batches):
    scanner, gated = Scanner(), gate()
    lowered = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    for batch in B.slices(batches, "text"):
        column = batch.column("text")
        data, bounds = B.raw(column)
        data = data.tobytes().translate(lowered)
        base = [[] for _ in range(batch.num_rows)]
        found = [[] for _ in range(batch.num_rows)]
        hits = np.array([match.start() for match in gated.finditer(data)], np.int64)
        for row in np.unique(np.searchsorted(bounds, hits, "right") - 1).tolist():
            text = data[bounds[row] : bounds[row + 1]].decode()
            if "license" in text:
                base[row] = [{"word": at, "label": x} for at, x in base_places(text)]
            found[row] = [
                {"start": a, "end": b, "priority": priority, "label": label}
                for a, b, priority, label in scanner(re.sub(r"\s+", " ", text))
            ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(B.word_counts(column)),
                pa.array(base, _FIELDS.field("base").type),
                pa.array(found, _FIELDS.field("detections").type),
            ],
            schema=_FIELDS,
        )


def scan(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """Per document its word count, base phrase places and kept rule detections.

    Detection offsets count characters of the text with single spaces.
    """
    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    return narrow.mapInArrow(_scan, SCHEMA)


def summary(scanned: DataFrame) -> DataFrame:
    """Counts, sorted labels and a score per scanned document."""
    base, rules_found = F.col("base"), F.col("detections")
    base_labels = F.array_sort(F.array_distinct(base["label"]))
    best = F.when(F.size(base) > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0))
    confidence = F.lit(0.0)
    strongest = F.array_max(rules_found["priority"])
    for least, value in reversed(CONFIDENCE):
        confidence = F.when(strongest >= least, F.lit(value)).otherwise(confidence)
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["word"]).alias("first_word"),
        F.array_max(base["word"]).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_union(base["label"], rules_found["label"])), ","
        ).alias("labels"),
        F.greatest(best, confidence).alias("score"),
    )
