"""Licence signatures: hand-written names, notices and URLs over normalised words.

A signature is a regular expression over words in lower case that are set apart by one
space; ``compiled`` turns it into one over text whose words each stand between two
spaces of their own.  ``GATES`` are words that every match of a rule holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    label: str
    gates: tuple[str, ...]
    pattern: str
    priority: int  # a stronger rule (lower) suppresses what lies inside its match
    weight: float

    @property
    def compiled(self) -> str:
        return " " + self.pattern.replace(" ", "  ") + " "


#: What a raw text must hold before any rule is tried; each rule has a gate that it matches.
ANCHOR = "licen[cs]|spdx|gpl|commons|copyright|copyleft|wtfpl|cc0|domain|redistribution|warranty|unlicense|permission"

NOTICE = ("(licen[cs]ed|released|distributed|available|provided|published|covered|governed|redistributed|offered|shared)"
          "( [^ ]+)? (under|by|with|through|in accordance with)( the| a| an)?( terms| terms and conditions| provisions)?( of)?( the)? ")
#: Priorities and weights of a notice, a tag, a name with its version, a bare name or phrase.
NOTED, TAGGED, VERSIONED, NAMED = (1, 1.0), (2, 0.95), (3, 0.85), (4, 0.7)

#: label, gates, name, identifier, versions.  A gate is a word of every match of the name.
FAMILIES = [
    ("gpl", ("general", "license"), "(gnu )?general public license( gpl| gnu gpl)?", "gpl", ("1.0", "2.0", "3.0")),
    ("gpl", ("gpl",), "(gnu )?gpl", "gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", ("general", "license"), "(gnu )?(lesser|library)( or lesser)? general public license( lgpl| gnu lgpl)?", "lgpl", ("2.0", "2.1", "3.0")),
    ("lgpl", ("lgpl",), "(gnu )?lgpl", "lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", ("general", "license"), "(gnu )?affero general public license( agpl| gnu agpl)?", "agpl", ("1.0", "3.0")),
    ("agpl", ("agpl",), "(gnu )?agpl", "agpl", ("1.0", "3.0")),
    ("gfdl", ("documentation", "license"), "(gnu )?free documentation license( gfdl)?", "gfdl", ("1.1", "1.2", "1.3")),
    ("apache", ("apache", "license"), "apache( software)? license", "apache", ("1.0", "1.1", "2.0")),
    ("mit", ("license",), "(mit( x11| expat)?|expat) license", "mit", ()),
    ("x11", ("x11", "license"), "x11 license", "x11", ()),
    ("bsd", ("bsd", "license"), "(original |new |modified |simplified |revised )?bsd( style)? license", "bsd", ()),
    ("bsd-0-clause", ("bsd", "license"), "(bsd (0|zero) clause|(0|zero) clause bsd) license", "0bsd", ()),
    ("bsd-1-clause", ("bsd", "license"), "(bsd (1|one) clause|(1|one) clause bsd) license", "bsd 1 clause", ()),
    ("bsd-2-clause", ("license",), "(bsd (2|two) clause|(2|two) clause bsd|simplified bsd|freebsd) license", "bsd 2 clause", ()),
    ("bsd-3-clause", ("bsd", "license"), "(bsd (3|three) clause|(3|three) clause bsd|(new|modified|revised) bsd) license", "bsd 3 clause", ()),
    ("bsd-4-clause", ("bsd", "license"), "(bsd (4|four) clause|(4|four) clause bsd|original bsd) license", "bsd 4 clause", ()),
    ("isc", ("isc", "license"), "isc license", "isc", ()),
    ("mpl", ("mozilla", "license"), "mozilla public license( mpl)?", "mpl", ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse", "license"), "eclipse public license( epl)?", "epl", ("1.0", "2.0")),
    ("edl", ("eclipse", "license"), "eclipse distribution license( edl)?", "edl", ("1.0",)),
    ("cddl", ("distribution", "license"), "common development and distribution license( cddl)?", "cddl", ("1.0", "1.1")),
    ("cpl", ("common", "license"), "common public license", "cpl", ("1.0",)),
    ("cpal", ("attribution", "license"), "common public attribution license", "cpal", ("1.0",)),
    ("eupl", ("european", "licence"), "european union public licence", "eupl", ("1.0", "1.1", "1.2")),
    ("eupl", ("european", "license"), "european union public license", "eupl", ("1.0", "1.1", "1.2")),
    ("osl", ("open", "license"), "open software license", "osl", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", ("academic", "license"), "academic free license", "afl", ("1.1", "2.0", "2.1", "3.0")),
    ("artistic", ("artistic", "license"), "artistic license", "artistic", ("1.0", "2.0")),
    ("bsl", ("boost", "license"), "boost software license", "bsl", ("1.0",)),
    ("busl", ("business", "license"), "business source license", "busl", ("1.1",)),
    ("sspl", ("server", "license"), "server side public license", "sspl", ("1.0",)),
    ("elastic", ("elastic", "license"), "elastic license", "elastic", ("2.0",)),
    ("polyform-noncommercial", ("polyform", "license"), "polyform noncommercial license", "polyform noncommercial", ("1.0",)),
    ("polyform-small-business", ("polyform", "license"), "polyform small business license", "polyform small business", ("1.0",)),
    ("zlib", ("zlib", "license"), "zlib( libpng)? license", "zlib", ()),
    ("libpng", ("libpng", "license"), "libpng license", "libpng", ("2.0",)),
    ("unlicense", ("unlicense",), "(the )?unlicense", "unlicense", ()),
    ("wtfpl", ("wtfpl",), "wtfpl", "wtfpl", ("2.0",)),
    ("beerware", ("beerware", "license"), "beerware license", "beerware", ()),
    ("python", ("python", "license"), "python( software foundation)? license", "psf", ("2.0",)),
    ("php", ("php", "license"), "php license", "php", ("3.0", "3.01")),
    ("ruby", ("ruby", "license"), "ruby license", "ruby", ()),
    ("perl", ("perl", "license"), "perl license", "perl", ()),
    ("w3c", ("w3c", "license"), "w3c( software( notice and)?)? license", "w3c", ()),
    ("openssl", ("openssl", "license"), "openssl license", "openssl", ()),
    ("postgresql", ("postgresql", "license"), "postgresql license", "postgresql", ()),
    ("ncsa", ("ncsa", "license"), "(university of illinois )?ncsa( open source)? license", "ncsa", ()),
    ("ms-pl", ("microsoft", "license"), "microsoft public license", "ms pl", ()),
    ("ms-rl", ("microsoft", "license"), "microsoft reciprocal license", "ms rl", ()),
    ("ibm-pl", ("ibm", "license"), "ibm public license", "ipl", ("1.0",)),
    ("sissl", ("sun", "license"), "sun industry standards source license", "sissl", ("1.1",)),
    ("spl", ("sun", "license"), "sun public license", "spl", ("1.0",)),
    ("npl", ("netscape", "license"), "netscape public license", "npl", ("1.0", "1.1")),
    ("qpl", ("q", "license"), "q public license", "qpl", ("1.0",)),
    ("lppl", ("latex", "license"), "latex project public license", "lppl", ("1.2", "1.3")),
    ("ofl", ("font", "license"), "(sil )?open font license", "ofl", ("1.0", "1.1")),
    ("ubuntu-font", ("font", "licence"), "ubuntu font licence", "ubuntu font", ("1.0",)),
    ("odbl", ("database", "license"), "open (data commons open )?database license( odbl)?", "odbl", ("1.0",)),
    ("odc-by", ("commons", "license"), "open data commons attribution license", "odc by", ("1.0",)),
    ("pddl", ("domain", "license"), "(open data commons )?public domain dedication and license", "pddl", ("1.0",)),
    ("ogl-uk", ("government", "licence"), "open government licence", "ogl uk", ("1.0", "2.0", "3.0")),
    ("etalab", ("licence", "ouverte"), "(etalab )?licence ouverte( etalab)?", "etalab", ("2.0",)),
    ("cecill", ("cecill", "license"), "cecill( free software)? license( agreement)?", "cecill", ("1.0", "2.0", "2.1")),
    ("cecill-b", ("cecill", "license"), "cecill b( free software)? license( agreement)?", "cecill b", ()),
    ("cecill-c", ("cecill", "license"), "cecill c( free software)? license( agreement)?", "cecill c", ()),
    ("mulan-psl", ("mulan", "license"), "mulan permissive software license", "mulanpsl", ("1.0", "2.0")),
    ("upl", ("universal", "license"), "universal permissive license", "upl", ("1.0",)),
    ("vim", ("vim", "license"), "vim license", "vim", ()),
    ("curl", ("curl", "license"), "curl license", "curl", ()),
    ("json", ("json", "license"), "json license", "json", ()),
    ("cc0", ("cc0",), "cc0", "cc0", ("1.0",)),
    ("openrail", ("license",), "(bigscience |creativeml )?open ?rail( m)? license", "openrail", ()),
    ("llama", ("llama", "license"), "llama( [0-9])? community license( agreement)?", "llama", ("2", "3")),
    ("gemma", ("gemma", "license"), "gemma license", "gemma", ()),
    ("c-uda", ("data", "license"), "computational use of data agreement license", "c uda", ("1.0",)),
    ("cdla-permissive", ("data", "license"), "community data license agreement permissive", "cdla permissive", ("1.0", "2.0")),
    ("cdla-sharing", ("data", "license"), "community data license agreement sharing", "cdla sharing", ("1.0",)),
    ("proprietary", ("license",), "(commercial|proprietary)( software)? license( agreement)?", "licenseref proprietary", ()),
    ("eula", ("license",), "end user license agreement( eula)?", "licenseref eula", ()),
]

#: Creative Commons by their elements: words in order, abbreviated words, versions.
COMMONS = [("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(s|atives|ative works)"),
           ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"),
           ("by-nc-nd", "attribution non ?commercial no ?deriv(s|atives|ative works)")]
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: label, gates, pattern, priority: phrases of licence bodies, URLs and words of no family.
PHRASES = [
    ("mit", ("permission", "charge"), "permission is hereby granted free of charge to any person obtaining a copy of this software", 1),
    ("isc", ("permission", "fee"), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1),
    ("bsd", ("redistribution", "binary"), "redistribution and use in source and binary forms with or without modification are permitted", 1),
    ("bsd-3-clause", ("permission", "endorse"), "may be used to endorse or promote products derived from this software without specific prior written permission", 1),
    ("bsl-1.0", ("permission", "accompanying"), "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 1),
    ("zlib", ("warranty", "express"), "this software is provided as is without any express or implied warranty", 2),
    ("unlicense", ("domain", "unencumbered"), "this is free and unencumbered software released into the public domain", 1),
    ("gpl", ("redistribute", "license"), "you can redistribute it and or modify it under the terms of the gnu general public license", 1),
    ("lgpl", ("redistribute", "license"), "you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license", 1),
    ("gpl", ("copyleft", "license"), "copyleft license", 4),
    ("apache-2.0", ("apache", "licenses"), "www apache org licenses license 2 0", 2),
    ("gpl", ("gnu", "licenses"), "www gnu org licenses( old licenses)? gpl( [0-9] [0-9])?( html| txt)?", 2),
    ("lgpl", ("gnu", "licenses"), "www gnu org licenses( old licenses)? lgpl( [0-9] [0-9])?( html| txt)?", 2),
    ("agpl", ("gnu", "licenses"), "www gnu org licenses agpl( [0-9] [0-9])?( html| txt)?", 2),
    ("mit", ("opensource", "licenses"), "opensource org licenses mit( license)?", 2),
    ("bsd-3-clause", ("opensource", "licenses"), "opensource org licenses bsd 3 clause", 2),
    ("bsd-2-clause", ("opensource", "licenses"), "opensource org licenses bsd 2 clause", 2),
    ("cc0-1.0", ("creativecommons", "publicdomain"), "creativecommons org publicdomain zero 1 0", 2),
    ("cc0-1.0", ("cc0", "universal"), "cc0 1 0 universal( public domain dedication)?", 2),
    ("public-domain", ("domain",), "(released|placed|dedicated|put)( in| into| to) the public domain", 2),
    ("public-domain", ("domain",), "public domain", 4),
    ("all-rights-reserved", ("copyright", "reserved"), "copyright( c)?( [^ ]+){0,6} all rights reserved", 3),
    ("proprietary", ("license",), "all rights reserved( [^ ]+){0,4} without( prior| a)?( written)? license", 2),
    ("no-license", ("license",), "no license( is| are)? granted", 2),
    ("wtfpl", ("license",), "do what the fuck you want to public license", 3),
    ("dual", ("licensed",), "dual licensed( under)?", 4),
    ("creative-commons", ("commons",), "creative commons", 4),
    ("creative-commons", ("commons", "license"), "creative commons( public)? license", 4),
]


def _version(v: str) -> str:
    """``2.0`` as `` version 2 0`` with the usual spellings; a trailing zero may be left out."""
    major, _, minor = v.partition(".")
    tail = "( 0)?" if minor == "0" else f" {minor}" if minor else ""
    return f"( only)?( as published by the free software foundation)?( either)?( version| v| ver)? v?{major}{tail}( or later| only| or any later version)?"


def _rules():
    for label, gates, name, tag, versions in FAMILIES:
        for v in (None, *versions):
            full = label if v is None else f"{label}-{v}"
            words = name if v is None else name + _version(v)
            kind = NAMED if v is None else VERSIONED
            yield Rule(full, gates, words, *kind)
            yield Rule(full, gates, NOTICE + words, *NOTED)
            yield Rule(full, ("spdx", "license"), "spdx license identifier " + (tag if v is None else f"{tag} " + v.replace(".", " ") + "( only| or later)?"), *TAGGED)
    for short, words in COMMONS:
        tag = "cc " + short.replace("-", " ")
        for v in (None, *COMMONS_VERSIONS):
            full = f"cc-{short}" if v is None else f"cc-{short}-{v}"
            tail = "" if v is None else "( license)?( version| v)? " + v.replace(".", " ")
            kind = NAMED if v is None else VERSIONED
            if v is not None:  # "cc by" alone is no name: it also opens lists of recipients
                yield Rule(full, ("cc", "by", v[0]), f"{tag}{tail}( international| unported| generic)?", *VERSIONED)
                yield Rule(full, ("creativecommons", "licenses"), f"creativecommons org licenses {short.replace('-', ' ')} " + v.replace(".", " "), *TAGGED)
            yield Rule(full, ("cc", "by"), NOTICE + tag + tail, *NOTED)
            yield Rule(full, ("commons", "attribution"), f"creative commons {words}{tail}( international| unported| generic)?( license)?", *kind)
            yield Rule(full, ("commons", "attribution"), NOTICE + f"creative commons {words}{tail}( international| unported| generic)?( license)?", *NOTED)
    weights = {1: 1.0, 2: 0.95, 3: 0.85, 4: 0.7}
    for label, gates, pattern, priority in PHRASES:
        yield Rule(label, gates, pattern, priority, weights[priority])


#: The rules in order: of two alike, the earlier one counts.
RULES = list(_rules())
#: Rules without a word of their own among the anchors: those of "cc by", opened by this raw form.
RAW_ANCHOR = ANCHOR + r"|cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by"

assert all(re.search(RAW_ANCHOR, " ".join(r.gates)) for r in RULES)
