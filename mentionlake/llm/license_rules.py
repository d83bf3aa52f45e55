"""Ordered signature rules for license texts, over normalised words.

A rule is (priority, label, keyword, pattern). Patterns see words of letters and digits,
lower-cased and joined by one blank; a keyword is a word that every match contains once, so
names without a word in common are families of their own. Sentences of license texts and
notices are written out one by one. Names are templates; versions, suffixes and ways of
naming a license are filled in. A bare name counts only with "license" behind it, after
"licensed under" or as an SPDX tag, unless no other word is written like it.
"""

from __future__ import annotations

from itertools import product

# What may lead up to a license name
_LEADS = r"(?:(?:licensed|released|distributed|available|published|provided) )?under (?:the )?(?:terms of )?(?:the )?"
_LICENSED = r"licen[cs]ed under (?:the )?(?:terms of )?(?:the )?"
# Names that mean nothing but the license, and one whose "license" is a figure of speech
_UNMISTAKABLE = {"unlicense", "wtfpl", "eupl", "cecill", "0bsd", "beerware"}
_IDIOMS = {"artistic"}

# label, keyword, pattern of the name
_FAMILIES = [
    ("mit", "mit", "mit"),
    ("mit-0", "mit", "mit no attribution|mit 0"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl(?: version 2)?"),
    ("x11", "x11", "x11"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    ("postgresql", "postgresql", "postgresql"),
    ("python-2", "python", "python software foundation"),
    ("python-2", "psf", "psf"),
    ("ruby", "ruby", "ruby"),
    ("php-3", "php", "php"),
    ("openssl", "openssl", "openssl"),
    ("boost-1", "boost", "boost software"),
    ("eupl", "european", "european union public"),
    ("eupl", "eupl", "eupl"),
    ("cecill", "cecill", "cecill"),
    ("ofl", "font", "sil open font"),
    ("ofl", "ofl", "ofl"),
    ("afl", "academic", "academic free"),
    ("osl", "osl", "osl"),
    ("artistic", "artistic", "artistic"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"),
    ("upl", "permissive", "universal permissive"),
    ("upl", "upl", "upl"),
    ("0bsd", "0bsd", "0bsd"),
    ("0bsd", "zero", "zero clause bsd"),
    ("beerware", "beerware", "beerware"),
    ("proprietary", "proprietary", "proprietary"),
]

# label stem, keyword, pattern of the name, versions
_VERSIONED = [
    ("apache", "apache", "apache(?: software)?", ["1 0", "1 1", "2 0", "2"]),
    ("gpl", "gpl", "(?:gnu )?gpl", ["1", "2", "3", "2 0", "3 0"]),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ["2", "2 1", "3", "3 0"]),
    ("agpl", "agpl", "(?:gnu )?agpl", ["1", "3", "3 0"]),
    ("gpl", "general", "(?:gnu )?general public", ["1", "2", "3", "2 0", "3 0"]),
    ("lgpl", "lesser", "(?:gnu )?lesser general public", ["2", "2 1", "3", "3 0"]),
    ("lgpl", "library", "(?:gnu )?library general public", ["2", "2 0"]),
    ("agpl", "affero", "(?:gnu )?affero general public", ["1", "3", "3 0"]),
    ("gfdl", "documentation", "(?:gnu )?free documentation", ["1 1", "1 2", "1 3"]),
    ("mpl", "mozilla", "mozilla public", ["1 0", "1 1", "2 0", "2"]),
    ("mpl", "mpl", "mpl", ["1 0", "1 1", "2 0", "2"]),
    ("epl", "eclipse", "eclipse public", ["1 0", "2 0", "1", "2"]),
    ("epl", "epl", "epl", ["1 0", "2 0", "1", "2"]),
    ("cddl", "cddl", "cddl", ["1 0", "1 1"]),
    ("cddl", "distribution", "common development and distribution", ["1 0", "1 1"]),
    ("cpl", "common", "common public", ["1 0"]),
    ("bsl", "business", "business source", ["1 1"]),
    ("eupl", "eupl", "eupl", ["1 1", "1 2"]),
    ("cecill", "cecill", "cecill", ["1 0", "2 0", "2 1"]),
    ("ofl", "font", "sil open font", ["1 0", "1 1"]),
    ("afl", "academic", "academic free", ["2 1", "3 0"]),
    ("osl", "software", "open software", ["2 1", "3 0"]),
    ("artistic", "artistic", "artistic", ["1 0", "2 0"]),
    ("zpl", "zope", "zope public", ["2 0", "2 1"]),
    ("lppl", "latex", "latex project public", ["1 2", "1 3", "1 3c"]),
    ("sspl", "server", "server side public", ["1"]),
]

_CC = ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]
_CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s", "nc": "non ?commercial"}
_CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

# label, keyword, pattern of a sentence that stands in the license text or its notice
_SENTENCES = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial", "this permission notice shall be included in all copies or substantial portions of the software"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("boost-1", "organization", "granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", "purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("postgresql", "agreement", "for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "appear", "provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice"),
    ("x11", "consortium", "the name of the x consortium shall not be used in advertising"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", "endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd-4", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license"),
    ("apache-2", "apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "acknowledgment", "end user documentation included with the redistribution if any must include the following acknowledgment"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "details", "see the gnu general public license for more details"),
    ("gpl-3", "conveying", "conveying under any other circumstances is permitted solely under the conditions stated below"),
    ("gpl-2", "verbatim", "you may copy and distribute verbatim copies of the program s source code as you receive it"),
    ("lgpl", "lesser", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "lesser", "see the gnu lesser general public license for more details"),
    ("agpl", "affero", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", "remotely", "must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "documentation", "to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-1.1", "contents", "the contents of this file are subject to the mozilla public license version"),
    ("epl", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "cddl", "may only be used under the terms of the common development and distribution license cddl"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("php-3", "php", "this product includes php software freely available from"),
    ("php-3", "php", "php licen[cs]e(?: version| v)? v?3(?: 0?1)?"),
    ("python-2", "python", "psf is making python available to licensee on an as is basis"),
    ("lppl", "latex", "may be distributed and or modified under the conditions of the latex project public license"),
    ("ofl", "fonts", "allows the licensed fonts to be used studied modified and redistributed freely"),
    ("ofl", "reserved", "with reserved font name"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "compile", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "zero", "creative commons zero"),
    ("cc0", "deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by-4.0", "attribution", "terms and conditions of this creative commons attribution 4 0 international public license"),
    ("odbl", "database", "(?:is )?made available under the open database licen[cs]e"),
    ("pddl", "dedication", "open data commons public domain dedication and licen[cs]e"),
    ("wtfpl", "fuck", "do what the fuck you want to public license"),
    ("beerware", "beer", "you think this stuff is worth it you can buy me a beer in return"),
    ("bsl", "production", "redistribute and make non production use of the licensed work"),
    ("sspl", "functionality", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2", "hosted", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "sell", "the license does not include and the license does not grant to you the right to sell the software"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|free trial) licen[cs]e"),
    ("openrail", "openrail", "(?:creativeml |bigscience |bigcode )?openrail(?: m)? licen[cs]e"),
    ("llama", "llama", "llama (?:2|3|4)(?: 1| 2| 3)? community licen[cs]e"),
    ("mulan-2", "mulan", "you can use this software according to the terms and conditions of the mulan psl v2"),
    ("vim", "vim", "vim licen[cs]e"),
    ("w3c", "w3c", "w3c software (?:notice and |and document notice and )?licen[cs]e"),
    ("unicode", "unicode", "unicode inc licen[cs]e agreement data files and software"),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e"),
    ("bsd-2", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?"),
    ("bsd-2", "freebsd", "freebsd(?: licen[cs]e)?"),
    ("bsd-3", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?"),
    ("bsd-4", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?"),
]

# label, keyword, pattern of what says little by itself and stands in open licenses too
_BOILERPLATE = [
    ("public-domain", "domain", "(?:dedicated to|released into|released to|placed in|placed into) the public domain(?! of\\b)"),
    ("public-domain", "domain", "(?:this|the) (?:software|work|file|code|program|library|document|text|data|dataset) is in the public domain(?! of\\b)"),
    ("proprietary", "reserved", "all rights reserved"),
    ("proprietary", "confidential", "confidential and proprietary"),
    ("proprietary", "prohibited", "(?:unauthorized )?(?:copying|reproduction|distribution) (?:of this \\w+ )?is (?:strictly )?prohibited"),
]
# Labels that boilerplate gives
WEAK = sorted({label for label, _, _ in _BOILERPLATE})


def rules() -> list[tuple[int, str, str, str]]:
    """All rules, the most exact first: priority 3 names a version or a full sentence,
    2 a license by its name with a lead or ending, 1 a short identifier or boilerplate."""
    out = [(3, label, keyword, pattern) for label, keyword, pattern in _SENTENCES]
    out += [(1, label, keyword, pattern) for label, keyword, pattern in _BOILERPLATE]
    for label, keyword, name, versions in _VERSIONED:
        for version in versions:
            exact = f"{label}-{version.replace(' ', '.').removesuffix('.0')}"
            out.append((3, exact, keyword, f"(?:{_LEADS})?(?:{name})(?: licen[cs]e)?(?: version| v)? v?{version}(?! [0-9]\\b)"))
            if "gpl" in label:
                out.append((3, f"{exact}-or-later", keyword, f"(?:{_LEADS})?(?:{name})(?: licen[cs]e)?(?: version| v)? v?{version} or (?:any |at your option any )?later"))
        out.append((2, label, keyword, f"{_LEADS}(?:{name}) licen[cs]e"))
        if keyword not in _IDIOMS:
            out.append((2, label, keyword, f"(?:{name}) licen[cs]e"))
    for label, keyword, name in _FAMILIES:
        out.append((2, label, keyword, f"{_LEADS if keyword in _UNMISTAKABLE else _LICENSED}(?:{name})"))
        out.append((2, label, keyword, f"{_LEADS}(?:{name}) licen[cs]e"))
        if keyword not in _IDIOMS:
            out.append((2, label, keyword, f"(?:{name}) licen[cs]e"))
        out.append((2, label, "spdx", f"spdx license identifier (?:{name})"))
    for kind in _CC:
        label = "cc-" + kind.replace(" ", "-")
        words = " ".join(_CC_WORDS[k] for k in kind.split())
        out.append((1, label, "cc", f"cc {kind}"))
        out.append((2, label, "creative", f"creative commons {words}(?: international| unported)?(?: licen[cs]e)?"))
    for kind, version in product(_CC, _CC_VERSIONS):
        label = f"cc-{kind.replace(' ', '-')}-{version.replace(' ', '.')}"
        words = " ".join(_CC_WORDS[k] for k in kind.split())
        out.append((3, label, "cc", f"cc {kind} {version}"))
        out.append((3, label, "creative", f"creative commons {words} {version}(?: international| unported)?(?: licen[cs]e)?"))
    return out
