"""License scans by ordered signature rules.

Hundreds of regexes run on a text's words joined by single blanks: the notices
of licenses in their own words, and a few wordings around each license's name.
A rule is tried only where the text has words that every match of its regex
must hold; these are read off the regex itself, so that the gate saves time
only. Hashes of words tell them without decoding, so most texts meet no regex
at all. Detections are then resolved: one that lies within another of the same
or a higher priority is suppressed, and so is the later in rule order of two
equal ones. Base phrases are found by comparing word hashes and always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.llm import words
from foliant.llm.storage import lean

# Base phrases and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Names of licenses in words; punctuation is a blank.
LICENSES: dict[str, str] = {
    "afl": "academic free license|afl",
    "agpl": "gnu affero general public license|affero general public license|agpl",
    "apache": "apache license|apache software license|apache",
    "apsl": "apple public source license|apsl",
    "artistic": "artistic license|perl artistic license",
    "blueoak": "blue oak model license|blueoak",
    "boost": "boost software license|bsl",
    "bsd": "(?:new |simplified |modified |revised )?bsd (?:2 clause |3 clause |4 clause )?license|bsd [234] clause|0bsd|bsd",
    "busl": "business source license|busl",
    "cc-by": "creative commons attribution|cc by",
    "cc-by-nc": "creative commons attribution non ?commercial|cc by nc",
    "cc-by-nc-nd": "creative commons attribution non ?commercial no ?derivatives|creative commons attribution non ?commercial no ?derivs|cc by nc nd",
    "cc-by-nc-sa": "creative commons attribution non ?commercial share ?alike|cc by nc sa",
    "cc-by-nd": "creative commons attribution no ?derivatives|creative commons attribution no ?derivs|cc by nd",
    "cc-by-sa": "creative commons attribution share ?alike|cc by sa",
    "cc0": "creative commons zero|cc0|cc zero",
    "cddl": "common development and distribution license|cddl",
    "cecill": "cecill(?: b| c)?",
    "cpal": "common public attribution license|cpal",
    "cpl": "common public license|cpl",
    "ecl": "educational community license|ecl",
    "epl": "eclipse public license|epl",
    "eupl": "european union public licen[cs]e|eupl",
    "gfdl": "gnu free documentation license|gfdl",
    "gpl": "gnu general public license|gnu gpl|gpl",
    "isc": "isc license|isc",
    "lgpl": "gnu lesser general public license|gnu library general public license|gnu lgpl|lgpl",
    "mit": "mit license|mit x11 license|expat license|x11 license",
    "mpl": "mozilla public license|mpl",
    "ms-pl": "microsoft public license|ms pl",
    "ms-rl": "microsoft reciprocal license|ms rl",
    "mulan": "mulan permissive software license|mulan psl",
    "ncsa": "university of illinois ncsa open source license|ncsa",
    "odbl": "open database license|odbl",
    "ofl": "sil open font license|open font license|ofl",
    "ogl": "open government licen[cs]e",
    "openssl": "openssl license|openssl",
    "osl": "open software license|osl",
    "php": "php license",
    "postgresql": "postgresql license",
    "psf": "python software foundation license|psf license|python license",
    "qpl": "q public license|qt public license|qpl",
    "sleepycat": "sleepycat license|sleepycat",
    "sspl": "server side public license|sspl",
    "unlicense": "unlicense",
    "upl": "universal permissive license|upl",
    "vim": "vim license",
    "w3c": "w3c software (?:and document )?(?:notice and )?license|w3c license",
    "wtfpl": "do what the fuck you want to public license|wtfpl",
    "zlib": "zlib license|zlib libpng license",
    "zpl": "zope public license|zpl",
}
#: Short names that stand for a license only where the wording speaks of one, as such words mean other things too.
SHORT = {"artistic": "artistic", "mit": "mit|x11|expat", "php": "php", "postgresql": "postgresql", "psf": "psf|python", "vim": "vim", "w3c": "w3c", "zlib": "zlib"}

#: (priority, weight, regex around NAME, whether short names count): higher priorities first.
WORDINGS = [
    (7, 0.99, r"spdx licen[cs]e identifier (?:NAME)(?: \d[\d ]*)?(?: only| or later)?", True),
    (5, 0.95, r"(?:dual )?(?:licen[cs]ed|released|distributed|published|available|provided|covered) under (?:an? |the )?(?:terms (?:and conditions )?of (?:the )?)?(?:NAME)(?: licen[cs]e)?(?: v(?:ersion)? ?\d[\d ]*)?", True),
    (4, 0.9, r"(?:permission is (?:hereby )?granted|redistribut\w+|use of this \w+) (?:[a-z0-9 ]{0,79}? )??(?:NAME)", False),
    (3, 0.85, r"(?:NAME)(?: licen[cs]e)? v(?:ersion)? ?\d[\d ]*(?: only| or(?: \w+){0,3} later(?: version)?)?", False),
    (3, 0.85, r"(?:NAME)(?: licen[cs]e)? \d \d(?: international| unported| generic)?(?: (?:public )?licen[cs]e)?", False),
    (2, 0.7, r"(?:under|see|per|by) (?:the )?(?:NAME)(?: licen[cs]e)", True),
    (2, 0.7, r"(?:www )?opensource org licenses? (?:NAME)", True),
    (1, 0.5, r"(?:NAME) licen[cs]e", False),
]
#: Names of one word that are no license's alone: they speak of one only with more words around them.
AMBIGUOUS = {"afl", "apache", "apsl", "bsd", "bsl", "cpal", "cpl", "ecl", "epl", "isc", "ncsa", "ofl", "openssl", "osl", "qpl", "sleepycat", "upl", "zpl"}
#: Full names, and short ones that are not ambiguous, by themselves.
BARE = (1, 0.5, r"(?:the )?(?:NAME)")
#: Names of one word with a version joined to them, as whole words that a gate can tell.
JOINED = (3, 0.85, r"(?:NAME)(?: \d)*(?: only| or(?: \w+){0,3} later(?: version)?)?")
VERSIONS = ("v1", "v2", "v3", "v4")

#: (label, regex) of what notices say in their own words: priority 6.
NOTICES = [
    ("adobe", r"adobe systems incorporated grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("afl", r"licensed under the academic free license version \d \d"),
    ("agpl", r"(?:under the terms of|received a copy of) the gnu affero general public license"),
    ("agpl", r"remote network interaction use with the gnu general public license"),
    ("apache", r"licensed under the apache license version 2 0 the license you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache", r"you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses"),
    ("apache", r"unless required by applicable law or agreed to in writing (?:software|this software|work) distributed under the license is distributed on an as is basis"),
    ("apache", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", r"this product includes software developed by the apache (?:group|software foundation)"),
    ("apache", r"(?:www )?apache org licenses(?: license 2 0)?"),
    ("artistic", r"under the same terms as (?:the )?perl(?: 5)?(?: programming language system)? itself"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("blueoak", r"blueoakcouncil org license 1 0 0"),
    ("boost", r"free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost", r"(?:see accompanying file license 1 0 txt or copy at )?(?:https? )?(?:www )?boost org license 1 0 txt"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", r"neither the names? of [a-z0-9 ]{1,100}? may be used to endorse or promote products derived from"),
    ("bsd", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", r"this software is provided by (?:the )?[a-z0-9 ]{1,60}? as is and any express or implied warranties"),
    ("bsd", r"use of this source code is governed by a bsd style license"),
    ("busl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("cc-by", r"creativecommons org licenses by \d \d"),
    ("cc-by-nc", r"creativecommons org licenses by nc \d \d"),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd \d \d"),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa \d \d"),
    ("cc-by-nd", r"creativecommons org licenses by nd \d \d"),
    ("cc-by-sa", r"creativecommons org licenses by sa \d \d"),
    ("cc0", r"creativecommons org publicdomain zero 1 0"),
    ("cc0", r"waived all copyright and related or neighbou?ring rights"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cecill", r"governed by the cecill(?: b| c)? license under french law and abiding by the rules of distribution of free software"),
    ("commons-clause", r"commons clause (?:license )?condition"),
    ("cpl", r"the accompanying materials are made available under the terms of the common public license"),
    ("ecl", r"licensed under the educational community license version \d \d"),
    ("elastic", r"(?:licensed|available) under the elastic license"),
    ("epl", r"the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", r"(?:www )?eclipse org (?:legal|org documents) epl"),
    ("eupl", r"you may not use this work except in compliance with the licence"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", r"no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", r"(?:www )?gnu org (?:licenses|copyleft) fdl"),
    ("gpl", r"is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", r"you should have received a copy of the gnu general public license"),
    ("gpl", r"the gnu general public license is a free copyleft license"),
    ("gpl", r"(?:www )?gnu org (?:licenses|copyleft) (?:old licenses )?gpl"),
    ("gpl", r"may be distributed under the terms of the gnu general public license"),
    ("gnu-family", r"in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gnu-family", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("hpnd", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("hpnd", r"the copyright holders? makes? no representations about the suitability of this software"),
    ("isc", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("json", r"the software shall be used for good not evil"),
    ("lgpl", r"(?:under the terms of|received a copy of) the gnu (?:lesser|library) general public license"),
    ("lgpl", r"(?:www )?gnu org (?:licenses|copyleft) (?:old licenses )?lgpl"),
    ("llama", r"llama \d(?: \d)? community license(?: agreement)?"),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", r"except as contained in this notice the names? of the [a-z0-9 ]{1,60}? shall not be used in advertising"),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", r"the contents of this file are subject to the mozilla public license version"),
    ("mpl", r"(?:www )?mozilla org (?:en us )?mpl"),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("mulan", r"you can use this software according to the terms and conditions of the mulan psl"),
    ("ncsa", r"to deal with the software without restriction including without limitation the rights to use"),
    ("odbl", r"opendatacommons org licenses odbl"),
    ("odc-by", r"open data commons attribution license"),
    ("ofl", r"this font software is licensed under the sil open font license"),
    ("ofl", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ofl", r"scripts sil org ofl"),
    ("ogl", r"contains public sector information licensed under the open government licence"),
    ("openrail", r"(?:creativeml|bigscience|bigcode|responsible ai) (?:open ?)?rail(?: m)?"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", r"redistributions of any form whatsoever must retain the following acknowledge?ment"),
    ("pddl", r"open data commons public domain dedication and licen[cs]e"),
    ("php", r"this product includes php software freely available from"),
    ("postgresql", r"for any purpose without fee and without a written agreement is hereby granted"),
    ("proprietary", r"all rights reserved no part of this \w+ may be reproduced"),
    ("proprietary", r"(?:is|are|contains) (?:the )?confidential and proprietary information of"),
    ("proprietary", r"unauthori[sz]ed copying of this (?:file|software|document) via any medium is strictly prohibited"),
    ("psf", r"psf is making python available to licensee on an as is basis"),
    ("public-domain", r"(?:is|are|been) (?:hereby )?(?:placed |released |dedicated )?(?:in|into|to) the public domain"),
    ("public-domain", r"no copyright is claimed (?:and this software is|on this)"),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("sspl", r"functionality of the program or a modified version available to third parties as a service"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("upl", r"hereby granted royalty free to any person obtaining a copy of this software associated documentation and or data"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("w3c", r"permission to copy modify and distribute this (?:software|work) and its documentation with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("wtfpl", r"you just do what the fuck you want to"),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zpl", r"this software is subject to the provisions of the zope public license"),
    ("afl", r"(?:www )?opensource org licenses afl \d"),
    ("agpl", r"(?:www )?gnu org licenses agpl"),
    ("agpl", r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("apache", r"you must give any other recipients of the work or derivative works a copy of this license"),
    ("apache", r"subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive"),
    ("apache", r"see the notice file distributed with this work for additional information regarding copyright ownership"),
    ("apsl", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("artistic", r"you may make and give away verbatim copies of the source form of the standard version of this package"),
    ("artistic", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble"),
    ("bittorrent", r"the contents of this file are subject to the bittorrent open source license"),
    ("blueoak", r"this license gives everyone as much permission to work with this software as possible"),
    ("boost", r"distributed under the boost software license"),
    ("bsd", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd", r"in no event shall the (?:copyright (?:holders?|owners?)|regents|authors?)(?: or contributors)? be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd", r"the name of the (?:author|copyright holder|company) may not be used to endorse or promote products derived from this software"),
    ("bsd", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("busl", r"effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("caldera", r"redistributions of source code and documentation must retain the above copyright notice this list of conditions"),
    ("cc-by", r"you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc0", r"to the extent possible under law [a-z0-9 ]{1,80}? has waived all copyright"),
    ("cc0", r"you can copy modify distribute and perform the work even for commercial purposes all without asking permission"),
    ("cddl", r"you can obtain a copy of the license at (?:https? )?(?:www )?opensource org licenses cddl"),
    ("cddl", r"when distributing covered code include this cddl header in each file"),
    ("cecill", r"(?:www )?cecill info licences"),
    ("commons-clause", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("copyfree", r"copyfree open innovation license"),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse (?:public|distribution) license"),
    ("epl", r"this source code may also be made available under the following secondary licenses"),
    ("eupl", r"licensed under the eupl"),
    ("eupl", r"joinup ec europa eu (?:software page|collection) eupl"),
    ("fair", r"usage of the works is permitted provided that this instrument is retained with the works"),
    ("ftl", r"portions of this software are copyright \w+ the freetype project"),
    ("gfdl", r"a copy of the license is included in the section entitled gnu free documentation license"),
    ("gpl", r"either version \d of the license or at your option any later version"),
    ("gpl", r"as a special exception (?:the copyright holders?|if you link|you may create)"),
    ("gpl", r"this program comes with absolutely no warranty for details type show w"),
    ("gpl", r"when we speak of free software we are referring to freedom not price"),
    ("gpl", r"see the gnu general public license for more details"),
    ("lgpl", r"see the gnu (?:lesser|library) general public license for more details"),
    ("lgpl", r"this license the (?:lesser|library) general public license applies to some specially designated software"),
    ("imagemagick", r"(?:www )?imagemagick org script license php"),
    ("isc", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("libpng", r"this copy of the libpng notices is provided for your convenience"),
    ("libtiff", r"the names of sam leffler and silicon graphics may not be used in any advertising or publicity"),
    ("llama", r"built with (?:meta )?llama"),
    ("lppl", r"latex project public license"),
    ("lppl", r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("mit", r"permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software"),
    ("mit-0", r"(?:mit no attribution|mit 0)"),
    ("mpl", r"software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights"),
    ("mpl", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("ms-pl", r"a contribution is the original software or any additions or changes to the software"),
    ("ms-rsl", r"microsoft (?:reference source|limited public) license"),
    ("naist", r"use reproduction and distribution of this software is permitted any copy of this software whether in its original form or modified must include both the above copyright notice"),
    ("nist", r"this software was developed (?:at the national institute of standards and technology|by employees of the national institute of standards)"),
    ("ofl", r"this license is copied below and is also available with a faq at"),
    ("openldap", r"(?:the openldap public license|redistribution and use of this software and associated documentation with or without modification are permitted)"),
    ("openrail", r"use based restrictions as referenced in paragraph \d"),
    ("openssl", r"this product includes cryptographic software written by eric young"),
    ("php", r"products derived from this software may not be called php"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|internal use|free trial|perimeter) license"),
    ("proprietary", r"this (?:software|document) is the confidential and proprietary information of"),
    ("proprietary", r"you shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement"),
    ("proprietary", r"licensed materials property of"),
    ("psf", r"psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform"),
    ("public-domain", r"(?:released|placed|dedicated|donated|put) (?:in|into|to) the public domain"),
    ("public-domain", r"the author(?: or authors)? of this (?:code|software|work) (?:dedicates?|disclaims?) (?:any and all )?copyright"),
    ("public-domain", r"this (?:work|software|file|code) has been (?:explicitly )?placed (?:in|into) the public domain"),
    ("rpl", r"reciprocal public license"),
    ("ruby", r"(?:this|it) is copyrighted free software by (?:yukihiro )?matz"),
    ("ruby", r"you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl)"),
    ("sgi", r"sgi free software (?:b )?license"),
    ("sissl", r"sun industry standards source license"),
    ("sqlite", r"may you do good and not evil may you find forgiveness for yourself and forgive others may you share freely never taking more than you give"),
    ("sspl", r"(?:www )?mongodb com licensing server side public license"),
    ("tcl", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("unicode", r"unicode (?:inc )?license agreement data files and software"),
    ("unicode", r"(?:www )?unicode org (?:copyright|license)"),
    ("unlicense", r"(?:www )?unlicense org"),
    ("w3c", r"by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    ("x11", r"the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("zlib", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    regex: re.Pattern[bytes]
    gates: tuple[frozenset[str], ...]  # a text must have all words of one of these; word* stands for word and all longer ones


#: Words of a gate: the longest ones of those that matches must hold, as they tell most.
GATE_WORDS = 3


def _opens(tree: list) -> bool:
    """Whether what tree matches begins with a blank, or with the assertion at a rule's end."""
    if not tree:
        return False
    kind, value = tree[0]
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] == 0:
        return _opens(list(value[2])) and _opens(tree[1:])  # taken or not
    if kind is op.SUBPATTERN:
        return _opens(list(value[3]))
    if kind is op.BRANCH:
        return all(_opens(list(x)) for x in value[1])
    return kind is op.ASSERT_NOT or (kind is op.LITERAL and value == 32)


def _closes(tree: list) -> bool:
    """Whether every match of tree ends with a blank."""
    if not tree:
        return False
    kind, value = tree[-1]
    if kind is op.SUBPATTERN:
        return _closes(list(value[3]))
    if kind is op.BRANCH:
        return all(_closes(list(x)) for x in value[1])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] == 0:
        return _closes(list(value[2])) and _closes(tree[:-1])  # taken or not
    return kind is op.LITERAL and value == 32


def _needed(tree: list, begins: bool, rest: list) -> list[frozenset[str]]:
    """Sets of words of which every match of tree holds all of one. begins: a word begins at its start; rest: what follows it."""
    sets = [frozenset()]
    word, whole = "", begins
    for i, (kind, value) in enumerate([*tree, (None, None)]):
        after = tree[i:] + rest
        if kind is op.LITERAL and value != 32:
            word += chr(value)
            continue
        if word and whole:
            own = word if _opens(after) else word + "*"
            sets = [x | {own} for x in sets]
        starts, word = not word and whole, ""
        inner = None
        if kind is op.SUBPATTERN:
            inner = [list(value[3])]
        elif kind is op.BRANCH:
            inner = [list(x) for x in value[1]]
        if inner is not None:
            each = [_needed(x, starts, after[1:]) for x in inner]
            sets = [x | y for x in sets for e in each for y in e]
            whole = all(map(_closes, inner))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] == 0:
            whole = starts and _closes(list(value[2]))  # either way a word begins behind it
        else:
            whole = (kind is op.LITERAL) or (kind is op.ASSERT_NOT and value[0] < 0)
    return sets


def gates_of(pattern: str) -> tuple[frozenset[str], ...]:
    """Sets of words, all of one of which every match of the regex holds; read off its literal words.

    Whole words are enough where there are any, as beginnings cost a pass over
    the text for each length.
    """
    out = set()
    for found in _needed(list(_parser.parse(pattern)), False, []):
        exact = [w for w in found if not w.endswith("*")]
        out.add(frozenset(sorted(exact or found, key=lambda w: (-len(w), w))[:GATE_WORDS]))
    return tuple(sorted(out, key=sorted))


def _alternatives(names: str) -> list[str]:
    """The alternatives of a regex, outside its groups."""
    out, depth = [""], 0
    for c in names:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """The rules in order: by priority, then as they are written."""
    made = [(6, 0.97, label, pattern, [""]) for label, pattern in NOTICES]
    for priority, weight, wording, short in WORDINGS:
        for label, names in LICENSES.items():
            made.append((priority, weight, label, wording, _alternatives(f"{names}|{SHORT[label]}" if short and label in SHORT else names)))
    for label, names in LICENSES.items():
        priority, weight, wording = BARE
        made.append((priority, weight, label, wording, [x for x in _alternatives(names) if x not in AMBIGUOUS]))
        short = [x for x in _alternatives(names) + SHORT.get(label, "").split("|") if x.isalnum()]
        if short:
            priority, weight, wording = JOINED
            made.append((priority, weight, label, wording, [x + v for x in short for v in VERSIONS]))
    out = []
    for priority, weight, label, wording, names in sorted(made, key=lambda x: -x[0]):
        bounded = lambda x: rf"(?<![^ ]){x}(?![^ ])"
        gates = dict.fromkeys(g for name in names for g in gates_of(bounded(wording.replace("NAME", name))))
        out.append(Rule(label, priority, weight, re.compile(bounded(wording.replace("NAME", "|".join(names))).encode()), tuple(gates)))
    return tuple(out)


def hashes_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words.split(raw, np.array([0, len(raw)]), words.ALNUM).hashes()


@dataclass(frozen=True)
class Detection:
    label: str
    start: int  # words from 0
    end: int
    priority: int
    weight: float


def resolve(found: list[Detection]) -> list[Detection]:
    """Detections that no other of at least their priority contains; of equal ones the first stays."""
    kept: list[Detection] = []
    for priority in sorted({d.priority for d in found}, reverse=True):
        starts = [k.start for k in kept]
        reach = list(accumulate((k.end for k in kept), max))  # how far those that start so early go
        end = 0
        for d in sorted((d for d in found if d.priority == priority), key=lambda d: (d.start, -d.end)):
            i = bisect_right(starts, d.start)
            if d.end > max(end, reach[i - 1] if i else 0):
                kept.append(d)
                end = d.end
        kept.sort(key=lambda d: (d.start, d.end, d.label))
    return kept


class Scanner:
    def __init__(self) -> None:
        self.base = [(hashes_of(phrase), label) for phrase, label in BASE]
        gates = sorted({w for rule in rules() for gate in rule.gates for w in gate})
        # gates by their most telling word, with the rules that they open
        self.opened: dict[str, list[tuple[frozenset[str], int]]] = {}
        for i, rule in enumerate(rules()):
            for gate in rule.gates:
                self.opened.setdefault(max(gate, key=lambda w: (len(w), w)), []).append((gate, i))
        self.gates = [self._table([w.rstrip("*") for w in gates], gates, None)]
        for n in sorted({len(w) - 1 for w in gates if w.endswith("*")}):
            self.gates.append(self._table(*zip(*((w[:-1] + "_", w) for w in gates if w.endswith("*") and len(w) == n + 1), strict=True), n))

    @staticmethod
    def _table(samples: Iterable[str], gates: Iterable[str], most: int | None) -> tuple[int | None, np.ndarray, list[list[str]]]:
        """most, sorted hashes of words that meet gates (if most is given, of longer words' beginnings), and the gates of each: a word by itself may meet its own gate and that of its beginning."""
        every, met = np.ones(256, bool), {}
        for sample, gate in zip(samples, gates, strict=True):
            met.setdefault(sample, []).append(gate)
        split = [np.frombuffer(w.encode(), np.uint8) for w in met]
        h = np.array([words.split(raw, np.array([0, len(raw)]), every).hashes(most)[0] for raw in split])
        order = np.argsort(h)
        return most, h[order], [list(met.values())[i] for i in order]

    def _gated(self, w: words.Words) -> list[set[str]]:
        """The gates that each text meets."""
        have: list[set[str]] = [set() for _ in range(len(w.first) - 1)]
        for most, table, gates in self.gates:
            h = w.hashes(most)
            place = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = np.flatnonzero(table[place] == h)
            owner = np.searchsorted(w.first, hit, side="right") - 1
            for pair in np.unique(owner * len(table) + place[hit]):
                have[pair // len(table)].update(gates[pair % len(table)])
        return have

    def scan(self, raw: np.ndarray, offsets: np.ndarray, gated: bool = True) -> list[tuple]:
        """(words, base places as (start, label), kept detections) of each text; the gates save time only."""
        w = words.split(raw, offsets, words.ALNUM)
        h, first = w.hashes(), w.first
        n = len(h)
        base: list[list[tuple[int, str]]] = [[] for _ in range(len(first) - 1)]
        for phrase, label in self.base:
            m = len(phrase)
            if n >= m:
                hit = h[: n - m + 1] == phrase[0]
                for j in range(1, m):
                    hit &= h[j : n - m + 1 + j] == phrase[j]
                for at in np.flatnonzero(hit):
                    doc = int(np.searchsorted(first, at, side="right")) - 1
                    if at + m <= first[doc + 1]:
                        base[doc].append((int(at - first[doc]), label))
        gates = self._gated(w)
        out = []
        for doc in range(len(first) - 1):
            wanted = rules() if not gated else [rules()[i] for i in sorted({i for word in gates[doc] for gate, i in self.opened.get(word, ()) if gate <= gates[doc]})]
            found = []
            if wanted:
                spans = range(first[doc], first[doc + 1])
                data = w.text.tobytes() if len(first) == 2 else w.text[offsets[doc] : offsets[doc + 1]].tobytes()
                shift = offsets[doc]
                joined = b" ".join(data[w.start[i] - shift : w.end[i] - shift] for i in spans)
                size = (w.end - w.start)[first[doc] : first[doc + 1]]
                begins = np.cumsum(size + 1) - size - 1  # of each word in joined
                for r in wanted:
                    for m in r.regex.finditer(joined):
                        start = int(np.searchsorted(begins, m.start()))
                        found.append(Detection(r.label, start, start + m[0].strip().count(b" ") + 1, r.priority, r.weight))
            out.append((int(first[doc + 1] - first[doc]), sorted(base[doc]), resolve(found)))
        return out


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


_SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("priority", T.IntegerType()), T.StructField("weight", T.DoubleType())])
ADDED = [T.StructField("n_words", T.LongType()), T.StructField("base", T.ArrayType(_SPAN)), T.StructField("detections", T.ArrayType(_SPAN)), T.StructField("score", T.DoubleType())]


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with n_words long, base and detections (spans of words [start, end) with label, priority and weight) and score.

    Whole texts are scanned; null counts as empty. base has every place of a
    base phrase, detections what the rules find after suppression. score is
    1 minus the product of 1 - weight over both, base places weighing 0.9; 0 if
    there is none. Rows stay in their partitions.
    """
    added = {f.name for f in ADDED}
    kept = [f for f in df.schema if f.name not in added and f.name != text]
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = {label: len(phrase.split()) for phrase, label in BASE}
        for batch in batches:
            for lo, hi, raw, offsets in words.slices(batch.column(0)):
                n, base, found, score = [], [], [], []
                for count, places, kept_ones in scanner().scan(raw, offsets):
                    n.append(count)
                    base.append([{"label": label, "start": at, "end": at + size[label], "priority": 0, "weight": 0.9} for at, label in places])
                    found.append([vars(d) for d in kept_ones])
                    left = 0.1 ** len(places)
                    for d in kept_ones:
                        left *= 1 - d.weight
                    score.append(1 - left)
                made = [pa.array(n, pa.int64()), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(span)), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[1:], *made], names=[*(f.name for f in kept), *(f.name for f in ADDED)])

    return df.select(text, *(f"`{f.name}`" for f in kept)).mapInArrow(lean(run), T.StructType([*kept, *ADDED]))
