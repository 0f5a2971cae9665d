"""License scans by ordered signature rules (operator 6), in DataFrame expressions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.llm.common import lower_ascii, table, words
from tracewright.llm.spans import let, matches, running_max

#: Phrases that count wherever their words stand one after the other, and their labels. Fixed by the contract.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: A blank in the regexes of LICENSES and NOTICES and in GATE stands for white space of any kind and length.
#: Licenses: label, SPDX names, ways to write the name, and a keyword that every text with such a name has.
LICENSES = [
    ("agpl", "agpl-[13]\\.0", "(?:gnu )?affero general public licen[sc]e|agplv?3?", "agpl|affero"),
    ("apache-1", "apache-1\\.[01]", "apache (?:software )?licen[sc]e,? (?:version |v)?1\\.[01]", "apache"),
    ("apache-2", "apache-2\\.0", "apache (?:software )?licen[sc]e,? (?:version |v\\.? ?)?2(?:\\.0)?", "apache"),
    ("artistic", "artistic-[12]\\.0", "artistic licen[sc]e", "artistic"),
    ("bsd", "bsd-[0-4]-clause", "(?:new |modified |simplified |revised )?bsd(?: [0-4]-clause)?(?: style)? licen[sc]e", "bsd"),
    ("bsl", "bsl-1\\.0", "boost software licen[sc]e", "bsl|boost"),
    ("cc0", "cc0-1\\.0", "cc0|creative commons zero", "c"),
    ("cc-by", "cc-by-[1-4]\\.[05]", "creative commons attribution(?! ?-?(?:non|share|no))", "c"),
    ("cc-by-nc", "cc-by-nc-[1-4]\\.[05]", "cc by-nc(?!-)|creative commons attribution-noncommercial(?!-)", "c"),
    ("cc-by-nc-nd", "cc-by-nc-nd-[1-4]\\.[05]", "cc by-nc-nd|attribution-noncommercial-noderiv\\w*", "n"),
    ("cc-by-nc-sa", "cc-by-nc-sa-[1-4]\\.[05]", "cc by-nc-sa|attribution-noncommercial-sharealike", "n"),
    ("cc-by-nd", "cc-by-nd-[1-4]\\.[05]", "cc by-nd|creative commons attribution-noderiv\\w*", "n"),
    ("cc-by-sa", "cc-by-sa-[1-4]\\.[05]", "cc by-sa|creative commons attribution-share ?alike", "s"),
    ("cddl", "cddl-1\\.[01]", "common development and distribution licen[sc]e", "cddl|common"),
    ("cecill", "cecill-[12]\\.[01]", "cecill(?:-[bc])? licen[sc]e", "cecill"),
    ("cpal", "cpal-1\\.0", "common public attribution licen[sc]e", "cpal|common"),
    ("cpl", "cpl-1\\.0", "common public licen[sc]e", "cpl|common"),
    ("ecl", "ecl-2\\.0", "educational community licen[sc]e", "ecl|educational"),
    ("epl", "epl-[12]\\.0", "eclipse public licen[sc]e", "epl|eclipse"),
    ("eupl", "eupl-1\\.[0-2]", "european union public licen[sc]e", "eupl|european"),
    ("fdl", "gfdl-1\\.[1-3]", "(?:gnu )?free documentation licen[sc]e", "gfdl|documentation"),
    ("ftl", "ftl", "freetype (?:project )?licen[sc]e", "ftl|freetype"),
    ("gpl", "gpl-[123]\\.0", "gnu gpl|(?:gnu )?(?<!lesser\\s)(?<!library\\s)(?<!affero\\s)general public licen[sc]e", "gpl|general"),
    ("gpl-2", "gpl-2\\.0-(?:only|or-later)", "gplv2|general public licen[sc]e,? (?:version |v\\.? ?)2(?:\\.0)?", "gpl|general"),
    ("gpl-3", "gpl-3\\.0-(?:only|or-later)", "gplv3|general public licen[sc]e,? (?:version |v\\.? ?)3(?:\\.0)?", "gpl|general"),
    ("icu", "icu", "icu licen[sc]e", "icu"),
    ("ipl", "ipl-1\\.0", "ibm public licen[sc]e", "ipl|ibm"),
    ("isc", "isc", "isc licen[sc]e|internet systems consortium", "isc|internet"),
    ("lgpl", "lgpl-[23]\\.[01](?:-only|-or-later)?", "(?:gnu )?(?:lesser|library) general public licen[sc]e|lgplv?[23]?(?:\\.1)?", "l"),
    ("lppl", "lppl-1\\.[0-3]c?", "latex project public licen[sc]e", "lppl|latex"),
    ("mit", "mit", "mit(?:/x11)? licen[sc]e|expat licen[sc]e", "mit|expat"),
    ("mit-0", "mit-0", "mit no attribution", "mit"),
    ("mpl-1", "mpl-1\\.[01]", "mozilla public licen[sc]e,? (?:version |v\\.? ?)1\\.[01]", "mpl|mozilla"),
    ("mpl-2", "mpl-2\\.0", "mozilla public licen[sc]e(?:,? (?:version |v\\.? ?)2\\.0)?", "mpl|mozilla"),
    ("ms-pl", "ms-pl", "microsoft public licen[sc]e", "ms-pl|microsoft"),
    ("ms-rl", "ms-rl", "microsoft reciprocal licen[sc]e", "ms-rl|microsoft"),
    ("ncsa", "ncsa", "university of illinois/ncsa open source licen[sc]e", "ncsa"),
    ("odbl", "odbl-1\\.0", "open (?:data commons open )?database licen[sc]e", "odbl|database"),
    ("ofl", "ofl-1\\.[01]", "sil open font licen[sc]e", "ofl|font"),
    ("openssl", "openssl", "openssl licen[sc]e", "openssl"),
    ("osl", "osl-[123]\\.0", "open software licen[sc]e", "osl|open"),
    ("php", "php-3\\.01?", "php licen[sc]e", "php"),
    ("postgresql", "postgresql", "postgresql licen[sc]e", "postgresql"),
    ("psf", "psf-2\\.0|python-2\\.0", "python (?:software foundation )?licen[sc]e", "psf|python"),
    ("public-domain", "licenseref-public-domain", "(?:in|into|to) the public domain|public domain dedication", "public"),
    ("qpl", "qpl-1\\.0", "q public licen[sc]e", "q"),
    ("ruby", "ruby", "ruby licen[sc]e", "ruby"),
    ("sspl", "sspl-1\\.0", "server side public licen[sc]e", "sspl|server"),
    ("unlicense", "unlicense", "the unlicense|unlicense\\.org", "unlicense"),
    ("upl", "upl-1\\.0", "universal permissive licen[sc]e", "upl|universal"),
    ("vim", "vim", "vim licen[sc]e", "vim"),
    ("w3c", "w3c", "w3c software (?:notice and )?licen[sc]e", "w3c"),
    ("wtfpl", "wtfpl", "do what the f\\S+ you want to public licen[sc]e", "wtfpl|what"),
    ("x11", "x11", "x11 licen[sc]e", "x11"),
    ("zlib", "zlib", "zlib(?:/libpng)? licen[sc]e", "zlib"),
    ("zpl", "zpl-[12]\\.[01]", "zope public licen[sc]e", "zpl|zope"),
]
#: How a name is used: what comes before it, what after it, and how much that says. Higher comes first.
USES = [
    ("spdx-license-identifier:\\s*", "(?![\\w.-])", 100, True),
    ("(?:licen[sc]ed|released|distributed|available|published|provided)\\s+under\\s+(?:the\\s+)?(?:terms\\s+of\\s+)?(?:the\\s+)?", "", 90, False),
    ("(?:subject|according)\\s+to\\s+(?:the\\s+)?(?:terms\\s+of\\s+)?(?:the\\s+)?", "", 80, False),
    ("licen[sc]e\\s*[:=]\\s*[\"']?(?:the\\s+)?", "", 70, False),
    ("\\b", "\\b", 50, False),
]
#: Signatures of texts and notices that name no license: label, regex, keyword, priority.
NOTICES = [
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy", "hereby", 95),
    ("bsd", "redistribution and use in source and binary forms, with or without modification", "redistribution", 95),
    ("isc", "permission to use, copy, modify, and/?or distribute this software for any purpose", "distribute", 95),
    ("zlib", "this software is provided 'as-is', without any express or implied warranty", "as-is", 95),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 95),
    ("apache-2", "apache\\.org/licenses/license-2\\.0", "apache.org", 95),
    ("gpl", "gnu\\.org/(?:copyleft|licenses)/gpl", "gnu.org", 90),
    ("lgpl", "gnu\\.org/(?:copyleft|licenses)/(?:old-licenses/)?lgpl", "gnu.org", 91),
    ("mpl-2", "mozilla\\.org/mpl/2\\.0", "mozilla.org", 95),
    ("cc0", "creativecommons\\.org/publicdomain/zero", "creativecommons", 95),
    ("cc-by", "creativecommons\\.org/licenses/by/", "creativecommons", 95),
    ("cc-by-sa", "creativecommons\\.org/licenses/by-sa/", "creativecommons", 95),
    ("cc-by-nc", "creativecommons\\.org/licenses/by-nc/", "creativecommons", 95),
    ("cc-by-nd", "creativecommons\\.org/licenses/by-nd/", "creativecommons", 95),
    ("reserved", "all\\s+rights\\s+reserved", "reserved", 60),
    ("copyright", "(?:copyright|\\(c\\)|©)\\s+(?:\\(c\\)\\s+)?(?:19|20)\\d\\d", "copyright|(c)|©", 40),
    ("proprietary", "proprietary and confidential|unauthorized (?:copying|use|reproduction) (?:[^.\\s]|\\s++){0,60}prohibited", "pro", 60),
    ("apache-2", "licen[sc]ed under the apache licen[sc]e, version 2\\.0 \\(the \"licen[sc]e\"\\)", "apache", 96),
    ("apache-2", "you may not use this file except in compliance with the licen[sc]e", "compliance", 95),
    ("apache-2", "limitations under the licen[sc]e", "limitations", 60),
    ("apache-2", "licen[sc]ed to the apache software foundation \\(asf\\) under one or more contributor licen[sc]e agreements", "contributor", 95),
    ("apache-1", "the names \"apache\" and \"apache software foundation\" must not be used to endorse or promote products derived from this software", "endorse", 95),
    ("apache-1", "redistributions? of source code must retain the above copyright notice[^.]{0,80}apache group", "apache", 95),
    ("mit", "to deal in the software without restriction, including without limitation the rights", "without", 95),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial", 95),
    ("mit", "opensource\\.org/licen[sc]es/mit", "opensource.org", 90),
    ("x11", "except as contained in this notice, the names? of the (?:x consortium|above copyright holders)", "contained", 95),
    ("x11", "copyright \\(c\\) (?:19|20)\\d\\d x consortium", "consortium", 95),
    ("hpnd", "permission to use, copy, modify,? and distribute this software and its documentation for any purpose", "documentation", 95),
    ("hpnd", "not be used in advertising or publicity pertaining to distribution of the software without", "advertising", 95),
    ("isc", "this software (?:for any purpose )?with or without fee is hereby granted, provided that the above copyright notice", "fee", 95),
    ("isc", "opensource\\.org/licen[sc]es/isc", "opensource.org", 90),
    ("0bsd", "with or without fee is hereby granted\\.", "fee", 94),
    ("bsd", "redistributions? of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "retain", 95),
    ("bsd", "redistributions? in binary form must reproduce the above copyright notice", "reproduce", 95),
    ("bsd", "opensource\\.org/licen[sc]es/bsd", "opensource.org", 90),
    ("bsd", "use of this source code is governed by a bsd-style licen[sc]e", "governed", 95),
    ("bsd", "copyright[^.]{0,80} the regents of the university of california", "regents", 95),
    ("bsd-3", "neither the names? of [^.]{1,120} nor the names of (?:its|their) contributors may be used to endorse or promote", "neither", 95),
    ("bsd-3", "opensource\\.org/licen[sc]es/bsd-3-clause", "opensource.org", 91),
    ("bsd-2", "opensource\\.org/licen[sc]es/bsd-2-clause", "opensource.org", 91),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising", 95),
    ("gpl", "this program is free software[:;,] you can redistribute it and/?or modify", "redistribute", 95),
    ("gpl", "either version [23] of the licen[sc]e,? or \\(at your option\\) any later version", "option", 95),
    ("gpl", "you should have received a copy of the gnu general public licen[sc]e", "received", 95),
    ("gpl", "free software foundation, inc\\., (?:59 temple place|51 franklin st(?:reet)?)", "foundation", 90),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document", "verbatim", 95),
    ("gpl", "the licen[sc]es for most software(?: and other practical works)? are designed to take away your freedom", "freedom", 95),
    ("gpl", "gpl-compatible", "compatible", 60),
    ("gpl-2", "under the terms of version 2 of the gnu general public licen[sc]e", "version", 96),
    ("gpl-2", "gnu\\.org/licen[sc]es/(?:old-licen[sc]es/)?gpl-2\\.0", "gnu.org", 92),
    ("gpl-3", "under the terms of version 3 of the gnu general public licen[sc]e", "version", 96),
    ("gpl-3", "gnu\\.org/licen[sc]es/gpl-3\\.0", "gnu.org", 92),
    ("gpl-3", "the gnu general public licen[sc]e is a free,? copyleft licen[sc]e for software and other kinds of works", "copyleft", 95),
    ("gpl-classpath", "linking this library statically or dynamically with other modules is making a combined work", "linking", 95),
    ("gpl-classpath", "gpl-2\\.0[a-z-]{0,12} with classpath-exception-2\\.0", "classpath", 100),
    ("lgpl", "this library is free software[:;,] you can redistribute it and/?or modify", "redistribute", 95),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", "received", 95),
    ("lgpl", "a program that contains no derivative of any portion of the library", "derivative", 95),
    ("agpl", "you should have received a copy of the gnu affero general public licen[sc]e", "affero", 95),
    ("agpl", "gnu\\.org/licen[sc]es/agpl", "agpl", 91),
    ("agpl", "licen[sc]e[^.]{0,80} designed specifically to ensure cooperation with the community in the case of network server software", "cooperation", 95),
    ("fdl", "permission is granted to copy, distribute and/?or modify this document under the terms of the gnu free documentation licen[sc]e", "document", 95),
    ("fdl", "gnu\\.org/(?:copyleft|licen[sc]es)/fdl", "fdl", 91),
    ("fdl", "with no invariant sections, no front-cover texts,? and no back-cover texts", "invariant", 95),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public licen[sc]e, v\\. 2\\.0", "mozilla", 96),
    ("mpl-2", "\"incompatible with secondary licen[sc]es\"", "secondary", 95),
    ("mpl-1", "the contents of this file are subject to the mozilla public licen[sc]e version 1\\.[01]", "mozilla", 96),
    ("mpl-1", "mozilla\\.org/mpl/mpl-1\\.[01]", "mozilla.org", 91),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", "eclipse", 96),
    ("epl", "eclipse\\.org/legal/epl", "epl", 90),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e", "common", 96),
    ("cddl", "opensource\\.org/licen[sc]es/cddl", "cddl", 90),
    ("artistic", "opensource\\.org/licen[sc]es/artistic", "artistic", 90),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", "intent", 95),
    ("artistic", "the same terms as perl itself", "perl", 70),
    ("bsl", "boost\\.org/licen[sc]e_1_0", "boost", 90),
    ("bsl", "use, reproduce, display, distribute, execute, and transmit the software", "transmit", 95),
    ("zlib", "altered source versions must be plainly marked as such", "altered", 95),
    ("zlib", "copyright[^.]{0,60} jean-loup gailly and mark adler", "gailly", 95),
    ("libpng", "png reference library licen[sc]e|libpng licen[sc]e version 2", "png", 95),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "jpeg", 95),
    ("curl", "copyright \\(c\\) 1996 - (?:19|20)\\d\\d, daniel stenberg", "stenberg", 95),
    ("bzip2", "copyright \\(c\\) 1996-(?:19|20)\\d\\d julian r? ?seward", "julian", 95),
    ("openssl", "this product includes software developed by the openssl project", "openssl", 95),
    ("ssleay", "this product includes cryptographic software written by eric young", "cryptographic", 95),
    ("php", "this source file is subject to version 3\\.01? of the php licen[sc]e", "php", 96),
    ("php", "php\\.net/licen[sc]e", "php.net", 90),
    ("psf", "python software foundation[^.]{0,40} all rights reserved", "python", 95),
    ("psf", "psf hereby grants licen[sc]ee a nonexclusive, royalty-free, world-?wide licen[sc]e", "psf", 95),
    ("ncsa", "redistributions? of source code must retain[^.]{0,160}university of illinois", "illinois", 95),
    ("w3c", "w3\\.org/consortium/legal/[^ ]{0,40}copyright-software", "w3.org", 90),
    ("w3c", "copyright © (?:[-0-9]+ )?world wide web consortium", "consortium", 95),
    ("ofl", "scripts\\.sil\\.org/ofl", "sil", 90),
    ("ofl", "this font software is licen[sc]ed under the sil open font licen[sc]e", "font", 96),
    ("ofl", "copyright[^.]{0,120} with reserved font name", "font", 95),
    ("unlicense", "unlicense\\.org", "unlicense.org", 90),
    ("unlicense", "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "compile", 95),
    ("wtfpl", "wtfpl\\.net", "wtfpl.net", 90),
    ("beerware", "the beer-?ware licen[sc]e", "beer", 95),
    ("beerware", "you can do whatever you want with this stuff", "stuff", 95),
    ("json", "the software shall be used for good, not evil", "evil", 95),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", "deed", 95),
    ("cc0", "no rights reserved", "reserved", 70),
    ("cc-by", "some rights reserved", "reserved", 60),
    ("cc-by-nc-nd", "creativecommons\\.org/licenses/by-nc-nd/", "creativecommons", 95),
    ("cc-by-nc-sa", "creativecommons\\.org/licenses/by-nc-sa/", "creativecommons", 95),
    ("cc-by-sa", "text is available under the creative commons attribution-share ?alike licen[sc]e", "available", 96),
    ("pddl", "open data commons public domain dedication and licen[sc]e", "commons", 95),
    ("odbl", "opendatacommons\\.org/licen[sc]es/odbl", "odbl", 90),
    ("odc-by", "open data commons attribution licen[sc]e|opendatacommons\\.org/licen[sc]es/by", "commons", 95),
    ("ogl", "open government licen[sc]e", "government", 90),
    ("ogl", "contains public sector information licen[sc]ed under", "sector", 95),
    ("cdla-permissive", "community data licen[sc]e agreement,? -? ?permissive", "community", 95),
    ("cdla-sharing", "community data licen[sc]e agreement,? -? ?sharing", "community", 95),
    ("public-domain", "this (?:work|file|code|software) is in the public domain", "domain", 90),
    ("public-domain", "no copyright is claimed", "claimed", 80),
    ("public-domain", "(?:placed|released|dedicated) (?:in|into|to) the public domain", "domain", 80),
    ("public-domain", "copyright (?:has )?expired", "expired", 70),
    ("us-government", "not subject to copyright protection in the united states", "united", 90),
    ("us-government", "this is a work of the u\\.?s\\.? government", "government", 90),
    ("commons-clause", "\"commons clause\" licen[sc]e condition", "clause", 96),
    ("busl", "business source licen[sc]e", "business", 95),
    ("busl", "change date:?[^.]{0,60} change licen[sc]e", "change", 90),
    ("elastic", "elastic licen[sc]e(?: 2\\.0)?", "elastic", 90),
    ("sspl", "mongodb\\.com/licen[sc]ing/server-side-public-licen[sc]e", "mongodb", 91),
    ("polyform", "polyform (?:noncommercial|small business|shield|perimeter|strict) licen[sc]e", "polyform", 95),
    ("openrail", "(?:creativeml |bigscience )?open ?rail(?:\\+\\+)?-?m? licen[sc]e|responsible ai licen[sc]e", "rail|responsible", 90),
    ("mulan", "mulan (?:permissive software|psl) licen[sc]e", "mulan", 90),
    ("bluesky", "blue oak model licen[sc]e", "oak", 95),
    ("ms-pl", "opensource\\.org/licen[sc]es/ms-pl", "ms-pl", 90),
    ("intel", "intel simplified software licen[sc]e", "intel", 95),
    ("nvidia", "nvidia (?:software|source code) licen[sc]e", "nvidia", 90),
    ("sun", "sun microsystems, inc\\. all rights reserved", "sun", 80),
    ("oracle", "oracle (?:binary code|technology network) licen[sc]e", "oracle", 90),
    ("eula", "end[- ]user licen[sc]e agreement", "user", 80),
    ("eula", "by (?:installing|downloading|using|clicking)[^.]{1,120} you (?:agree|accept)[^.]{1,80} licen[sc]e agreement", "agree|accept", 80),
    ("shareware", "shareware licen[sc]e", "shareware", 70),
    ("noncommercial", "for non-?commercial use only", "commercial", 80),
    ("noncommercial", "free for (?:personal|academic|educational|research) use", "free", 70),
    ("proprietary", "no part of this (?:publication|book|document|work) may be reproduced", "reproduced", 80),
    ("proprietary", "may not be (?:published|broadcast|rewritten|redistributed)", "may", 70),
    ("proprietary", "licen[sc]e is non-?transferable", "transferable", 60),
    ("proprietary", "this material may not be reproduced", "material", 60),
    ("reserved", "tous droits r[ée]serv[ée]s?", "droits", 60),
    ("reserved", "alle rechte vorbehalten", "rechte", 60),
    ("reserved", "todos los derechos reservados", "derechos", 60),
    ("warranty", "without warrant(?:y|ies) of any kind, express or implied", "warrant", 60),
]
#: No rule matches a lower-case text that this does not find in.
GATE = (
    "licen[sc]|reserved|copyright|\\(c\\)|©|creative ?commons|cc by|cc0|public domain|proprietary|prohibited|hereby granted"
    "|redistribut|spdx|gpl|and/?or distribute|'as-is'|unencumbered|apache\\.org|gnu\\.org|mozilla\\.org|internet systems"
    "|mit no attribution|attribution-non|copyleft|wtfpl\\.net"
    "|advertising or publicity|endorse or promote|following acknowledg|software foundation|combined work|derivative of any|invariant sections|eclipse\\.org"
    "|intent of this document|perl itself|transmit the software|altered source|jpeg group|openssl project|cryptographic software|sil\\.org|anyone is free"
    "|not evil|with this stuff|work of the u|commercial use only|free for (?:personal|academic|educational|research)|be reproduced|may not be|droits r|rechte vorbehalten"
    "|derechos reservados|its documentation|without warrant|deal in the software|contained in this notice"
)


def spaced(regex: str) -> str:
    """regex with white space of any kind and length in place of each blank; none, too, in place of an optional one."""
    return regex.replace(" ?", r"\s*").replace(" ", r"\s+")


def rules() -> list[tuple[str, str, str, int]]:
    """Every signature: label, regex over lower-case text, keywords of which one must be there, priority."""
    out = []
    for label, spdx, names, keyword in LICENSES:
        for before, after, priority, by_id in USES:
            out.append((label, f"{before}(?:{spdx if by_id else spaced(names)}){after}", keyword, priority))
    return out + [(label, spaced(regex), keyword, priority) for label, regex, keyword, priority in NOTICES]


def _found(text: Column, rule: Column) -> Column:
    """A rule's detections in a text, as structs: first, last (characters, exclusive), label, priority."""
    return F.transform(
        matches(text, rule["regex"]), lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), rule["label"].alias("label"), rule["priority"].alias("priority"))
    )


def _has_keyword(text: Column, rule: Column) -> Column:
    return F.exists(rule["keywords"], lambda k: F.contains(text, k))


def outermost(raw: Column) -> Column:
    """The detections (structs of first, last, label, priority) that are inside no other one of a higher priority, or of
    the same and longer; by first, then the longest first, then priority.

    In this order what a detection may be inside comes before it. So one running maximum a level of priority tells how
    far the earlier ones reach that are of this level or above; those of the same span and priority are passed over.
    """
    ordered = F.array_sort(F.transform(raw, lambda x: F.struct(x["first"].alias("first"), (-x["last"]).alias("to"), (-x["priority"]).alias("rank"), x["label"].alias("label"))))

    def kept(rows: Column) -> Column:
        def differs(x: Column, i: Column) -> Column:
            y = F.get(rows, i - 1)
            return F.when((i > 0) & (x["first"] == y["first"]) & (x["to"] == y["to"]) & (x["rank"] == y["rank"]), F.lit(0)).otherwise(i)

        levels = F.array_distinct(F.transform(rows, lambda x: x["rank"]))
        reach = F.transform(levels, lambda p: F.struct(p.alias("rank"), running_max(F.transform(rows, lambda x: F.when(x["rank"] <= p, -x["to"]).otherwise(F.lit(-1)))).alias("far")))
        known = F.struct(F.map_from_entries(reach).alias("reach"), running_max(F.transform(rows, differs)).alias("start"))

        def with_known(k: Column) -> Column:
            def free(x: Column, i: Column) -> Column:
                return F.coalesce(F.get(k["reach"][x["rank"]], F.get(k["start"], i) - 1) < -x["to"], F.lit(True))

            return F.filter(rows, free)

        return let(known, with_known)

    return F.transform(let(ordered, kept), lambda x: F.struct(x["first"].alias("first"), (-x["to"]).alias("last"), x["label"].alias("label"), (-x["rank"]).alias("priority")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns and the detections of docs (doc_id, text).

    Base: n_words; n_base, first_word, last_word and base_labels from the places where a phrase's words stand one
    after the other. detections: what the signature rules find, as spans of characters. A text goes to the rules
    if one combined search finds any of their gates, and to a rule if it has one of that rule's keywords. A
    detection inside another one's span goes if the other has a higher priority, or the same and is longer.
    labels: those of both, distinct, sorted, joined by commas; score: 0 without a label, else the highest
    priority as a share of 100 (a base phrase has 60).

    Null and empty texts have no words and no labels; repeated rows give repeated results; no rows give none.
    """
    entries = json.dumps([{"label": a, "regex": b, "keywords": c.split("|"), "priority": p} for a, b, c, p in rules()])
    entries = F.from_json(F.lit(entries), "array<struct<label:string,regex:string,keywords:array<string>,priority:int>>")
    lower = lower_ascii(F.col("text"))
    step = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower.alias("lower"), words(F.col("text")).alias("w"))
    may = F.array_contains("w", "cc") | F.array_contains("w", "license") | F.array_contains("w", "reserved")

    def at(i: Column, phrase: str) -> Column:
        own = None
        for k, word in enumerate(phrase.split()):
            same = F.get(F.col("w"), i + k) == word
            own = same if own is None else own & same
        return F.coalesce(own, F.lit(False))

    def places(phrase: str) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: at(i, phrase))

    none = F.array().cast("array<int>")
    for k, (phrase, _) in enumerate(PHRASES):
        step = step.withColumn(f"p{k}", F.when((F.size("w") > 0) & may, places(phrase)).otherwise(none))
    all_places = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    labels = [F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]
    base = step.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.size(all_places).cast("long").alias("n_base"), F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"), F.array_sort(F.array_compact(F.array_distinct(F.array(*labels)))).alias("base_labels"),
        F.when(F.col("lower").rlike(spaced(GATE)), F.col("lower")).alias("lower"),
    )
    chosen = F.filter(entries, lambda r: _has_keyword(F.col("lower"), r))
    raw = F.flatten(F.transform(chosen, lambda r: _found(F.col("lower"), r)))
    empty = F.array().cast("array<struct<first:int,last:int,label:string,priority:int>>")
    found = base.withColumn("raw", F.when(F.col("lower").isNotNull(), raw).otherwise(empty)).drop("lower")

    kept = found.withColumn("detections", outermost(F.col("raw"))).drop("raw")
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("detections", lambda x: x["label"]))))
    best = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda x: x["priority"])), F.lit(0)), F.when(F.col("n_base") > 0, 60).otherwise(0))
    return kept.withColumns({"labels": F.array_join(every, ","), "base_labels": F.array_join("base_labels", ","), "score": best / F.lit(100.0)})


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
