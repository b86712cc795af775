"""License scans: ordered signature rules over word sequences, in built-in expressions only.

A text becomes its words: A-Z are lower-cased, and words are runs of digits,
letters a-z and characters beyond ASCII.  Rules are regular expressions over the
words joined by single spaces; each has a keyword, a priority (1 is strongest)
and a label.  A text without any keyword is not looked at further; a rule
runs only where its keyword stands as a word.

Every match is an interval of words.  Sorted by start, longest first, then by
priority and rule, an interval goes if an earlier one that stays contains it and
has the same or a stronger priority.  All of that happens within the row: no
shuffle, no Python.

Null text counts as empty: no words, no labels, score 0.  Every row is judged by
itself, so repeated rows get equal results; an empty table gives an empty result.
Intervals that start alike are ordered by length, priority and place in the table, so ties have
one outcome.  Very long texts are scanned whole, in time that grows with their length.  Extra
columns are not read, so their names may be any.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


#: (label, keyword, name, versions); a name is a regular expression over words.
FAMILIES = [
    ("apache", "apache", r"apache(?: software)?", ["1.0", "1.1", "2.0"]),
    ("mit", "mit", r"(?:the )?mit(?: x11)?", []),
    ("mit", "expat", r"expat", []),
    ("x11", "x11", r"x11", []),
    ("gpl", "gpl", r"(?:gnu )?gpl", ["1.0", "2.0", "3.0"]),
    ("gpl", "general", r"(?:gnu )?general public", ["1.0", "2.0", "3.0"]),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ["2.0", "2.1", "3.0"]),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public", ["2.1", "3.0"]),
    ("lgpl", "library", r"(?:gnu )?library general public", ["2.0"]),
    ("agpl", "agpl", r"(?:gnu )?agpl", ["1.0", "3.0"]),
    ("agpl", "affero", r"(?:gnu )?affero general public", ["1.0", "3.0"]),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl", ["1.1", "1.2", "1.3"]),
    ("gfdl", "documentation", r"(?:gnu )?free documentation", ["1.1", "1.2", "1.3"]),
    ("mpl", "mpl", r"mpl", ["1.0", "1.1", "2.0"]),
    ("mpl", "mozilla", r"mozilla public", ["1.0", "1.1", "2.0"]),
    ("epl", "epl", r"epl", ["1.0", "2.0"]),
    ("epl", "eclipse", r"eclipse public", ["1.0", "2.0"]),
    ("cddl", "cddl", r"cddl", ["1.0", "1.1"]),
    ("cddl", "distribution", r"common development and distribution", ["1.0", "1.1"]),
    ("eupl", "eupl", r"eupl", ["1.0", "1.1", "1.2"]),
    ("eupl", "union", r"european union public", ["1.0", "1.1", "1.2"]),
    ("artistic", "artistic", r"(?:perl )?artistic", ["1.0", "2.0"]),
    ("boost", "boost", r"boost(?: software)?", ["1.0"]),
    ("zlib", "zlib", r"zlib(?: libpng)?", []),
    ("isc", "isc", r"isc", []),
    ("python", "psf", r"psf", ["2.0"]),
    ("python", "python", r"python software foundation", ["2.0"]),
    ("bsd-2-clause", "bsd", r"(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd", []),
    ("bsd-2-clause", "freebsd", r"freebsd", []),
    ("bsd-3-clause", "bsd", r"(?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|modified|revised) bsd", []),
    ("bsd-4-clause", "bsd", r"(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd", []),
    ("bsd", "bsd", r"bsd(?: style)?", []),
    ("wtfpl", "wtfpl", r"wtfpl", ["1.0", "2.0"]),
    ("unlicense", "unlicense", r"(?:the )?unlicense", []),
    ("ms-pl", "microsoft", r"microsoft public", []),
    ("ms-rl", "microsoft", r"microsoft reciprocal", []),
    ("odbl", "odbl", r"odbl", ["1.0"]),
    ("odbl", "database", r"open database", ["1.0"]),
    ("ofl", "ofl", r"(?:sil )?ofl", ["1.0", "1.1"]),
    ("ofl", "font", r"(?:sil )?open font", ["1.0", "1.1"]),
    ("osl", "osl", r"osl", ["1.0", "2.0", "2.1", "3.0"]),
    ("afl", "academic", r"academic free", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("cpl", "common", r"common public", ["1.0"]),
    ("openssl", "openssl", r"openssl", []),
    ("ncsa", "ncsa", r"(?:uiuc )?ncsa(?: open source)?", []),
    ("postgresql", "postgresql", r"postgresql", []),
    ("bsl", "business", r"business source", ["1.0", "1.1"]),
    ("sspl", "sspl", r"sspl", ["1.0"]),
    ("sspl", "server", r"server side public", ["1.0"]),
    ("qpl", "qpl", r"qpl", ["1.0"]),
    ("qpl", "q", r"q public", ["1.0"]),
    ("ppl", "php", r"php", ["3.0", "3.01"]),
]

#: Elements of the shared-culture licenses and their versions; labels are like cc-by-nc-4.0.
CC_ELEMENTS = ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]
CC_NAMES = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

GRANT = r"(?:licensed|released|distributed|available|published|provided|dual licensed) (?:under|with) (?:the )?(?:terms of (?:the )?)?"
LICENSE = r"(?: public)?(?: licen[sc]es?)?"

#: Whole notices and phrases that need no name from the tables above.
NOTICES = [
    Rule("mit", 1, "charge", r"permission is hereby granted free of charge to any person obtaining a copy"),
    Rule("isc", 1, "fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    Rule("bsd", 1, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    Rule("zlib", 1, "warranty", r"this software is provided as is without any express or implied warranty in no event"),
    Rule("boost", 1, "organization", r"permission is hereby granted free of charge to any person or organization"),
    Rule("unlicense", 1, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    Rule("apache-2.0", 1, "compliance", r"licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license"),
    Rule("apache-2.0", 1, "apache", r"you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    Rule("apache-2.0", 2, "apache", r"(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    Rule("apache-2.0", 1, "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    Rule("apache-1.1", 1, "apache", r"this product includes software developed by the apache software foundation"),
    Rule("mpl-2.0", 1, "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    Rule("mpl-2.0", 1, "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    Rule("mpl-1.1", 1, "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    Rule("mpl-2.0", 2, "mozilla", r"(?:https? )?(?:www )?mozilla org mpl 2 0"),
    Rule("gpl", 1, "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Rule("gpl", 1, "hope", r"this program is distributed in the hope that it will be useful but without any warranty"),
    Rule("gpl", 1, "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    Rule("gpl", 1, "received", r"you should have received a copy of the gnu general public license along with this program"),
    Rule("gpl", 2, "gnu", r"(?:https? )?(?:www )?gnu org licenses gpl(?: html| txt)?"),
    Rule("lgpl", 1, "redistribute", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    Rule("lgpl", 1, "received", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this library"),
    Rule("lgpl", 1, "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license for more details"),
    Rule("agpl", 1, "received", r"you should have received a copy of the gnu affero general public license along with this program"),
    Rule("agpl", 1, "remotely", r"all users interacting with it remotely through a computer network"),
    Rule("gfdl", 1, "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    Rule("gfdl", 1, "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    Rule("mit", 1, "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Rule("mit", 1, "restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    Rule("mit", 1, "merchantability", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    Rule("mit", 1, "liable", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    Rule("mit", 2, "opensource", r"opensource org licenses mit(?: license(?: php| html)?)?"),
    Rule("x11", 1, "consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    Rule("bsd", 1, "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    Rule("bsd", 1, "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    Rule("bsd-3-clause", 1, "endorse", r"nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    Rule("bsd-4-clause", 1, "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    Rule("bsd", 1, "contributors", r"this software is provided by the (?:copyright holders|regents|author|authors) and contributors as is"),
    Rule("bsd", 1, "liable", r"in no event shall the (?:copyright owner|copyright holders?|regents) or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    Rule("isc", 1, "disclaims", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    Rule("hpnd", 1, "fee", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    Rule("zlib", 1, "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    Rule("zlib", 1, "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    Rule("zlib", 1, "arising", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    Rule("boost-1.0", 1, "boost", r"boost software license version 1 0(?: august 17th 2003)?"),
    Rule("boost-1.0", 2, "boost", r"(?:www )?boost org license 1 0 txt"),
    Rule("unlicense", 1, "compile", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    Rule("unlicense", 2, "unlicense", r"(?:https? )?unlicense org"),
    Rule("wtfpl", 1, "fuck", r"(?:you just )?do what the fuck you want to(?: public license)?"),
    Rule("cc0-1.0", 1, "waived", r"has waived all copyright and related or neighboring rights"),
    Rule("cc0-1.0", 1, "deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    Rule("cc0-1.0", 2, "publicdomain", r"creativecommons org publicdomain zero 1 0"),
    Rule("epl", 1, "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    Rule("cddl", 1, "contents", r"the contents of this file are subject to the terms of the common development and distribution license"),
    Rule("ofl", 1, "font", r"this font software is licensed under the sil open font license(?: version 1 1)?"),
    Rule("artistic", 1, "intent", r"the intent of this document is to state the conditions under which a package may be copied"),
    Rule("python", 1, "licensee", r"psf is making python available to licensee on an as is basis"),
    Rule("openssl", 1, "openssl", r"this product includes software developed by the openssl project"),
    Rule("openssl", 1, "cryptographic", r"this product includes cryptographic software written by eric young"),
    Rule("php", 1, "php", r"this product includes php software freely available from"),
    Rule("ms-pl", 1, "governs", r"this license governs use of the accompanying software if you use the software you accept this license"),
    Rule("bsl", 1, "grant", r"additional use grant"),
    Rule("commons-clause", 1, "commons", r"commons clause(?: license condition)?(?: v?1 0)?"),
    Rule("elastic-2.0", 1, "elastic", r"elastic license(?: version)?(?: v?2(?: 0)?)?"),
    Rule("json", 1, "evil", r"the software shall be used for good not evil"),
    Rule("beerware", 1, "beer", r"you can buy me a beer in return"),
    Rule("beerware", 2, "beerware", r"beerware(?: licen[sc]e)?"),
    Rule("zpl", 2, "zope", r"zope public licen[sc]e"),
    Rule("ftl", 2, "freetype", r"freetype(?: project)? licen[sc]e"),
    Rule("unicode", 1, "unicode", r"unicode inc license agreement data files and software"),
    Rule("unicode", 2, "unicode", r"unicode licen[sc]e"),
    Rule("w3c", 2, "w3c", r"w3c (?:software(?: and document)? notice and )?licen[sc]e"),
    Rule("apsl", 2, "apple", r"apple public source licen[sc]e"),
    Rule("npl", 2, "netscape", r"netscape public licen[sc]e"),
    Rule("ipl", 2, "ibm", r"ibm public licen[sc]e"),
    Rule("lpl", 2, "lucent", r"lucent public licen[sc]e"),
    Rule("sun-ppl", 2, "sun", r"sun (?:industry standards source|public) licen[sc]e"),
    Rule("rpl", 2, "reciprocal", r"reciprocal public licen[sc]e"),
    Rule("cpal", 2, "attribution", r"common public attribution licen[sc]e"),
    Rule("ecl", 2, "educational", r"educational community licen[sc]e"),
    Rule("sleepycat", 2, "sleepycat", r"sleepycat licen[sc]e"),
    Rule("ruby", 2, "ruby", r"ruby licen[sc]e"),
    Rule("vim", 2, "vim", r"vim licen[sc]e"),
    Rule("cecill", 2, "cecill", r"cecill(?: [bc])?(?: 2(?: [01])?)?(?: free software license agreement)?"),
    Rule("ogl", 2, "government", r"open government licen[sc]e(?: v?[123] 0)?"),
    Rule("etalab", 2, "ouverte", r"licence ouverte(?: open licence)?"),
    Rule("mulan-psl", 2, "mulan", r"mulan (?:psl|permissive software license)(?: v2)?"),
    Rule("blueoak", 2, "oak", r"blue oak model licen[sc]e"),
    Rule("hippocratic", 2, "hippocratic", r"hippocratic licen[sc]e"),
    Rule("polyform", 2, "polyform", r"polyform (?:noncommercial|strict|shield|perimeter|small business|internal use|free trial) licen[sc]e"),
    Rule("openrail", 2, "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?"),
    Rule("rail", 2, "responsible", r"responsible ai licen[sc]e"),
    Rule("pddl", 2, "pddl", r"pddl(?: 1 0)?"),
    Rule("odc-by", 2, "data", r"open data commons attribution licen[sc]e"),
    Rule("proprietary", 2, "vorbehalten", r"alle rechte vorbehalten"),
    Rule("proprietary", 2, "derechos", r"todos los derechos reservados"),
    Rule("proprietary", 2, "droits", r"tous droits reserves"),
    Rule("proprietary", 1, "redistribution", r"redistribution (?:of this (?:file|software) )?is (?:strictly )?prohibited"),
    Rule("proprietary", 1, "reproduced", r"no part of this (?:publication|book|document|work) may be reproduced"),
    Rule("proprietary", 1, "consent", r"without (?:the )?(?:prior|express) written consent of"),
    Rule("evaluation", 2, "evaluation", r"for evaluation (?:purposes )?only"),
    Rule("noncommercial", 2, "commercial", r"for non commercial use only"),
    Rule("gpl-2.0", 1, "version", r"under the terms of version 2 of the gnu general public license as published by the free software foundation"),
    Rule("gpl-3.0", 1, "version", r"under the terms of version 3 of the gnu general public license as published by the free software foundation"),
    Rule("gpl", 1, "inc", r"write to the free software foundation inc (?:51 franklin street|59 temple place|675 mass ave)"),
    Rule("gpl", 2, "copying", r"see the file copying for (?:details|more details|the license|license details)"),
    Rule("gpl", 1, "exception", r"as a special exception (?:the copyright holders|you may|linking this)"),
    Rule("gpl", 1, "freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    Rule("gpl-3.0", 1, "kinds", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    Rule("gpl-3.0", 1, "tivoization", r"tivoization"),
    Rule("gpl", 2, "copylefted", r"copylefted (?:software|under the gpl)"),
    Rule("lgpl", 1, "linked", r"combined or linked with the library"),
    Rule("lgpl", 2, "lgpl", r"(?:https? )?(?:www )?gnu org licenses lgpl(?: html| txt| 2 1| 3 0)?"),
    Rule("agpl", 2, "agpl", r"(?:https? )?(?:www )?gnu org licenses agpl(?: html| txt| 3 0)?"),
    Rule("gfdl", 2, "fdl", r"(?:https? )?(?:www )?gnu org (?:copyleft|licenses) fdl(?: html| txt)?"),
    Rule("gfdl", 1, "cover", r"with the front cover texts being"),
    Rule("apache-2.0", 1, "contributor", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    Rule("apache-2.0", 1, "asf", r"the asf licenses this file to you under the apache license"),
    Rule("apache-2.0", 1, "perpetual", r"grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    Rule("apache-1.1", 1, "acknowledgment", r"the end user documentation included with the redistribution if any must include the following acknowledgment"),
    Rule("apache-1.0", 1, "apache", r"for use in the apache http server project"),
    Rule("bsd", 2, "bsd", r"opensource org licenses bsd license(?: php| html)?"),
    Rule("bsd-3-clause", 2, "bsd", r"opensource org licenses bsd 3 clause"),
    Rule("bsd-2-clause", 2, "bsd", r"opensource org licenses bsd 2 clause"),
    Rule("bsd", 1, "governed", r"use of this source code is governed by a bsd style license that can be found in the license file"),
    Rule("mit", 1, "governed", r"use of this source code is governed by an mit style license that can be found in the license file"),
    Rule("bsd-4-clause", 1, "berkeley", r"this product includes software developed by the university of california berkeley and its contributors"),
    Rule("bsd", 1, "regents", r"copyright(?: c)?(?: (?:19|20)\d\d)?(?: (?:19|20)\d\d)? the regents of the university of california"),
    Rule("bsd", 1, "procurement", r"including but not limited to procurement of substitute goods or services"),
    Rule("0bsd", 1, "0bsd", r"0bsd|zero clause bsd 0bsd"),
    Rule("0bsd", 2, "clause", r"(?:zero|0) clause bsd(?: licen[sc]e)?"),
    Rule("bsd-3-clause-clear", 1, "clear", r"(?:the )?clear bsd licen[sc]e"),
    Rule("mit-0", 1, "attribution", r"mit no attribution(?: licen[sc]e)?"),
    Rule("mit", 2, "mit", r"(?:see|under) the mit licen[sc]e file"),
    Rule("x11", 1, "documentation", r"and that both that copyright notice and this permission notice appear in supporting documentation"),
    Rule("hpnd", 1, "representations", r"makes no representations about the suitability of this software for any purpose it is provided as is"),
    Rule("ntp", 1, "ntp", r"ntp licen[sc]e"),
    Rule("curl", 2, "curl", r"curl licen[sc]e"),
    Rule("icu", 1, "icu", r"icu licen[sc]e(?: icu 1 8 1 and later)?"),
    Rule("libpng", 2, "png", r"png reference library licen[sc]e(?: version 2)?"),
    Rule("libtiff", 1, "leffler", r"copyright(?: c)? (?:19\d\d )?(?:19\d\d )?sam leffler"),
    Rule("ijg", 1, "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    Rule("imagemagick", 2, "imagemagick", r"imagemagick licen[sc]e"),
    Rule("tcl", 1, "tcl", r"tcl tk licen[sc]e(?: terms)?"),
    Rule("naist", 2, "naist", r"naist(?: 2003)? licen[sc]e"),
    Rule("psf-2.0", 1, "beopen", r"beopen(?: com)? (?:python open source )?licen[sc]e agreement"),
    Rule("cnri", 1, "cnri", r"cnri (?:open source gpl compatible |open source )?licen[sc]e agreement"),
    Rule("perl", 1, "perl", r"under the same terms as perl itself"),
    Rule("artistic", 2, "perlfoundation", r"(?:https? )?(?:www )?perlfoundation org artistic license 2 0"),
    Rule("epl", 2, "epl", r"(?:https? )?(?:www )?eclipse org legal epl (?:v10|v20|2 0)(?: html)?"),
    Rule("edl", 1, "edl", r"eclipse distribution license(?: v)? 1 0 edl"),
    Rule("edl", 2, "eclipse", r"eclipse distribution licen[sc]e"),
    Rule("mpl-2.0", 1, "incompatible", r"this source code form is incompatible with secondary licenses"),
    Rule("mpl-1.1", 1, "initial", r"the initial developer of the original code is"),
    Rule("mpl-1.1", 1, "warranty", r"software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language"),
    Rule("eupl", 1, "eupl", r"licensed under the eupl(?: version)? 1 [12] or as soon they will be approved by the european commission"),
    Rule("cecill", 1, "cecill", r"this software is governed by the cecill(?: [bc])? license under french law"),
    Rule("ofl", 1, "reserved", r"with reserved font name"),
    Rule("ofl", 2, "ofl", r"(?:https? )?scripts sil org ofl"),
    Rule("ubuntu-font", 2, "ubuntu", r"ubuntu font licen[sc]e(?: version 1 0)?"),
    Rule("bitstream-vera", 1, "bitstream", r"bitstream vera is a trademark of bitstream inc"),
    Rule("gust-font", 2, "gust", r"gust font (?:nosource )?licen[sc]e"),
    Rule("lppl", 1, "lppl", r"lppl(?: version)?(?: 1 [0123][abc]?)?"),
    Rule("lppl", 1, "latex", r"latex project public licen[sc]e(?: version 1 [0123][abc]?)?"),
    Rule("knuth", 1, "knuth", r"copyright (?:19\d\d )?(?:by )?d e knuth"),
    Rule("odbl", 2, "odbl", r"(?:https? )?opendatacommons org licenses odbl(?: 1 0)?"),
    Rule("odbl", 2, "openstreetmap", r"openstreetmap contributors"),
    Rule("cdla-permissive", 1, "cdla", r"cdla permissive(?: v)?(?: [12] 0)?"),
    Rule("cdla-sharing", 1, "cdla", r"cdla sharing(?: v)?(?: 1 0)?"),
    Rule("cdla", 2, "community", r"community data licen[sc]e agreement"),
    Rule("cc", 2, "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses(?: by(?: nc)?(?: sa| nd)?(?: [1234] [05])?)?"),
    Rule("cc", 1, "remix", r"you are free to share copy and redistribute the material in any medium or format adapt remix transform and build upon"),
    Rule("cc", 1, "attribution", r"you must give appropriate credit provide a link to the license and indicate if changes were made attribution|attribution you must give appropriate credit"),
    Rule("cc", 1, "deed", r"human readable summary of and not a substitute for the license deed|deed this is a human readable summary of"),
    Rule("ms-pl", 2, "pl", r"ms pl"),
    Rule("ms-limited", 2, "microsoft", r"microsoft (?:limited (?:public|reciprocal)|reference source) licen[sc]e"),
    Rule("oracle-bcl", 1, "oracle", r"oracle binary code licen[sc]e agreement"),
    Rule("otn", 2, "otn", r"otn (?:developer |free )?licen[sc]e"),
    Rule("sun-bcl", 1, "sun", r"sun microsystems inc binary code licen[sc]e agreement"),
    Rule("jcp", 2, "jcp", r"jcp specification licen[sc]e"),
    Rule("adobe", 2, "adobe", r"adobe systems incorporated source code licen[sc]e agreement"),
    Rule("intel", 1, "intel", r"intel (?:simplified software|open source|open software) licen[sc]e"),
    Rule("nvidia", 2, "nvidia", r"nvidia (?:software|source code|cuda toolkit|open model) licen[sc]e"),
    Rule("llama-community", 1, "llama", r"(?:meta )?llama (?:[234] )?(?:[0123] )?community licen[sc]e(?: agreement)?"),
    Rule("gemma", 2, "gemma", r"gemma terms of use"),
    Rule("gutenberg", 1, "gutenberg", r"under the terms of the project gutenberg license"),
    Rule("gutenberg", 2, "gutenberg", r"project gutenberg (?:tm )?licen[sc]e"),
    Rule("dual", 2, "dual", r"dual licensed"),
    Rule("dual", 2, "choice", r"at your choice (?:under|of) (?:either )?(?:the )?licen[sc]es?"),
    Rule("freeware", 3, "freeware", r"freeware"),
    Rule("shareware", 3, "shareware", r"shareware"),
    Rule("proprietary", 1, "confidential", r"(?:this (?:document|file|software) (?:is|contains) )?confidential and proprietary(?: information)?"),
    Rule("proprietary", 1, "copying", r"(?:any )?unauthori[sz]ed copying(?: of this (?:file|software))?(?: via any medium)? is strictly prohibited"),
    Rule("proprietary", 2, "eula", r"eula"),
    Rule("proprietary", 2, "agreement", r"end user licen[sc]e agreement"),
    Rule("proprietary", 2, "riservati", r"tutti i diritti riservati"),
    Rule("proprietary", 2, "direitos", r"todos os direitos reservados"),
    Rule("proprietary", 2, "voorbehouden", r"alle rechten voorbehouden"),
    Rule("educational", 2, "educational", r"for educational (?:use|purposes) only"),
    Rule("research", 2, "research", r"for (?:academic |non commercial )?research (?:use|purposes) only"),
    Rule("personal", 2, "personal", r"for personal(?: non commercial)? use only"),
    Rule("trial", 2, "trial", r"(?:free )?trial version only"),
    Rule("public-domain", 1, "domain", r"(?:dedicated|released|placed) (?:to|in|into) the public domain"),
    Rule("public-domain", 3, "domain", r"public domain"),
    Rule("cc0-1.0", 1, "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    Rule("cc0-1.0", 2, "zero", r"creative commons zero"),
    Rule("cc0-1.0", 2, "dedication", r"public domain dedication"),
    Rule("cc0-1.0", 2, "universal", r"1 0 universal"),
    Rule("gpl-2.0-or-later", 1, "later", r"either version 2 of the licen[sc]e or at your option any later version"),
    Rule("gpl-3.0-or-later", 1, "later", r"either version 3 of the licen[sc]e or at your option any later version"),
    Rule("proprietary", 2, "rights", r"all rights reserved"),
    Rule("proprietary", 2, "proprietary", r"proprietary(?: and confidential)?"),
    Rule("copyright", 3, "copyright", r"copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)?"),
    Rule("copyleft", 3, "copyleft", r"copyleft"),
    Rule("creative-commons", 3, "creative", r"creative commons(?: licen[sc]e)?"),
    Rule("open-source", 3, "source", r"open source licen[sc]e"),
    Rule("unknown", 3, "license", r"license"),
    Rule("unknown", 3, "licence", r"licence"),
    Rule("unknown", 3, "licensed", r"licensed under"),
]

#: Base places: fixed phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The one keyword that is too common a word in other languages to be a trigger by itself: its rules all hold one of these as well.
COMMON, BESIDE = "mit", r"licen[sc]e|(?:released|distributed|available|published|provided) (?:under|with) "


def _version(v: str) -> str:
    major, minor = v.split(".")
    tail = rf"(?: {minor}| {minor[0]})?" if minor == "0" else rf" {minor}"
    return rf"(?: version| v)?(?: v?{major}{tail})(?: (?:only|or later))?"


def rules() -> list[Rule]:
    """All rules in order: notices, then what the families give, from the most to the least specific."""
    out = list(NOTICES)
    for label, keyword, name, versions in FAMILIES:
        for v in versions:
            full = f"{label}-{v}"
            out += [
                Rule(full, 1, "spdx", rf"spdx license identifier {label} {v.replace('.', ' ')}(?: (?:only|or later))?") if label == keyword else Rule(full, 1, keyword, rf"(?:{name}) licen[sc]e(?: as published by the free software foundation)?{_version(v)}"),
                Rule(full, 1, keyword, rf"{GRANT}(?:{name}){LICENSE}{_version(v)}"),
                Rule(full, 2, keyword, rf"(?:{name}){LICENSE}{_version(v)}"),
            ]
        out += [Rule(label, 2, keyword, rf"{GRANT}(?:{name}){LICENSE}"), Rule(label, 3, keyword, rf"(?:{name}) licen[sc]e")]
    for e in CC_ELEMENTS:
        words = "".join(rf"(?: {CC_NAMES[x]})" if i else CC_NAMES[x] for i, x in enumerate(e.split(" ")))
        for v in CC_VERSIONS:
            major, minor = v.split(".")
            label = f"cc-{e.replace(' ', '-')}-{v}"
            out += [Rule(label, 1, "cc", rf"(?:{GRANT})?cc {e} {major} {minor}"), Rule(label, 1, "creative", rf"(?:{GRANT})?creative commons {words}(?: {major} {minor})(?: international| unported| generic)?(?: licen[sc]e)?")]
        out.append(Rule(f"cc-{e.replace(' ', '-')}", 2, "cc", rf"cc {e}"))
    return out


def let(value: Column, f) -> Column:
    """Binds a value to a name within an expression, so that it is computed once."""
    return F.transform(F.array(value), f)[0]


_SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text; null gives none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _CAPITALS + _SEPARATORS, _CAPITALS.lower() + " " * len(_SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def spans(joined: Column, pattern: Column) -> Column:
    """(start, end) in words of each match of the pattern in the joined words, which begin and end with a space."""
    marked = F.regexp_replace(joined, F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )")), F.lit("\x01$0\x02"))
    blanks = lambda x: (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc, piece):
        inside, at = acc["inside"], acc["at"] + blanks(piece)
        one = F.array(F.struct((acc["at"] - 1).alias("start"), at.alias("end")))
        return F.struct(at.alias("at"), (~inside).alias("inside"), F.when(inside, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("inside"), none.alias("found"))
    return let(marked, lambda m: F.when(F.instr(m, "\x01") > 0, F.aggregate(F.split(m, "[\x01\x02]"), start, step, lambda acc: acc["found"])).otherwise(none))


def _suppressed(found: Column) -> Column:
    """Detections in order, without those that an earlier one of the same or a stronger priority contains."""
    kind = "array<struct<start:bigint,after:bigint,priority:int,rule:int,label:string>>"
    zero = F.struct(*[F.lit(-1).cast("long").alias(f"end{p}") for p in (1, 2, 3)], F.array().cast(kind).alias("kept"))

    def step(acc, d):
        end = -d["after"]
        reach = F.when(d["priority"] == 1, acc["end1"]).when(d["priority"] == 2, acc["end2"]).otherwise(acc["end3"])
        stays = reach < end
        ends = [F.when(stays & (d["priority"] <= p), F.greatest(acc[f"end{p}"], end)).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in (1, 2, 3)]
        return F.struct(*ends, F.when(stays, F.concat(acc["kept"], F.array(d))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(F.sort_array(found), zero, step, lambda acc: acc["kept"])


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """(id, n_words, base, detections) for each row.

    ``base``: array of (start, label) of the fixed phrases; ``detections``: array of
    (start, end, label, priority, rule) that stay, start and end in words.
    """
    table = rules() if table is None else table
    known = F.array(*[F.lit(k) for k in sorted({r.keyword for r in table})])
    triggers = F.array(*[F.lit(k) for k in sorted({r.keyword for r in table} - {COMMON})])
    row = "named_struct('rule', {}, 'priority', {}, 'label', '{}', 'keyword', '{}', 'pattern', r'{}')"
    signatures = F.expr(f"array({', '.join(row.format(i, r.priority, r.label, r.keyword, r.pattern) for i, r in enumerate(table))})")
    phrases = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(x).alias("label")) for p, x in BASE.items()])
    kind = "struct<base:array<struct<start:bigint,label:string>>,detections:array<struct<start:bigint,end:bigint,label:string,priority:int,rule:int>>>"

    def look(joined: Column) -> Column:
        base = F.flatten(F.transform(phrases, lambda p: F.transform(spans(joined, p["pattern"]), lambda s: F.struct(s["start"].alias("start"), p["label"].alias("label")))))
        present = F.filter(known, lambda k: F.contains(joined, F.concat(F.lit(" "), k, F.lit(" "))))
        found = let(present, lambda here: F.flatten(F.transform(
            F.filter(signatures, lambda r: F.array_contains(here, r["keyword"])),
            lambda r: F.transform(spans(joined, r["pattern"]), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("after"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"))),
        )))
        kept = F.transform(_suppressed(found), lambda d: F.struct(d["start"].alias("start"), (-d["after"]).alias("end"), d["label"].alias("label"), d["priority"].alias("priority"), d["rule"].alias("rule")))
        return F.struct(F.sort_array(base).alias("base"), kept.alias("detections"))

    def of(w: Column) -> Column:
        joined = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
        trigger = F.arrays_overlap(w, triggers)
        found = let(joined, lambda j: F.when(trigger | j.rlike(BESIDE), look(j)).cast(kind))
        return F.struct(F.size(w).cast("long").alias("n_words"), found.alias("found"))

    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text)).alias("w")).select("id", let(F.col("w"), of).alias("x"))
    return rows.select(F.col("id").alias(id_col), "x.n_words", F.coalesce("x.found.base", F.array().cast("array<struct<start:bigint,label:string>>")).alias("base"), F.coalesce("x.found.detections", F.array().cast("array<struct<start:bigint,end:bigint,label:string,priority:int,rule:int>>")).alias("detections"))


def summarize(scanned: DataFrame) -> DataFrame:
    """Counts, first and last base places, labels and the share of words that detections cover."""
    labels = lambda c: F.transform(F.col(c), lambda d: d["label"])
    text = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate("detections", zero, lambda a, d: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), d["end"] - F.greatest(d["start"], a["end"]))).alias("n"), F.greatest(a["end"], d["end"]).alias("end")), lambda a: a["n"])
    starts = F.transform("base", lambda b: b["start"])
    return scanned.withColumns({
        "n_base": F.size("base").cast("long"), "first_word": F.array_min(starts), "last_word": F.array_max(starts),
        "base_labels": text(labels("base")), "labels": text(F.concat(labels("base"), labels("detections"))),
        "score": F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(F.lit(0.0)),
    })
