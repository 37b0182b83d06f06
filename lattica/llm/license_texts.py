"""Signatures of license texts: phrases of grants, notices, headers, conditions and disclaimers.

Each is written as its words, between which anything but letters and digits may stand.
Brackets hold alternatives of words; with a question mark they may be missing. Phrases
stand under topics, for reading only.
"""

from __future__ import annotations

#: topic: (label, weight, phrase)
TEXTS: dict[str, tuple[tuple[str, float, str], ...]] = {
    "permission": (
        ("mit", 0.97, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"),
        ("mit", 0.95, "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
        ("mit-0", 0.9, "to permit persons to whom the software is furnished to do so"),
        ("isc", 0.95, "permission to use copy modify and (or)? distribute this software for any purpose with or without fee is hereby granted"),
        ("hpnd", 0.9, "permission to use copy modify and distribute this software and its documentation for any purpose"),
        ("hpnd", 0.8, "permission to use copy modify distribute and sell this software"),
        ("hpnd", 0.8, "that both that copyright notice and this permission notice appear in supporting documentation"),
        ("gfdl", 0.95, "permission is granted to copy distribute and or modify this document under the terms of"),
        ("gfdl", 0.7, "permission is granted to make and distribute verbatim copies of"),
        ("bsl-1.0", 0.97, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
        ("unicode", 0.95, "permission is hereby granted free of charge to any person obtaining a copy of (the)? unicode data files"),
        ("ofl", 0.95, "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
        ("zlib", 0.95, "permission is granted to anyone to use this software for any purpose including commercial applications"),
        ("bsd", 0.9, "without specific prior written permission"),
        ("proprietary", 0.8, "without (express|prior|explicit) written permission"),
        ("postgresql", 0.9, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
        ("x11", 0.9, "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
        ("ijg", 0.9, "permission is hereby granted to use copy modify and distribute this software or portions thereof for any purpose without fee"),
        ("libpng", 0.9, "permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose"),
    ),
    "redistribution": (
        ("bsd", 0.95, "redistribution and use in source and binary forms with or without modification are permitted provided that"),
        ("bsd", 0.9, "redistributions of source code must retain the above copyright notice this list of conditions"),
        ("bsd", 0.9, "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
        ("bsd-3-clause-clear", 0.9, "redistribution and use in source and binary forms with or without modification are permitted subject to the limitations in the disclaimer"),
        ("openssl", 0.9, "redistributions of any form whatsoever must retain the following acknowledgment"),
        ("apache-1.1", 0.9, "the end user documentation included with the redistribution if any must include the following acknowledgment"),
        ("proprietary", 0.7, "redistribution is (prohibited|forbidden)"),
        ("proprietary", 0.8, "no redistribution (allowed|permitted)"),
    ),
    "acknowledg": (
        ("bsd-4-clause", 0.95, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
        ("bsd-4-clause", 0.9, "must display the following acknowledge?ment this product includes software developed by"),
    ),
    "this product includes": (
        ("apache", 0.9, "this product includes software developed (by|at) the apache software foundation"),
        ("openssl", 0.95, "this product includes software developed by the openssl project"),
        ("openssl", 0.95, "this product includes cryptographic software written by eric young"),
        ("bsd-4-clause", 0.9, "this product includes software developed by the university of california berkeley"),
        ("php", 0.9, "this product includes php software"),
    ),
    "endorse": (
        ("bsd-3-clause", 0.95, r"neither the names? of [a-z0-9 ,]{1,80} may be used to endorse or promote products derived from this software"),
        ("bsd-3-clause", 0.8, "may be used to endorse or promote products derived from this software"),
        ("apache-1.1", 0.8, "must not be used to endorse or promote products derived from this software without prior written"),
    ),
    "as is": (
        ("mit", 0.9, "the software is provided as is without warranty of any kind express or implied"),
        ("bsd", 0.9, "this software is provided by the (copyright|regents|authors?) (holders?|and)? (and)? contributors? as is and any express or implied warranties"),
        ("bsd", 0.9, "this software is provided by the author as is and any express or implied warranties"),
        ("isc", 0.9, "the software is provided as is and [a-z ]{2,60} disclaims all warranties with regard to this software"),
        ("zlib", 0.95, "this software is provided as is without any express or implied warranty"),
        ("apache-2.0", 0.9, "distributed under the license is distributed on an as is basis"),
        ("mpl-2.0", 0.9, "covered software is provided under this license on an as is basis"),
        ("epl", 0.8, "the program is provided on an as is basis without warranties or conditions of any kind"),
        ("disclaimer", 0.3, "provided (strictly)? as is"),
        ("disclaimer", 0.3, "distributed (strictly)? as is"),
    ),
    "liab": (
        ("mit", 0.9, "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
        ("bsd", 0.85, "in no event shall the (copyright|regents|author|foundation) (owner|holders?|or)? (or)? contributors be liable for any direct indirect incidental special exemplary"),
        ("zlib", 0.9, "in no event will the authors be held liable for any damages arising from the use of this software"),
        ("isc", 0.85, "in no event shall the author be liable for any special direct indirect or consequential damages"),
        ("gpl", 0.85, "in no event unless required by applicable law or agreed to in writing will any copyright holder"),
        ("disclaimer", 0.3, "limitation of liability"),
        ("disclaimer", 0.3, "accepts? no liability for"),
        ("disclaimer", 0.3, "shall not be (held)? liable for any"),
    ),
    "warrant": (
        ("gpl", 0.9, "in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
        ("gpl", 0.8, "in the hope that it will be useful but without any warranty"),
        ("apache-2.0", 0.8, "without warranties or conditions of any kind either express or implied"),
        ("gpl", 0.85, "there is no warranty for the program to the extent permitted by applicable law"),
        ("gpl-3.0", 0.85, "this program comes with absolutely no warranty"),
        ("disclaimer", 0.3, "disclaims? (any|all) (express|implied)? (or)? (implied)? warrant(y|ies)"),
        ("disclaimer", 0.3, "without (any)? (express|implied)? warranty of any kind"),
        ("disclaimer", 0.3, "(implied)? warranties of merchantability (and)? fitness for a particular purpose"),
        ("disclaimer", 0.3, "no warranty (is|express|of)"),
    ),
    "redistribute it": (
        ("gpl", 0.97, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
        ("lgpl", 0.97, "this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public licen[cs]e"),
        ("agpl", 0.97, "you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
        ("gpl", 0.8, "is free software you can redistribute it and or modify it"),
        ("perl", 0.95, "you can redistribute it and or modify it under the same terms as perl itself"),
    ),
    "under the same terms": (
        ("perl", 0.9, "under the same terms as (the)? perl (5)? (itself|programming)"),
        ("share-alike", 0.5, "under the same terms as the original"),
    ),
    "later version": (
        ("gpl-2.0", 0.9, "either version 2 of the license or at your option any later version"),
        ("gpl-3.0", 0.9, "either version 3 of the license or at your option any later version"),
        ("lgpl-2.1", 0.95, r"either version 2\.1 of the license or at your option any later version"),
        ("gfdl", 0.9, r"free documentation licen[cs]e version 1\.[123] or any later version published by the free software foundation"),
        ("gpl", 0.6, "or at your option any later version"),
    ),
    "gnu": (
        ("gpl", 0.95, "you should have received a copy of the gnu general public licen[cs]e along with this (program|software|file)"),
        ("lgpl", 0.95, "you should have received a copy of the gnu (lesser|library) general public licen[cs]e along with this (library|program|software)"),
        ("agpl", 0.95, "you should have received a copy of the gnu affero general public licen[cs]e"),
        ("gpl-3.0", 0.9, "the gnu general public licen[cs]e does not permit incorporating your program into proprietary programs"),
        ("classpath-exception", 0.9, "as a special exception the copyright holders of gnu classpath"),
    ),
    "free software foundation": (
        ("gpl", 0.85, r"write to the free software foundation inc\.? (51|59|675)"),
        ("gpl", 0.6, "as published by the free software foundation"),
    ),
    "verbatim copies": (
        ("gpl", 0.85, "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
        ("gpl", 0.8, "you may copy and distribute verbatim copies of the program s source code as you receive it"),
    ),
    "computer network": (
        ("agpl", 0.9, "if your software can interact with users remotely through a computer network"),
        ("agpl", 0.9, "all users interacting with it remotely through a computer network"),
    ),
    "linking": (
        ("gpl-exception", 0.85, "as a special exception [a-z ,]{0,80} gives? (you)? permission to link"),
        ("gpl-exception", 0.8, "linking this library statically or dynamically with other modules"),
        ("gcc-exception", 0.9, "gcc runtime library exception"),
    ),
    "in compliance with the license": (
        ("apache-2.0", 0.95, "you may not use this file except in compliance with the license"),
        ("mpl-1.1", 0.7, "you may not use this file except in compliance with the license you may obtain a copy of the license at https? www mozilla org"),
        ("cddl", 0.6, "you may not use this file except in compliance with the license you can obtain a copy"),
    ),
    "applicable law": (
        ("apache-2.0", 0.9, "unless required by applicable law or agreed to in writing software distributed under the license"),
        ("gpl-3.0", 0.6, "to the extent permitted by applicable law"),
    ),
    "specific language governing": (
        ("apache-2.0", 0.9, "see the license for the specific language governing permissions and limitations under the license"),
        ("mpl-1.1", 0.8, "see the license for the specific language governing rights and limitations under the license"),
    ),
    "contributor license": (
        ("apache-2.0", 0.95, "licensed to the apache software foundation asf under one or more contributor license agreements"),
        ("cla", 0.6, "contributor license agreement"),
    ),
    "grants to": (
        ("apache-2.0", 0.9, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (copyright|patent) license"),
        ("mpl", 0.85, "each contributor hereby grants (to)? you a world wide royalty free non exclusive license"),
        ("psf", 0.95, "psf hereby grants (to)? licensee a nonexclusive royalty free world wide license"),
        ("license-grant", 0.5, "hereby grants to (you|licensee) a (limited|perpetual|worldwide|non)"),
    ),
    "python software foundation": (
        ("psf", 0.95, "this license agreement is between the python software foundation"),
        ("psf", 0.7, "python software foundation all rights reserved"),
    ),
    "source code form": (
        ("mpl-2.0", 0.97, "this source code form is subject to the terms of the mozilla public licen[cs]e"),
        ("mpl-2.0", 0.9, "this source code form is incompatible with secondary licenses"),
    ),
    "mpl was not distributed": (("mpl-2.0", 0.97, r"if a copy of the mpl was not distributed with this file you can obtain one at"),),
    "contents of this file": (
        ("mpl", 0.9, "the contents of this file are subject to the mozilla public licen[cs]e"),
        ("cddl", 0.95, "the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
        ("npl", 0.9, "the contents of this file are subject to the netscape public licen[cs]e"),
        ("cpal", 0.9, "the contents of this file are subject to the common public attribution licen[cs]e"),
        ("idpl", 0.9, "the contents of this file are subject to the interbase public licen[cs]e"),
    ),
    "accompanying materials": (
        ("epl", 0.97, "this program and the accompanying materials are made available under the terms of the eclipse (public|distribution) licen[cs]e"),
        ("cpl", 0.9, "this program and the accompanying materials are made available under the terms of the common public licen[cs]e"),
        ("ibm-pl", 0.8, "the accompanying program is provided under the terms of this agreement"),
    ),
    "creative commons": (
        ("creative-commons", 0.9, "this work is licensed under (a|the) creative commons"),
        ("creative-commons", 0.9, "(text|content|images?|photos?|article|site) (is|are) (available|licensed) under (a|the) creative commons"),
        ("creative-commons", 0.8, "send a letter to creative commons"),
        ("creative-commons", 0.8, "except where otherwise noted content on this site is licensed under a creative commons"),
        ("creative-commons", 0.6, "creative commons (corporation|organi[sz]ation) is not a law firm"),
    ),
    "neighboring rights": (("cc0", 0.95, "has waived all copyright and related or neighboring rights to"), ("cc0", 0.8, "copyright and related or neighboring rights")),
    "attribution": (
        ("cc-by", 0.7, "you must give appropriate credit provide a link to the license and indicate if changes were made"),
        ("attribution", 0.4, "attribution (is)? required"),
        ("non-commercial", 0.6, "attribution non commercial"),
    ),
    "share alike": (("share-alike", 0.5, "attribution share alike"), ("share-alike", 0.5, "share alike licen[cs]e")),
    "public domain": (
        ("unlicense", 0.97, "this is free and unencumbered software released into the public domain"),
        ("public-domain", 0.9, "(dedicated|released|placed|donated) (in|into|to) the public domain"),
        ("public-domain", 0.8, "(is|are) (now)? (hereby)? in the public domain"),
        ("public-domain", 0.9, "the authors? (hereby)? disclaims? copyright to this source code"),
        ("pddl", 0.9, "(open data commons)? public domain dedication and licen[cs]e"),
    ),
    "anyone is free to": (("unlicense", 0.95, "anyone is free to copy modify publish use compile sell or distribute this software"), ("public-domain", 0.6, "anyone is free to (use|copy|share)")),
    "origin of this software": (("zlib", 0.97, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"), ("zlib", 0.8, "the origin of this software must not be misrepresented")),
    "plainly marked": (("zlib", 0.95, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),),
    "boost": (("bsl-1.0", 0.95, "distributed under the boost software licen[cs]e"), ("bsl-1.0", 0.9, "see accompanying file license 1 0 txt or copy at https? www boost org"), ("bsl-1.0", 0.8, "use modification and distribution are subject to the boost software licen[cs]e")),
    "font software": (("ofl", 0.97, "this font software is licensed under the sil open font licen[cs]e"), ("ofl", 0.9, "the font software may be sold as part of a larger software package"), ("ofl", 0.85, "reserved font name")),
    "reserved font": (("ofl", 0.85, "with reserved font names?"),),
    "beer": (("beerware", 0.9, "you can buy me a beer in return"), ("beerware", 0.9, "the beer ware licen[cs]e")),
    "do whatever you want": (("beerware", 0.8, "as long as you retain this notice you can do whatever you want with this stuff"), ("permissive", 0.6, "do whatever you want with (it|this)")),
    "for good": (("json", 0.97, "the software shall be used for good not evil"),),
    "source license": (
        ("busl", 0.95, "business source license included in the"),
        ("busl", 0.8, "the business source license this document or the license is not an open source license"),
        ("elastic", 0.8, "elastic source license"),
        ("open-source", 0.4, "(an)? open source license"),
    ),
    "side public license": (("sspl", 0.97, "server side public license"),),
    "commons clause": (("commons-clause", 0.95, "commons clause license condition"), ("commons-clause", 0.95, "subject to the commons clause")),
    "elastic license": (("elastic", 0.95, r"elastic license (2\.0|v2|agreement)"), ("elastic", 0.8, "under the elastic license")),
    "database license": (("odbl", 0.95, "open database license"), ("odbl", 0.9, "database contents license")),
    "open data": (("odc-by", 0.9, "open data commons attribution licen[cs]e"), ("odc", 0.7, "open data commons"), ("cdla", 0.9, "community data license agreement")),
    "government licence": (("ogl", 0.95, r"open government licence v?(1|2|3)\.0"), ("ogl", 0.9, "contains public sector information licensed under the open government licence"), ("ogl", 0.8, "open government licence")),
    "united states government": (("us-government", 0.8, "(is)? a work of the united states government"), ("us-government", 0.6, "works? of the united states government")),
    "crown copyright": (("crown-copyright", 0.9, "crown copyright"),),
    "community license": (("llama", 0.9, r"llama (2|3)? community license agreement"), ("community-license", 0.6, "community license agreement")),
    "rail": (("openrail", 0.9, "openrail (m|plus)"), ("openrail", 0.9, "creativeml open rail m"), ("openrail", 0.8, "responsible ai licen[cs]es?")),
    "proprietary": (
        ("proprietary", 0.9, "this software is (the)? (confidential and)? proprietary (information|to|property)"),
        ("proprietary", 0.8, "contains (confidential and)? proprietary (and)? (confidential)? information"),
        ("proprietary", 0.8, "proprietary (and|or) trade secret"),
    ),
    "confidential": (("proprietary", 0.6, "(strictly)? confidential (and privileged)? do not (distribute|copy|share)"), ("proprietary", 0.6, "company confidential"), ("proprietary", 0.7, "confidential information of")),
    "unauthorized": (("proprietary", 0.95, "unauthorized copying of this file via any medium is strictly prohibited"), ("proprietary", 0.8, "unauthorized (use|copying|reproduction|distribution|duplication) (or [a-z]+)? (of this [a-z]+)? is (strictly)? prohibited")),
    "strictly prohibited": (("proprietary", 0.7, "(reproduction|copying|distribution|duplication|use) (in whole or in part)? (without permission)? is strictly prohibited"),),
    "reverse engineer": (("proprietary", 0.9, "(may|shall|will|must) not (modify)? reverse engineer decompile or disassemble"), ("proprietary", 0.7, "reverse engineer(ing)? (is)? (not permitted|prohibited)")),
    "not sold": (("proprietary", 0.9, "(the|this) software is licensed not sold"), ("proprietary", 0.7, "licensed (and)? not sold")),
    "end user license": (("eula", 0.9, "end user license agreement"),),
    "internal use": (("proprietary", 0.6, "for internal use only"), ("proprietary", 0.6, "internal use only do not distribute")),
    "evaluation": (("proprietary", 0.6, "for evaluation (purposes)? only"), ("proprietary", 0.6, "evaluation (license|copy) only")),
    "no part of this": (("reserved", 0.8, "no part of this (publication|book|work|document|website) may be reproduced"), ("reserved", 0.7, "no part of this (publication|book|work) (shall|can) be")),
    "trade secret": (("proprietary", 0.7, "(contains|constitutes?) (valuable)? trade secrets?"),),
    "rights": (("reserved", 0.5, "all (other)? rights (are)? reserved by"), ("moral-rights", 0.4, "moral rights of the author")),
    "rechte vorbehalten": (("reserved", 0.9, "alle rechte vorbehalten"),),
    "droits": (("reserved", 0.9, "tous droits r[e\u00e9]serv[e\u00e9]s"),),
    "derechos reservados": (("reserved", 0.9, "todos los derechos reservados"),),
    "diritti riservati": (("reserved", 0.9, "tutti i diritti riservati"),),
    "dual": (("dual", 0.7, "dual licensed under"), ("dual", 0.7, "(is)? dual licensed"), ("dual", 0.7, "dual license")),
    "at your option": (("dual", 0.8, "(apache|mit) [a-z0-9., ]{0,40} or [a-z0-9., ]{0,40} (apache|mit) [a-z0-9., ]{0,40} at your option"),),
    "artistic": (("artistic", 0.9, "this package is free software you can redistribute it under the terms of the artistic licen[cs]e"), ("artistic", 0.7, "the artistic licen[cs]e")),
    "a package may be copied": (("artistic", 0.95, "the intent of this document is to state the conditions under which a package may be copied"),),
    "you just do what": (("wtfpl", 0.95, "you just do what the f[a-z]+ you want to"),),
    "w3c": (("w3c", 0.9, "w3c (r)? document license"), ("w3c", 0.9, "w3c software (and document)? notice and license")),
    "by obtaining": (("w3c", 0.9, "by obtaining (using)? and or copying this work you the licensee agree that you have read"),),
    "shareware": (("shareware", 0.8, "this (program|software) is shareware"), ("shareware", 0.6, "shareware (version|licen[cs]e)")),
    "freeware": (("freeware", 0.8, "this (program|software) is freeware"), ("freeware", 0.6, "released as freeware")),
    "royalty": (("royalty-free", 0.5, "royalty free (music|images?|photos?|stock)"), ("license-grant", 0.5, "non exclusive royalty free")),
    "personal use": (("non-commercial", 0.7, "for (your)? personal (non commercial)? use only"), ("non-commercial", 0.7, "free for (private and)? personal use")),
    "academic": (("non-commercial", 0.7, "for (non commercial)? academic (and research)? (use|purposes) only"), ("non-commercial", 0.6, "academic free use")),
    "patent": (("patent-notice", 0.5, "protected by (one or more)? (us|international)? patents?"), ("patent-notice", 0.5, "patents? pending"), ("patent-grant", 0.7, "additional grant of patent rights")),
    "trademark": (("trademark", 0.3, "(is|are) (a)? registered trademarks? of"), ("trademark", 0.3, "all trademarks are (the)? property of their respective owners"), ("trademark", 0.3, "(is|are) (a)? trademarks? of")),
    "licence": (("unknown-license", 0.4, "licence version [0-9]"), ("unknown-license", 0.4, "published under (the|a) [a-z0-9.-]+ licence")),
    "for license information": (("unknown-license", 0.4, "see (the)? (license|licence|copying) (txt|md|file)? for license information"),),
    "license file": (("unknown-license", 0.4, "(see|refer to) (the)? license file"), ("unknown-license", 0.4, "license file (in|at) the root")),
    "license agreement": (("eula", 0.5, "software license agreement"), ("eula", 0.5, "by (installing|using|downloading) (this|the) software you (agree|accept) [a-z ]{0,40} license agreement")),
}
